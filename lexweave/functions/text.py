"""Scalar text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.common import SPACE_CLASS, py_strip

# Fixed value: the characters that a canonical term loses at both ends.
EDGE_CHARS = ".,;:!?()[]{}\"'`"


def canonical_term(c: Column) -> Column:
    """Lower case, stripped, ё as е, white space collapsed, then without EDGE_CHARS at both ends. Null gives null."""
    t = F.translate(py_strip(F.lower(c)), "ё", "е")
    return F.btrim(F.regexp_replace(t, f"{SPACE_CLASS}+", " "), F.lit(EDGE_CHARS))


def id_prefix(key: Column, length: int) -> Column:
    """The first hex digits of the key's SHA-1."""
    return F.substring(F.sha1(F.encode(key, "UTF-8")), 1, length)
