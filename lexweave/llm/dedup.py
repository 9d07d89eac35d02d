"""Duplicates hidden by formatting differences (problem 4): canonical keys, then sorted runs."""

from __future__ import annotations

import decimal
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.common import norm_id
from lexweave.llm.runs import collapsed, copies

TABLES = {"t": "text_entity", "g": "test_glossary", "r": "raw_record"}


def letters_key(c: Column) -> Column:
    """Letters, marks and numbers of a string in lower case; a null stays apart from an empty string."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", ""), F.lit("-"))


def json_key(payload: str | None) -> str | None:
    """Canonical form of a JSON payload, or None where it doesn't parse: fields sorted by name, strings by their letters,
    marks and numbers in lower case, numbers by value. Nesting too deep to parse counts as broken."""
    wide = decimal.Context(prec=decimal.MAX_PREC, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)
    drop = regex.compile(r"[^\p{L}\p{M}\p{N}]+")

    def refuse(name: str):
        raise ValueError(name)

    def number(s: str) -> decimal.Decimal:
        return decimal.Decimal(s)

    def form(x) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k)}:{form(x[k])}" for k in sorted(x)) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(form, x)) + "]"
        if isinstance(x, str):
            return '"' + drop.sub("", x.lower()) + '"'
        if isinstance(x, decimal.Decimal):
            if not x:
                return "0"
            sign, digits, exponent = x.as_tuple()
            text = "".join(map(str, digits)).lstrip("0")
            short = text.rstrip("0")
            return f"{'-' * sign}{short}e{exponent + len(text) - len(short)}"
        return json.dumps(x)

    if payload is None:
        return None
    try:
        with decimal.localcontext(wide):
            return form(json.loads(payload, parse_float=number, parse_int=number, parse_constant=refuse))
    except (ValueError, RecursionError, decimal.DecimalException):
        return None


def json_keys(df: DataFrame) -> DataFrame:
    """(row_id, key) of df(raw_id, payload)."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row_id": b["raw_id"], "key": [json_key(p) for p in b["payload"]]})

    return df.select("raw_id", "payload").mapInPandas(keys, "row_id long, key string")


def records(text_entity: DataFrame, test_glossary: DataFrame, raw_record: DataFrame) -> DataFrame:
    """(key, row_id): one key space for the three tables, each marked by its first letter. Separators can't occur in the
    parts, as those hold letters, marks and numbers only. Nulls equal nulls. Payloads that don't parse have no key."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    entities = text_entity.select(
        F.concat_ws("|", F.lit("t"), part("doc_id"), part("span_start"), part("span_end"), letters_key(F.col("text")), letters_key(F.col("original_text"))).alias("key"), F.col("te_id").alias("row_id")
    )
    own = ~F.coalesce(norm_id(F.col("source")) == "intake_form", F.lit(False))
    labels = test_glossary.filter(own).select(F.concat_ws("|", F.lit("g"), letters_key(F.col("label"))).alias("key"), F.col("entry_id").alias("row_id"))
    dumps = json_keys(raw_record).filter("key IS NOT NULL").select(F.concat_ws("|", F.lit("r"), "key").alias("key"), "row_id")
    return entities.unionByName(labels).unionByName(dumps)




def copies_found(text_entity: DataFrame, test_glossary: DataFrame, raw_record: DataFrame) -> DataFrame:
    """(tbl, first_id, copy_id). The three tables share one sort; ids carry their table in two low bits until the end."""
    return _decode(copies(_encode(records(text_entity, test_glossary, raw_record))), "first_id", "copy_id")


def copies_counted(text_entity: DataFrame, test_glossary: DataFrame, raw_record: DataFrame) -> DataFrame:
    """(tbl, first_id, copies): one row for each distinct record."""
    return _decode(collapsed(_encode(records(text_entity, test_glossary, raw_record))), "first_id")


def _encode(df: DataFrame) -> DataFrame:
    code = F.when(F.substring("key", 1, 1) == "t", 0).when(F.substring("key", 1, 1) == "g", 1).otherwise(2)
    return df.select("key", (F.col("row_id") * 4 + code).alias("row_id"))


def _decode(df: DataFrame, *ids: str) -> DataFrame:
    code = F.pmod(F.col(ids[0]), F.lit(4))
    tbl = F.when(code == 0, "text_entity").when(code == 1, "test_glossary").otherwise("raw_record")
    rest = [c for c in df.columns if c not in ids]
    return df.select(tbl.alias("tbl"), *[F.expr(f"({c} - pmod({c}, 4)) div 4").alias(c) for c in ids], *rest)
