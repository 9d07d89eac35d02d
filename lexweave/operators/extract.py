"""Union of extractors, normalisation, filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.common import py_strip

Extractor = Callable[[DataFrame], DataFrame]


def extract_all(documents: DataFrame, extractors: list[Extractor]) -> DataFrame:
    """Terms of all extractors, numbered by ``extractor`` in the order given; nothing is merged across extractors."""
    if not extractors:
        raise ValueError("no extractors defined")
    parts = [fn(documents).withColumn("extractor", F.lit(k)) for k, fn in enumerate(extractors)]
    return reduce(DataFrame.unionByName, parts)


def normalize(terms: DataFrame) -> DataFrame:
    """Text in lower case and stripped, lemma replaced by the text in lower case, extractor type marked. Rows stay apart
    even where they become equal."""
    return terms.withColumns({"text": py_strip(F.lower("text")), "lemma": F.lower("text"), "extractor_type": F.concat("extractor_type", F.lit("_normalized"))})


def filter_terms(terms: DataFrame, min_score: float = 0.0, min_length: int = 0) -> DataFrame:
    """An extension: terms of at least this score and this many characters."""
    return terms.filter((F.col("score") >= min_score) & (F.length("text") >= min_length))
