"""Text files, glossaries and reports to DataFrames."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.schema import ENTITY, TERM

ENTITY_FIELDS = ("id", "label", "synonyms", "relations", "definition", "source")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, text): one row per file, read whole as UTF-8, line ends as \\n; doc_id is the file's path."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def _json(spark: SparkSession, path: str):
    if not urlparse(str(path)).scheme and not Path(path).exists():
        raise FileNotFoundError(f"no such file: {path}")
    row = spark.read.text(str(path), wholetext=True).first()
    try:
        return json.loads(row[0] if row else "")
    except json.JSONDecodeError as e:
        raise ValueError(f"invalid JSON in {path}: {e}") from e


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Entities of one JSON array, in the file's order. Unknown fields, and elements without id or label, raise."""
    data = _json(spark, path)
    if not isinstance(data, list):
        raise ValueError(f"a glossary is a JSON array: {path}")
    rows = []
    for pos, item in enumerate(data):
        if not isinstance(item, dict) or not {"id", "label"} <= item.keys() or item.keys() - set(ENTITY_FIELDS):
            raise ValueError(f"bad entity at {pos} in {path}: {str(item)[:200]}")
        rows.append((pos, item["id"], item["label"], item.get("synonyms") or [], item.get("relations") or {}, item.get("definition"), item.get("source")))
    return spark.createDataFrame(rows, ENTITY)


def read_glossary_rows(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a large glossary, kept as JSON lines or Parquet with ``entity_pos``."""
    return spark.read.parquet(path) if str(path).rstrip("/").endswith(".parquet") else spark.read.schema(ENTITY).option("mode", "FAILFAST").json(path)


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """Suggested terms of a report, bare or under ``data``, with the defaults for what is left out; ``seq`` is their order.
    A list that the report keeps in a folder beside it is read from there."""
    payload = _json(spark, path)
    data = payload.get("data", payload) if isinstance(payload, dict) else {}
    items = data.get("suggested_entities")
    if items is None and isinstance(kept := data.get("suggested_entities_rows"), dict):
        return _suggestion_rows(spark, kept["path"])
    if not isinstance(items, list):
        raise ValueError(f"no list 'suggested_entities' in {path}")
    rows = []
    for k, x in enumerate(items):
        if not isinstance(x, dict):
            raise ValueError(f"bad suggested entity at {k} in {path}")
        span = x.get("span")
        span = [int(v) for v in span] if isinstance(span, list) and len(span) == 2 else [0, 0]
        text = str(x.get("text", ""))
        rows.append(
            (
                str(x.get("doc_id", "")), 0, k, text, str(x.get("original_text", text)), str(x.get("lemma", text)), *span, float(x.get("score", 0.0)), list(x.get("pos_tags", [])), str(x.get("sentence", "")),
                int(x.get("frequency", 1)), str(x.get("extractor_type", "")), {a: str(b) for a, b in x.get("properties", {}).items()},
            )
        )
    return spark.createDataFrame(rows, TERM)


def _suggestion_rows(spark: SparkSession, path: str) -> DataFrame:
    fields = [f for f in TERM.split(", ") if f.split()[0] not in ("extractor", "span_start", "span_end")]
    rows = spark.read.schema(", ".join([*fields, "span array<int>"])).option("mode", "FAILFAST").json(path)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        F.coalesce("doc_id", F.lit("")).alias("doc_id"), F.lit(0).alias("extractor"), "seq", text.alias("text"), F.coalesce("original_text", text).alias("original_text"), F.coalesce("lemma", text).alias("lemma"),
        F.col("span")[0].alias("span_start"), F.col("span")[1].alias("span_end"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("pos_tags", F.array().cast("array<string>")).alias("pos_tags"),
        F.coalesce("sentence", F.lit("")).alias("sentence"), F.coalesce("frequency", F.lit(1)).alias("frequency"), F.coalesce("extractor_type", F.lit("")).alias("extractor_type"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )


def open_source(spark: SparkSession, path: str) -> DataFrame:
    """A glossary by the file's suffix: .json, .jsonl and .parquet are read, RDF isn't implemented, others raise."""
    suffix = Path(str(path).rstrip("/")).suffix.lower()
    if suffix == ".json":
        return read_glossary(spark, path)
    if suffix in (".jsonl", ".parquet"):
        return read_glossary_rows(spark, path)
    if suffix in (".ttl", ".rdf"):
        raise NotImplementedError(f"RDF sources aren't implemented: {path}")
    raise ValueError(f"unknown kind of source: {path}")
