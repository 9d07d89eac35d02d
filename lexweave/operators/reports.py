"""Reports as DataFrames, one row per document, or one row over all with ``doc_id`` left out of ``by``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ("doc_id",)


@dataclass(frozen=True)
class QualityGates:
    min_coverage: float = 90.0
    max_unknown: int = 5
    min_quality_score: float = 0.8
    enforce_quality_score: bool = False  # an extension: the score is otherwise reported and never checked


def extraction_report(terms: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, total_items, processed_items, score_min, score_avg, score_max)."""
    return terms.groupBy(*by).agg(F.count("*").alias("total_items"), F.count("*").alias("processed_items"), F.min("score").alias("score_min"), F.avg("score").alias("score_avg"), F.max("score").alias("score_max"))


def extractor_stats(terms: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return terms.groupBy(*by, "extractor_type").agg(F.count("*").alias("n_terms"))


def verification_report(matches: DataFrame, by: tuple[str, ...] = BY, unknown_score: float = 0.8) -> DataFrame:
    """(by, total_items, processed_items, coverage_pct, n_unknown, quality_score): coverage counts MATCHED and NEAR_MATCH;
    unknown terms are UNKNOWN ones that score at least ``unknown_score``; the quality score is the mean confidence of
    MATCHED rows, 0 without any. Without rows ``by=()`` still gives one row, with coverage 0."""
    hit = F.count_if(F.col("status").isin("MATCHED", "NEAR_MATCH"))
    rows = matches.groupBy(*by).agg(
        F.count("*").alias("total_items"),
        hit.alias("processed_items"),
        F.count_if((F.col("status") == "UNKNOWN") & (F.col("score") >= unknown_score)).alias("n_unknown"),
        F.coalesce(F.avg(F.when(F.col("status") == "MATCHED", F.col("confidence"))), F.lit(0.0)).alias("quality_score"),
    )
    coverage = F.when(F.col("total_items") > 0, F.col("processed_items") * 100.0 / F.col("total_items")).otherwise(0.0)
    return rows.select(*by, "total_items", "processed_items", coverage.alias("coverage_pct"), "n_unknown", "quality_score")


def unknown_terms(matches: DataFrame, unknown_score: float = 0.8) -> DataFrame:
    return matches.filter((F.col("status") == "UNKNOWN") & (F.col("score") >= unknown_score))


def suggested_terms(matches: DataFrame) -> DataFrame:
    """Every UNKNOWN row, whatever its score."""
    return matches.filter(F.col("status") == "UNKNOWN")


def ontology_update_report(matches: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, total_items, processed_items) where any term is unknown; processed counts the suggestions."""
    unknown = F.count_if(F.col("status") == "UNKNOWN")
    return matches.groupBy(*by).agg(F.count("*").alias("total_items"), unknown.alias("processed_items")).filter("processed_items > 0")


def quality_gate(verification: DataFrame | None, gates: QualityGates = QualityGates(), spark=None) -> DataFrame:
    """Adds quality_pass and exit_code to verification rows. Without a verification report the gate fails."""
    if verification is None:
        return spark.createDataFrame([(False, 1)], "quality_pass boolean, exit_code int")
    ok = (F.col("coverage_pct") >= gates.min_coverage) & (F.col("n_unknown") <= gates.max_unknown)
    if gates.enforce_quality_score:
        ok = ok & (F.col("quality_score") >= gates.min_quality_score)
    return verification.withColumn("quality_pass", ok).withColumn("exit_code", F.when(ok, 0).otherwise(1))
