"""Frequency of every distinct term (problem 6), by sorted runs of (term, record id) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.common import non_blank, norm_id
from lexweave.llm.runs import term_runs


def term_pairs(text_entity: DataFrame) -> DataFrame:
    """(term, doc, weight) of rows whose lemma isn't blank; a null or senseless frequency counts as 1."""
    return text_entity.filter(non_blank(F.col("lemma"))).select(
        norm_id(F.col("lemma")).alias("term"), F.col("doc_id").cast("long").alias("doc"), F.greatest(F.coalesce("frequency", F.lit(1)), F.lit(1)).cast("long").alias("weight")
    )


def term_frequencies(text_entity: DataFrame, common_share: float = 0.02, rare_below: int = 4) -> DataFrame:
    """(lemma, total, n_docs, mark): mark is 'common' above ``common_share`` of the documents that have any term, else 'rare'
    below ``rare_below`` occurrences, else null. Rows without doc_id add to totals only. One number, the count of
    documents, comes to the driver."""
    pairs = term_pairs(text_entity)
    n_docs = pairs.select("doc").distinct().agg(F.count("doc")).first()[0]
    mark = F.when(F.col("docs") > F.lit(common_share * n_docs), "common").when(F.col("total") < rare_below, "rare")
    return term_runs(pairs).select(F.col("term").alias("lemma"), "total", F.col("docs").alias("n_docs"), mark.alias("mark"))


def marked_terms(text_entity: DataFrame) -> DataFrame:
    return term_frequencies(text_entity).filter("mark IS NOT NULL").select("lemma", "mark")
