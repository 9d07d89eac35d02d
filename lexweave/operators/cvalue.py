"""C-value: candidates of a document grouped by text, discounted by the longer terms they are nested in, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.candidates import heuristic_candidates, pos_candidates
from lexweave.operators.tokens import choose_tokenizer

ENTITY_COLUMNS = ("doc_id", "extractor", "seq", "text", "original_text", "lemma", "span_start", "span_end", "score", "pos_tags", "sentence", "frequency", "extractor_type", "length", "token_count", "pattern_id")


def count_candidates(candidates: DataFrame, min_freq: int = 1) -> DataFrame:
    """(doc_id, text, freq, n_tok, span_start, span_end, occ): one row per text of a document, case kept, with its first
    occurrence; only texts that occur ``min_freq`` times."""
    first = F.min(F.struct("occ", "n_tok", "char_start", "char_end")).alias("x")
    rows = candidates.groupBy("doc_id", "text").agg(F.count("*").alias("freq"), first).filter(F.col("freq") >= min_freq)
    return rows.select("doc_id", "text", "freq", F.col("x.n_tok").alias("n_tok"), F.col("x.char_start").alias("span_start"), F.col("x.char_end").alias("span_end"), F.col("x.occ").alias("occ"))


def score_candidates(counted: DataFrame, nested: bool = True) -> DataFrame:
    """Adds ``score``: log2(length) times (frequency less the mean frequency of the longer terms that hold the text), at
    least 0; 0 for single words. Terms that hold a text are found by exploding each term's proper parts and grouping,
    so the work grows with the terms, not with their pairs. ``nested=False`` skips this where no text can be nested."""
    if nested:
        w = F.split("text", " ")
        n = F.size(w)
        parts = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda s: F.array_join(F.slice(w, s, k), " "))))
        parts = F.when(n > 1, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))
        # A term meets the parts of longer terms in one group, so nothing is computed twice and nothing is joined.
        each = F.concat(F.array(F.struct(F.lit(True).alias("own"), F.col("text").alias("t"))), F.transform(parts, lambda p: F.struct(F.lit(False).alias("own"), p.alias("t"))))
        rows = counted.select("doc_id", "freq", F.struct("freq", "n_tok", "span_start", "span_end", "occ").alias("me"), F.explode(each).alias("x"))
        met = rows.groupBy("doc_id", F.col("x.t").alias("text")).agg(F.max(F.when(F.col("x.own"), F.col("me"))).alias("me"), F.avg(F.when(~F.col("x.own"), F.col("freq"))).alias("mean_pf"))
        terms = met.filter("me IS NOT NULL").select("doc_id", "text", "me.*", "mean_pf")
    else:
        terms = counted.withColumn("mean_pf", F.lit(None).cast("double"))
    raw = F.log2("n_tok") * (F.col("freq") - F.coalesce("mean_pf", F.lit(0.0)))
    return terms.withColumn("score", F.when(F.col("n_tok") <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), raw))).drop("mean_pf")


def rank_terms(scored: DataFrame, threshold: float = 0.25, extractor: int = 0) -> DataFrame:
    """(ENTITY_COLUMNS): terms of at least ``threshold``, in each document by score, length, frequency (all descending),
    lower-case text and first occurrence."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("n_tok"), F.desc("freq"), F.lower("text"), "occ")
    return scored.filter(F.col("score") >= threshold).select(
        "doc_id", F.lit(extractor).alias("extractor"), (F.row_number().over(order) - 1).alias("seq"), "text", F.col("text").alias("original_text"), F.lower("text").alias("lemma"),
        "span_start", "span_end", "score", F.array().cast("array<string>").alias("pos_tags"), F.lit("").alias("sentence"), F.col("freq").cast("int").alias("frequency"),
        F.lit("cvalue").alias("extractor_type"), F.col("n_tok").alias("length"), F.lit(None).cast("int").alias("token_count"), F.lit(None).cast("decimal(20,0)").alias("pattern_id"),
    )


def extract_cvalue(documents: DataFrame, threshold: float = 0.25, min_freq: int = 1, min_length: int = 2, max_length: int = 4, use_ling_filter: bool = True, tagger=None, extractor: int = 0) -> DataFrame:
    """The C-value extractor. Without a tagger it falls back to the heuristic mode. Spans are character offsets."""
    tokens, tagged = choose_tokenizer(documents, use_ling_filter, tagger)
    candidates = (pos_candidates if tagged else heuristic_candidates)(tokens, min_length, max_length)
    nested = tagged or min_length < min(max_length, 2)
    return rank_terms(score_candidates(count_candidates(candidates, min_freq), nested), threshold, extractor)
