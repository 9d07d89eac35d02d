"""Term candidates: sliding windows over the tokens of a sentence. Windows keep the tokens' partitioning: no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.tokens import STOP_WORDS

HEURISTIC_MAX_LENGTH = 2
# Last words that make no term, and parts of speech of terms and of their boundaries.
BAD_ENDINGS = (
    "use", "uses", "using", "used", "process", "processes", "processing", "processed", "apply", "applies", "applying", "applied",
    "make", "makes", "making", "made", "perform", "performs", "performing", "performed",
)
TERM_POS = ("ADJ", "NOUN", "PROPN")
BOUNDARY_POS = ("VERB", "AUX", "CCONJ", "SCONJ", "ADP", "DET", "PRON", "PART", "PUNCT", "ADV")
CANDIDATE_COLUMNS = ("doc_id", "text", "n_tok", "sent_id", "first_idx", "char_start", "char_end", "occ")


def _windows(tokens: DataFrame, by: list[str], lengths: range, keep, order) -> DataFrame:
    """All windows of these lengths. The tokens' columns of each place come from ``lead`` over one window, and the windows of
    all lengths from one explode, so tokens are made once whatever the lengths."""
    w = Window.partitionBy("doc_id", *by).orderBy("tok_idx")
    cols = ("token", "lemma", "pos", "char_end")
    wide = tokens.select("*", *[F.lead(c, k).over(w).alias(f"{c}_{k}") for k in range(1, max(lengths, default=1)) for c in cols])

    def window(n: int) -> Column:
        at = lambda c: [F.col(c), *[F.col(f"{c}_{k}") for k in range(1, n)]]
        one = F.struct(F.concat_ws(" ", *at("token")).alias("text"), F.lit(n).alias("n_tok"), at("char_end")[-1].alias("char_end"), order(n).alias("occ"))
        return F.when(at("token")[-1].isNotNull() & keep(at), one)

    made = F.filter(F.array(*map(window, lengths or (1,))), lambda x: x.isNotNull() & F.lit(bool(lengths)))
    rows = wide.select("doc_id", "sent_id", F.col("tok_idx").alias("first_idx"), "char_start", F.explode(made).alias("x"))
    return rows.select("doc_id", "x.text", "x.n_tok", "sent_id", "first_idx", "char_start", "x.char_end", "x.occ")


def _is_title(c: Column) -> Column:
    rest = F.substr(c, F.lit(2))
    return c.rlike(r"^\p{Lu}") & (F.length(c) > 1) & (F.lower(rest) == rest) & rest.rlike(r"\p{Ll}")


def heuristic_candidates(tokens: DataFrame, min_length: int = 2, max_length: int = 4) -> DataFrame:
    """(CANDIDATE_COLUMNS): windows of ``min_length`` to at most two tokens inside a sentence, without stop words, without
    a verb form at the end, with at most one inner title-case word and no word of fewer than three letters. ``occ`` orders
    occurrences by sentence, length and place."""

    def keep(at) -> Column:
        ok = ~at("lemma")[-1].isin(*BAD_ENDINGS)
        for lemma, token in zip(at("lemma"), at("token")):
            ok = ok & ~lemma.isin(*STOP_WORDS) & (F.length(token) >= 3)
        titles = [_is_title(t).cast("int") for t in at("token")[1:]]
        return ok & (reduce(lambda a, b: a + b, titles) <= 1 if titles else F.lit(True))

    order = lambda n: F.struct(F.col("sent_id").cast("int").alias("a"), F.lit(n).alias("b"), F.col("tok_idx").cast("int").alias("c"))
    return _windows(tokens, ["sent_id"], range(min_length, min(max_length, HEURISTIC_MAX_LENGTH) + 1), keep, order)


def pos_segments(tokens: DataFrame) -> DataFrame:
    """Tokens that may belong to a term, with ``seg_id``: runs of adjectives and nouns of more than two letters that no
    other token interrupts."""
    if "pos" not in tokens.columns:
        raise ValueError("tokens carry no parts of speech: give a tagger")
    w = Window.partitionBy("doc_id", "sent_id").orderBy("tok_idx")
    fit = F.coalesce(F.col("pos").isin(*TERM_POS) & ~F.col("is_punct") & (F.length("token") > 2), F.lit(False))
    return tokens.withColumn("fit", fit).withColumn("seg_id", F.sum((~F.col("fit")).cast("int")).over(w).cast("int")).filter("fit").drop("fit")


def pos_candidates(tokens: DataFrame, min_length: int = 2, max_length: int = 4) -> DataFrame:
    """(CANDIDATE_COLUMNS): windows of a segment that are adjectives followed by at least one noun. ``occ`` orders by
    sentence, segment, first and last token, which is the order of first and last token inside a sentence."""

    def keep(at) -> Column:
        return F.concat(*[F.when(p == "ADJ", "A").otherwise("N") for p in at("pos")]).rlike("^A*N+$")

    order = lambda n: F.struct(F.col("sent_id").cast("int").alias("a"), F.col("tok_idx").cast("int").alias("b"), F.lit(n).alias("c"))
    return _windows(pos_segments(tokens), ["sent_id", "seg_id"], range(max(1, min_length), max_length + 1), keep, order)
