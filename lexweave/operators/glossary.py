"""Glossary index, lookups, and glossaries made from unmatched terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import canonical_term, id_prefix


def glossary_index(entities: DataFrame) -> DataFrame:
    """(term, entity_pos, term_pos): every label and synonym in lower case, the label at place 0. Duplicates stay."""
    every = F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return entities.select("entity_pos", F.posexplode(every).alias("term_pos", "term")).filter("term IS NOT NULL").select(F.lower("term").alias("term"), "entity_pos", "term_pos")


def first_entities(index: DataFrame) -> DataFrame:
    """(term, entity_pos, key_pos): the first entity under each term; key_pos orders terms by their first appearance."""
    first = F.min(F.struct("entity_pos", "term_pos")).alias("x")
    return index.groupBy("term").agg(first).select("term", F.col("x.entity_pos").alias("entity_pos"), (F.col("x.entity_pos") * F.lit(2**20) + F.col("x.term_pos")).alias("key_pos"))


def lookup(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """terms(pos, term) with the first entity of each; misses drop out, repeated terms stay; ``pos`` keeps the order."""
    firsts = first_entities(glossary_index(entities)).select(F.col("term").alias("_t"), "entity_pos")
    return terms.join(firsts, F.lower("term") == F.col("_t")).drop("_t").join(entities, "entity_pos")


def from_candidates(candidates: DataFrame, namespace: str = "term", min_score: float = 0.0, min_frequency: int = 1, source_tag: str = "ontology_update") -> DataFrame:
    """Entities from candidates(ord, text, original_text, lemma, score, frequency): one per canonical term of lemma, else
    text, else original text; synonyms are the other canonical writings in order of ``ord``. Ids are the namespace and as
    many digits of the key's hash as keep it apart from keys before it. Rows without a key drop out.

    Candidates fold to distinct (key, writing) pairs map-side, so a key that holds a third of them doesn't meet in one task.
    """
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = candidates.filter((F.col("score") >= min_score) & (F.col("frequency") >= min_frequency))
    key = canonical_term(F.coalesce(filled("lemma"), filled("text"), F.col("original_text")))
    rows = rows.withColumn("key", key).filter("key <> ''")
    names = F.array(F.struct(F.lit(0).alias("n"), canonical_term(F.col("original_text")).alias("s")), F.struct(F.lit(1).alias("n"), canonical_term(F.col("text")).alias("s")))
    pairs = rows.select("key", "ord", F.explode(names).alias("x")).groupBy("key", F.col("x.s").alias("s")).agg(F.min(F.struct("ord", "x.n")).alias("first"))
    other = (F.col("s") != "") & (F.col("s") != F.col("key"))
    grouped = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.when(other, F.struct("first", "s")))).alias("ss"))
    ids = grouped.select("key", F.transform("ss", lambda x: x["s"]).alias("synonyms"), *[id_prefix(F.col("key"), k).alias(f"p{k}") for k in (10, 14, 20, 40)])
    before = lambda p: F.row_number().over(Window.partitionBy(p).orderBy("key"))
    # A key whose short prefix is taken by a smaller key tries the next length; prefixes part nearly all keys, so groups are tiny.
    ids = ids.withColumn("r10", before("p10")).withColumn("r14", before("p14")).withColumn("r20", before("p20"))
    digits = F.when(F.col("r10") == 1, F.col("p10")).when(F.col("r14") == 1, F.col("p14")).when(F.col("r20") == 1, F.col("p20")).otherwise(F.col("p40"))
    return ids.select(
        F.concat(F.lit(namespace + ":"), digits).alias("id"), F.col("key").alias("label"), "synonyms", F.create_map().cast("map<string,array<string>>").alias("relations"), F.lit(None).cast("string").alias("definition"), F.lit(source_tag).alias("source")
    )
