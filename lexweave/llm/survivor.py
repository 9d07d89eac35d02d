"""Best representative of each duplicate group (problem 7).

``survivors`` ranks candidates field by field by a fixed order of trust, recency and id. ``discover`` estimates sources'
reliability and values' support in turns until they settle. Both fold rows with aggregates that combine map-side, so a group
that holds a third of all rows never meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, non_blank, norm_id, py_strip

# Definitions that say nothing, in lower case, without surrounding white space and final full stops.
PLACEHOLDERS = (
    "", "-", "--", "—", "–", "?", "??", "???", "…", "tbd", "tba", "tbc", "todo", "todo: definition", "to do", "to be defined", "n/a", "na", "n.a", "none", "null", "nil", "xxx", "xx", "x", "nan", "unknown",
    "no definition", "see later", "placeholder", "нет данных", "нет определения", "нет", "см. позже", "позже", "уточнить", "не указано", "неизвестно", "keine angabe", "keine definition", "k.a",
)
NO_TRUST = 1_000_000


def is_placeholder(c: Column) -> Column:
    """Blank, one of the fixed values, or without any letter or number."""
    bare = F.regexp_replace(F.lower(py_strip(c)), r"[\s.…!]+$", "")
    return bare.isin(*PLACEHOLDERS) | ~bare.rlike(r"[\p{L}\p{N}]")


def distinct_synonyms(c: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(c, non_blank), norm_id))


def with_trust(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with ``_trust`` (unlisted sources last) and ``_listed``. The list of sources is one row per source after
    folding repeated ones to the best level; Spark broadcasts it only if its measured size is under the session's limit."""
    levels = sources.filter(non_blank(F.col("source"))).groupBy(norm_id(F.col("source")).alias("_source")).agg(F.min("trust_level").alias("_level"), F.lit(True).alias("_in"))
    rows = entries.select("entry_id", "id", "definition", "synonyms", "source", "updated_at").filter(non_blank(F.col("id")))
    rows = rows.withColumn("_source", norm_id(F.col("source"))).join(levels, "_source", "left")
    return rows.withColumns({"_trust": F.coalesce("_level", F.lit(NO_TRUST)), "_listed": F.coalesce("_in", F.lit(False)), "id": norm_id(F.col("id"))}).drop("_level", "_in")


def survivors(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, definition_from, synonyms_from, source_from) for ids with two or more rows; -1 where no row has a fit value.
    A null ``updated_at`` is the oldest. One shuffle of one folded row per id and map task."""
    rows = with_trust(entries, sources)
    at = F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62)))
    n_syn = F.coalesce(F.size(distinct_synonyms(F.col("synonyms"))), F.lit(0))
    rows = rows.withColumns({"_at": at, "_n": n_syn, "_meaning": non_blank(F.col("definition")) & ~is_placeholder(F.col("definition"))})
    pick = lambda fit, *order: F.max(F.when(fit, F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.col("entry_id").alias("e"))))["e"]
    trust, when = -F.col("_trust"), F.col("_at")
    return (
        rows.groupBy("id")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(pick(F.col("_meaning"), trust, when), F.lit(-1)).alias("definition_from"),
            F.coalesce(pick(F.col("_n") > 0, F.col("_n"), trust, when), F.lit(-1)).alias("synonyms_from"),
            F.coalesce(pick(F.col("_listed"), when), F.lit(-1)).alias("source_from"),
        )
        .filter("n >= 2")
        .drop("n")
    )


def _shapes(claims: DataFrame) -> DataFrame:
    """(shape, times, part, n, s): what weights depend on. The shape of a field of an id is which sets of sources stand for
    how many of its values; equal shapes, of which there are few however many ids, are counted (``times``). So the turns
    read this table only, and the claims are shuffled once."""
    sets = claims.groupBy("id", "field", "value").agg(F.array_sort(F.collect_set("s")).alias("ss"))
    parts = sets.groupBy("id", "field", "ss").agg(F.count("*").alias("n"))
    shapes = parts.groupBy("id", "field").agg(F.array_sort(F.collect_list(F.struct("ss", "n"))).alias("parts")).groupBy("parts").agg(F.count("*").alias("times"))
    shapes = durable(shapes.withColumn("shape", F.monotonically_increasing_id()))
    each = shapes.select("shape", "times", F.posexplode("parts").alias("part", "x"))
    return durable(each.select("shape", "times", "part", F.col("x.n").alias("n"), F.explode("x.ss").alias("s")))


def discover(entries: DataFrame, sources: DataFrame, rounds: int = 200, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Truth discovery. A source's claim is a value of a field of an id; equal claims of one source count once. In turns,
    a value's support is the sum of its sources' weights, and a source's weight the mean share of support that its claims
    have (smoothed by its trust level as the start). Ends when no weight moves by more than ``tolerance``; if ``rounds``
    turns don't get there, an error says so and nothing comes out.

    Returns (values: id, field, value, support), the highest-supported value per id and field, and (weights: source, weight).
    Supports that agree to six digits are ties, which go to the smallest value, so the order of sums never decides. Placeholders and blanks claim nothing; unlisted and null sources act as one source.
    """
    rows = with_trust(entries, sources)
    source = F.when(F.col("_listed"), F.col("_source")).otherwise("")
    fields = {
        "definition": F.when(non_blank(F.col("definition")) & ~is_placeholder(F.col("definition")), py_strip(F.col("definition"))),
        "synonyms": F.when(F.size(distinct_synonyms(F.col("synonyms"))) > 0, F.array_join(F.array_sort(distinct_synonyms(F.col("synonyms"))), " | ")),
        "source": F.when(F.col("_listed"), F.col("_source")),
    }
    claims = reduce(DataFrame.unionByName, [rows.select("id", F.lit(k).alias("field"), v.alias("value"), source.alias("s"), "_trust") for k, v in fields.items()])
    claims = durable(claims.filter("value IS NOT NULL").groupBy("id", "field", "value", "s").agg(F.min("_trust").alias("_trust")))
    prior = durable(claims.groupBy("s").agg((F.lit(1.0) / (1 + F.least(F.min("_trust"), F.lit(20)))).alias("w0")))
    weights, shapes = prior.withColumnRenamed("w0", "w"), _shapes(claims)
    for _ in range(rounds):
        support = shapes.join(weights, "s").groupBy("shape", "part").agg(F.sum("w").alias("support"), F.first("times").alias("times"), F.first("n").alias("n"), F.collect_list("s").alias("ss"))
        total = support.groupBy("shape").agg(F.sum(F.col("support") * F.col("n")).alias("all"))
        share = support.join(total, "shape").select(F.explode("ss").alias("s"), (F.col("times") * F.col("n")).alias("n"), (F.col("support") / F.col("all")).alias("share"))
        fresh = share.groupBy("s").agg((F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("m")).join(prior, "s").select("s", (0.5 * F.col("m") + 0.5 * F.col("w0")).alias("w"))
        fresh = durable(fresh)
        moved = fresh.join(weights.withColumnRenamed("w", "old"), "s").agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0]
        weights = fresh
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"weights still moved by {moved} after {rounds} rounds: raise rounds or tolerance")
    support = claims.join(weights, "s").groupBy("id", "field", "value").agg(F.sum("w").alias("support"))
    best = support.groupBy("id", "field").agg(F.min_by(F.struct("value", "support"), F.struct(-F.round("support", 6), "value")).alias("b"))
    return best.select("id", "field", "b.value", "b.support"), weights.select(F.col("s").alias("source"), F.col("w").alias("weight"))
