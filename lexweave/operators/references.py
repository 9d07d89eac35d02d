"""References to records that do not exist when the naming record is loaded (problem 1).

Plan: references are pre-aggregated per target and month (map-side combined, so a hot target shrinks to one row a month);
lives of records are folded to one row per id and month in the same way; both meet in a window over months per id, which
is short whatever the skew. Counts are taken from the pre-aggregates wherever one verdict holds for a whole month. Single
references get their verdict through a split join: verdicts of hot targets are size-checked and broadcast, or salted
beyond the bound; the others take a shuffle join; both parts are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.common import durable, heavy_keys, non_blank, norm_id

RELATIONS = ("part_of", "used_in")


def reference_rows(entries: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(entry_id, relation, target_id, ref_at): each distinct non-blank id named by a row, normalised. No shuffle: ids
    repeated inside one row are folded there. Null maps, arrays and elements name nothing."""
    def of(r: str):
        ids = F.array_distinct(F.transform(F.filter(F.try_element_at("relations", F.lit(r)), non_blank), norm_id))
        return F.transform(ids, lambda t: F.struct(F.lit(r).alias("relation"), t.alias("target_id")))

    named = [of(r) for r in relations]
    every = F.flatten(F.array_compact(F.array(*named)))
    return entries.select("entry_id", F.col("loaded_at").alias("ref_at"), F.explode(every).alias("x")).select(
        "entry_id", "x.relation", "x.target_id", "ref_at"
    )


def _lives(entries: DataFrame) -> DataFrame:
    """(target_id, period, spans, ends_at): lives that begin in a month, merged where they overlap, and their latest end."""
    forever = F.to_timestamp(F.lit("9999-12-31 00:00:00"))
    rows = entries.select(norm_id(F.col("id")).alias("target_id"), F.col("loaded_at").alias("a"), F.col("deleted_at").alias("b"))
    rows = rows.filter(non_blank(F.col("target_id")) & F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("b") > F.col("a"))))
    rows = rows.withColumn("period", F.trunc("a", "month")).withColumn("b", F.coalesce("b", forever))
    ends = rows.groupBy("target_id", "period", "a").agg(F.max("b").alias("b"))  # repeated deliveries fold map-side
    w = Window.partitionBy("target_id", "period").orderBy("a")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("new", F.when(F.coalesce(F.col("a") > before, F.lit(True)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(w)).groupBy("target_id", "period", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("target_id", "period").agg(F.collect_list(F.struct("a", "b")).alias("spans"), F.max("b").alias("ends_at"))


def _verdicts(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """(target_id, period, n, first, last, carried, spans), a durable table: references pre-aggregated per target and month
    with their first and last time, the latest end of lives that began in earlier months, and the lives of the month."""
    none = F.lit(None)
    lives = _lives(entries)
    of = lambda c: lives.schema[c].dataType
    named = refs.filter(F.col("ref_at").isNotNull()).groupBy("target_id", "period").agg(F.count("*").alias("n"), F.min("ref_at").alias("first"), F.max("ref_at").alias("last"))
    both = named.withColumns({"spans": none.cast(of("spans")), "ends_at": none.cast(of("ends_at"))}).unionByName(
        lives.withColumns({"n": F.lit(0).cast("long"), "first": none.cast("timestamp"), "last": none.cast("timestamp")})
    )
    months = both.groupBy("target_id", "period").agg(F.first("spans", True).alias("spans"), *[F.max(c).alias(c) for c in ("ends_at", "n", "first", "last")])
    w = Window.partitionBy("target_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return durable(months.withColumn("carried", F.max("ends_at").over(w)).filter("n > 0").drop("ends_at"))


def _alive() -> Column:
    return F.coalesce((F.col("carried") > F.col("ref_at")) | F.exists("spans", lambda s: (s["a"] <= F.col("ref_at")) & (s["b"] > F.col("ref_at"))), F.lit(False))


def check_references(entries: DataFrame, relations: tuple[str, ...] = RELATIONS, share: float = 0.01, hot_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """All references with ``orphan`` (boolean): true where no record with the target's id was loaded by then and not yet
    deleted. A naming row without ``loaded_at`` can't have seen any record: its references are orphans. A record without
    ``loaded_at`` never lives. Extra columns are ignored; an empty table gives no rows.

    Verdicts of hot targets, at most 1/``share`` of them times their months, are counted: up to ``hot_rows`` are broadcast,
    more are joined salted."""
    refs = reference_rows(entries, relations).withColumn("period", F.trunc("ref_at", "month"))
    verdicts = _verdicts(entries, refs)
    hot = heavy_keys(verdicts.groupBy("target_id").agg(F.sum("n").alias("n")), "target_id", share=share)
    joined = _join_verdicts(refs, verdicts, hot, hot_rows, salts)
    return joined.select("entry_id", "relation", "target_id", "ref_at", (~_alive()).alias("orphan"))


def _join_verdicts(refs: DataFrame, verdicts: DataFrame, hot: list, hot_rows: int = 100_000, salts: int = 16, how: str = "left") -> DataFrame:
    """The join key is target and month in one column, so that even a hot target spreads over its months."""
    on = lambda p: F.concat_ws("\u0001", F.coalesce(F.date_format(p, "yyyy-MM"), F.lit("-")), "target_id")
    left = refs.withColumn("_k", on("period"))
    right = verdicts.select(on("period").alias("_k"), "target_id", "carried", "spans")
    if not hot:
        return left.join(right.drop("target_id"), "_k", how)
    is_hot = F.col("target_id").isin(hot)
    warm, cold, hot_right = left.filter(is_hot), left.filter(~is_hot), right.filter(is_hot).drop("target_id")
    cold = cold.join(right.filter(~is_hot).drop("target_id"), "_k", how)
    if hot_right.limit(hot_rows + 1).count() <= hot_rows:
        warm = warm.join(F.broadcast(hot_right), "_k", how)
    else:
        spread = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        warm = warm.withColumn("_salt", F.pmod(F.xxhash64("entry_id", "relation"), F.lit(salts)).cast("int")).join(spread, ["_k", "_salt"], how).drop("_salt")
    return cold.unionByName(warm)


def orphans_found(entries: DataFrame) -> DataFrame:
    return check_references(entries).filter("orphan").select("entry_id", "relation", "target_id")


def orphan_counts(entries: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(relation, month, n_refs, n_orphans) per relation and month of the naming row's ``loaded_at``.

    Counts come from references pre-aggregated per relation, target and month wherever one verdict holds for all of them: the
    target lives on from before beyond the last of them, or doesn't live at all that month. Only references to a target in a
    month in which it begins or ends are looked at one by one; both counts are united."""
    refs = reference_rows(entries, relations).withColumn("period", F.trunc("ref_at", "month"))
    verdicts = _verdicts(entries, refs)
    alive, dead = F.col("carried") > F.col("last"), F.col("spans").isNull() & F.coalesce(F.col("carried") <= F.col("first"), F.lit(True))
    verdicts = verdicts.withColumn("all_orphans", F.when(alive, F.lit(False)).when(dead, F.lit(True)))
    folded = refs.groupBy("relation", "target_id", "period").agg(F.count("*").alias("n"))
    folded = folded.join(verdicts.select("target_id", "period", "all_orphans", F.lit(True).alias("_named")), ["target_id", "period"], "left")
    whole = folded.filter(F.col("_named").isNull() | F.col("all_orphans").isNotNull())  # without a time all are orphans
    counted = whole.select("relation", "period", "n", F.when(F.coalesce("all_orphans", F.lit(True)), F.col("n")).otherwise(0).alias("orphans"))
    mixed = verdicts.filter("all_orphans IS NULL")
    hot = heavy_keys(mixed.groupBy("target_id").agg(F.sum("n").alias("n")), "target_id")
    single = _join_verdicts(refs, mixed, hot, how="inner").select("relation", "period", F.lit(1).cast("long").alias("n"), F.when(_alive(), 0).otherwise(1).cast("long").alias("orphans"))
    sums = counted.unionByName(single).groupBy("relation", "period").agg(F.sum("n").alias("n_refs"), F.sum("orphans").alias("n_orphans"))
    return sums.select("relation", F.date_format("period", "yyyy-MM").alias("month"), "n_refs", "n_orphans")
