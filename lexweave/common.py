"""Helpers shared by all operators: durable cuts of lineage, size-checked joins, id normalisation."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Every character for which Python's str.isspace holds.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_written: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, so that a lost executor costs no recomputation of
    what came before. The table is removed at the end of the :func:`scope` it was written in, else by :func:`release` or when
    the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(kept: int = 0) -> None:
    """Remove the tables written by :func:`durable`, all but the first ``kept``."""
    while len(_written) > kept:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def durable_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives as a :func:`durable` table; those that ``make`` wrote on the way are removed once it is there."""
    before = len(_written)
    out = durable(make())
    last = _written.pop()
    release(before)
    _written.append(last)
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Tables written by :func:`durable` inside are removed at the end: for sessions that run many queries. What they give
    has to be written or collected inside."""
    before = len(_written)
    try:
        yield
    finally:
        release(before)


atexit.register(release)


def py_strip(c: Column) -> Column:
    """Python's ``str.strip()``."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def norm_id(c: Column) -> Column:
    """Ids and sources compare without surrounding white space and letter case."""
    return F.lower(py_strip(c))


def non_blank(c: Column) -> Column:
    return c.isNotNull() & (py_strip(c) != "")


def partitions_for(df: DataFrame, at_least: int = 1) -> int:
    """Partitions of a wide step: the session's shuffle partitions."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(counts: DataFrame, key: str, n: str = "n", share: float = 0.01) -> list:
    """Keys holding at least ``share`` of all rows, from pre-aggregated counts: never more than 1/share keys. Null, which no
    equi-join matches, is none."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    if not total:
        return []
    return [r[0] for r in counts.filter(F.col(key).isNotNull() & (F.col(n) >= F.lit(max(2.0, share * total)))).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "left", rows_per_key: int | None = 1,
               broadcast_rows: int = 200_000, salts: int = 16) -> DataFrame:
    """Equi-join on ``key`` that keeps hot keys of ``left`` out of the shuffle.

    ``heavy`` are the hot keys (bounded by :func:`heavy_keys`). Their rows of ``right`` are counted first and broadcast if
    there are at most ``broadcast_rows``; beyond that both sides are salted. All other keys take an ordinary shuffle join.
    """
    if not heavy:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(heavy)
    hot_right = right.filter(is_hot)
    cold = left.filter(~is_hot | F.col(key).isNull()).join(right.filter(~is_hot), key, how)
    bounded = rows_per_key is not None and rows_per_key * len(heavy) <= broadcast_rows
    if bounded or hot_right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot = left.filter(is_hot).join(F.broadcast(hot_right), key, how)
    else:
        salted = left.filter(is_hot).withColumn("_salt", (F.rand(7) * salts).cast("int"))
        spread = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hot = salted.join(spread, [key, "_salt"], how).drop("_salt")
    return cold.unionByName(hot)


def per_worker(key: object, build):
    """What ``build`` makes, once per Python worker process: tables compiled for one task serve the next ones too."""
    kept = sys.modules.setdefault("_per_worker_tables", types.ModuleType("_per_worker_tables")).__dict__.setdefault("kept", {})
    if key not in kept:
        if len(kept) > 16:
            kept.clear()
        kept[key] = build()
    return kept[key]
