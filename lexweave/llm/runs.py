"""Sorted runs: range partitioning, external sort, scan of adjacent rows, and stitching of runs that cross partitions.

Rows are range-partitioned and sorted by (key, second key). The second key splits even a key that holds a third of all
rows over many partitions, so no task ever holds a whole group. A scan over sorted Arrow batches compares full keys of
neighbours. Only the first and the last run of a partition can go on elsewhere: these, two rows a partition, are put
together by a window over as many rows as there are partitions, twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.common import durable

_COPIES = "part int, edge int, key string, first_id long, row_id long, n long"


def _starts(keys: pa.Array, before: str | None, any_before: bool) -> np.ndarray:
    """For each row, whether its key differs from the row before it."""
    out = np.ones(len(keys), bool)
    if len(keys) > 1:
        out[1:] = ~pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    if len(keys) and any_before:
        out[0] = keys[0].as_py() != before
    return out


def _scan_copies(batches: Iterator[pa.RecordBatch], every_run: bool) -> Iterator[pa.RecordBatch]:
    """Edges 1 and 2: first and last run of the partition. 0: a copy (or, with every_run, a run inside the partition) that
    is complete here. 3: a row of the first run, whose first id may lie in an earlier partition."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("key", pa.string()), ("first_id", pa.int64()), ("row_id", pa.int64()), ("n", pa.int64())])

    def rows(edge, first, row, n, key=None):
        size = len(first)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, part, np.int32)), pa.array(np.full(size, edge, np.int32)), pa.array([key] * size, pa.string()) if key is not None else pa.nulls(size, pa.string()), pa.array(first, pa.int64()), pa.array(row, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    key, first, count, runs, head = None, 0, 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        start = _starts(keys, key, runs > 0)
        at = np.flatnonzero(start)
        which = np.cumsum(start)  # 0: goes on with the run before this batch
        firsts = np.concatenate(([first], ids[at]))
        lengths = np.diff(np.concatenate(([0], at, [len(ids)])))
        if runs == 0:
            which_all = which
        else:
            which_all = which + runs
        if not every_run:
            in_head = which_all == 1
            if in_head.any():
                yield rows(3, firsts[which[in_head]], ids[in_head], np.zeros(in_head.sum(), np.int64))
            copy = ~start & ~in_head
            if copy.any():
                yield rows(0, firsts[which[copy]], ids[copy], np.zeros(copy.sum(), np.int64))
        # runs that end inside this batch: the one carried over, and all but the last that begin here
        if len(at):
            ended_first, ended_n = firsts[:-1], lengths[:-1].copy()
            ended_n[0] += count
            if runs == 0:
                ended_first, ended_n = ended_first[1:], ended_n[1:]
            if len(ended_first) and head is None:
                head = (keys[at[0]].as_py() if runs == 0 else key, int(ended_first[0]), int(ended_n[0]))
                ended_first, ended_n = ended_first[1:], ended_n[1:]
            if every_run and len(ended_first):
                yield rows(0, ended_first, ended_first, ended_n)
            runs += len(at)
            key, first, count = keys[at[-1]].as_py(), int(ids[at[-1]]), int(lengths[-1])
        else:
            count += len(ids)
    if head:
        yield rows(1, [head[1]], [head[1]], [head[2]], head[0])
    if runs:
        yield rows(2, [first], [first], [count], key)


def _stitched(edges: DataFrame) -> DataFrame:
    """Edge runs, two a partition, with the first id and the length of the whole run they belong to."""
    order = Window.orderBy("part", "edge")
    e = edges.withColumn("new", F.when(F.col("key").eqNullSafe(F.lag("key").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1))
    e = e.withColumn("run", F.sum("new").over(order))
    whole = Window.partitionBy("run")
    return e.withColumn("run_first", F.min("first_id").over(whole)).withColumn("run_n", F.sum("n").over(whole))


def _sorted(df: DataFrame, *by: str) -> DataFrame:
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def copies(records: DataFrame) -> DataFrame:
    """(first_id, copy_id) of records(key string, row_id long): one row for each record but the first of its key. Rows
    with a null key are left out. Ids must be unique within a key."""
    scanned = durable(_sorted(records.filter("key IS NOT NULL").select("key", "row_id"), "key", "row_id").mapInArrow(lambda it: _scan_copies(it, False), _COPIES))
    edges = _stitched(scanned.filter("edge IN (1, 2)").select("part", "edge", "key", "first_id", "n"))
    # The first run of a partition is its edge 1, or edge 2 where the partition holds one run only.
    heads = edges.withColumn("_k", F.row_number().over(Window.partitionBy("part").orderBy("edge"))).filter("_k = 1").select("part", "run_first")
    inner = scanned.filter("edge = 0").select("first_id", F.col("row_id").alias("copy_id"))
    crossing = scanned.filter("edge = 3").join(F.broadcast(heads), "part").filter("row_id > run_first").select(F.col("run_first").alias("first_id"), F.col("row_id").alias("copy_id"))
    return inner.unionByName(crossing)


def collapsed(records: DataFrame) -> DataFrame:
    """(first_id, copies): one row per key with the number of its records."""
    scanned = durable(_sorted(records.filter("key IS NOT NULL").select("key", "row_id"), "key", "row_id").mapInArrow(lambda it: _scan_copies(it, True), _COPIES))
    edges = _stitched(scanned.filter("edge IN (1, 2)").select("part", "edge", "key", "first_id", "n")).groupBy("run").agg(F.min("run_first").alias("first_id"), F.first("run_n").alias("copies"))
    return scanned.filter("edge = 0").select("first_id", F.col("n").alias("copies")).unionByName(edges.select("first_id", "copies"))


def _fold(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Sums weights of equal (term, doc) pairs of a partition, block by block, before anything is shuffled."""
    held: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(held).group_by(["term", "doc"]).aggregate([("weight", "sum")])
        t = t.select(["term", "doc", "weight_sum"]).rename_columns(["term", "doc", "weight"]).combine_chunks()
        return t.to_batches(max_chunksize=20_000)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _scan_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (term, doc, weight) to (term, total, docs, edge): edge marks a run that may go on in another partition."""
    schema = pa.schema([("term", pa.string()), ("total", pa.int64()), ("docs", pa.int64()), ("edge", pa.bool_())])
    term, total, docs, last_doc, runs = None, 0, 0, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        terms, doc, weight = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        start = _starts(terms, term, runs > 0)
        has = doc.is_valid().to_numpy(zero_copy_only=False)
        d = doc.fill_null(-1).to_numpy(zero_copy_only=False)
        new_doc = np.ones(len(d), bool)
        new_doc[1:] = d[1:] != d[:-1]
        new_doc[0] = last_doc is None or d[0] != last_doc
        new_doc = (new_doc | start) & has
        at = np.flatnonzero(start)
        cuts = np.concatenate(([0], at))
        sums = np.add.reduceat(np.append(weight, 0), cuts) if len(weight) else weight
        counts = np.add.reduceat(np.append(new_doc.astype(np.int64), 0), cuts)
        if len(at) and at[0] == 0:
            sums[0] = counts[0] = 0
        total, docs = total + int(sums[0]), docs + int(counts[0])
        if len(at):
            names = [term] + [terms[int(i)].as_py() for i in at[:-1]]
            totals, n_docs = np.concatenate(([total], sums[1:-1])), np.concatenate(([docs], counts[1:-1]))
            edge = np.zeros(len(names), bool)
            if runs == 0:
                names, totals, n_docs, edge = names[1:], totals[1:], n_docs[1:], edge[1:]
                if len(edge):
                    edge[0] = True
            elif runs == 1:
                edge[0] = True
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(totals, pa.int64()), pa.array(n_docs, pa.int64()), pa.array(edge)], schema=schema)
            runs += len(at)
            term, total, docs = terms[int(at[-1])].as_py(), int(sums[-1]), int(counts[-1])
        last_doc = int(d[-1]) if has[-1] else None
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array([term], pa.string()), pa.array([total], pa.int64()), pa.array([docs], pa.int64()), pa.array([True])], schema=schema)


def term_runs(pairs: DataFrame) -> DataFrame:
    """(term, total, docs) of pairs(term string, doc long, weight long). A null doc adds to the total only."""
    folded = pairs.select("term", "doc", "weight").mapInArrow(_fold, "term string, doc long, weight long")
    scanned = _sorted(folded, "term", "doc").mapInArrow(_scan_terms, "term string, total long, docs long, edge boolean")
    scanned = durable(scanned)
    edges = scanned.filter("edge").groupBy("term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))
    return scanned.filter("NOT edge").select("term", "total", "docs").unionByName(edges)
