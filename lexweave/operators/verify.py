"""Terms against a glossary: exactly by label, or by similarity."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.common import SPACE_CLASS, durable, heavy_keys, per_worker, split_join
from lexweave.functions.similarity import ratio, sort_tokens
from lexweave.functions.similarity import scorer as scorer_named
from lexweave.operators.glossary import first_entities, glossary_index

BOUNDED = {"ratio", "token_sort_ratio", "QRatio"}
BEST = "q string, s double, p long, k string"


def verify_exact(terms: DataFrame, entities: DataFrame, cut: bool = True) -> DataFrame:
    """Adds entity_pos, entity_id, entity_label, confidence, status, matched_synonym.

    A document's texts and lemmas retrieve the first entity under each; those entities count by their label only. A term
    whose text is such a label is MATCHED with confidence 1, one whose lemma is with 0.5, others are UNKNOWN. Of several
    retrieved entities with one label the first counts. So a synonym alone never matches. Equi-joins only; the glossary
    side is broadcast where Spark measures it below its limit. The terms are read twice, so their plan is cut by a durable
    table first, unless ``cut`` is false (terms that are a table already).
    """
    terms = durable(terms) if cut else terms
    firsts = first_entities(glossary_index(entities)).select("term", "entity_pos")
    names = entities.select("entity_pos", F.lower("label").alias("label"))
    asked = terms.select("doc_id", F.explode(F.array(F.lower("text"), F.lower("lemma"))).alias("term")).distinct()
    found = asked.join(firsts, "term").join(names, "entity_pos").groupBy("doc_id", "label").agg(F.min("entity_pos").alias("entity_pos"))
    by = lambda c, p: found.select(F.col("doc_id").alias(f"_d{p}"), F.col("label").alias(f"_l{p}"), F.col("entity_pos").alias(f"_e{p}"))
    a, b = by("text", 1), by("lemma", 2)
    rows = terms.join(a, (F.col("doc_id") == F.col("_d1")) & (F.lower("text") == F.col("_l1")), "left")
    rows = rows.join(b, (F.col("doc_id") == F.col("_d2")) & (F.lower("lemma") == F.col("_l2")), "left")
    one, half = F.col("_e1").isNotNull(), F.col("_e2").isNotNull()
    rows = rows.withColumns(
        {
            "entity_pos": F.coalesce("_e1", "_e2"),
            "confidence": F.when(one, 1.0).when(half, 0.5).otherwise(0.0),
            "status": F.when(one | half, "MATCHED").otherwise("UNKNOWN"),
            "matched_synonym": F.when(one, F.col("text")).when(half, F.col("lemma")),
        }
    ).drop("_d1", "_l1", "_e1", "_d2", "_l2", "_e2")
    return _with_entity(rows, entities)


def _with_entity(rows: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select(F.col("entity_pos"), F.col("id").alias("entity_id"), F.col("label").alias("entity_label"))
    return rows.join(names, "entity_pos", "left")


class Matcher:
    """Best key of a query among some keys. For scorers that the common letters bound, only keys whose length may do are
    looked at, those that can't reach the threshold are left out, and the others come in the order of the bound and scoring
    stops once no bound can win, so the answer is that of all pairs without scoring them."""

    def __init__(self, keys: list[tuple[int, str]], name: str, threshold: float) -> None:
        self.threshold, self.score, self.bounded = threshold, scorer_named(name), name in BOUNDED
        self.prepare = sort_tokens if name == "token_sort_ratio" else (lambda s: s)
        ready = sorted((len(r := self.prepare(k)), p, k, r) for p, k in keys)
        self.keys, self.ready = [(p, k) for _, p, k, _ in ready], [r for *_, r in ready]
        self.exact: dict[str, int] = {}
        for i, k in enumerate(self.ready):
            self.exact.setdefault(k, i)
        if self.bounded:
            self.plain = ratio if name == "token_sort_ratio" else self.score
            self._count_letters()

    def _count_letters(self) -> None:
        n = len(self.ready)
        self.lengths = np.array([len(k) for k in self.ready], np.int64)
        self.runs, self.begins = np.unique(self.lengths, return_index=True)  # keys of one length are neighbours
        # No count of common letters exceeds the key's length: bytes do unless a key is longer than they count.
        self.kind = np.uint8 if not n or self.lengths[-1] < 256 else np.int64
        codes = np.frombuffer("".join(self.ready).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, place = np.unique(codes, return_inverse=True)
        self.column = {chr(c): i for i, c in enumerate(letters.tolist())}
        counts = np.bincount(place * n + np.repeat(np.arange(n), self.lengths), minlength=len(letters) * n)
        self.counts = counts.astype(self.kind).reshape(len(letters), n)
        self.windows: dict[int, tuple[int, int, np.ndarray]] = {}

    def _window(self, size: int) -> tuple[int, int, np.ndarray]:
        """(begin, end, letters needed) of the keys that a query of this many letters may match."""
        if size not in self.windows:
            total = np.maximum(1, self.runs + size)
            need = np.array([next((c for c in range(max(0, int(self.threshold * t / 200) - 1), t + 1) if 200.0 * c / t >= self.threshold), t + 1) for t in total.tolist()], np.int64)
            fits = np.flatnonzero(need <= np.minimum(self.runs, size))
            if not fits.size:
                self.windows[size] = 0, 0, self.lengths[:0]
            else:
                ends = np.append(self.begins[1:], len(self.ready))
                a, z = int(self.begins[fits[0]]), int(ends[fits[-1]])
                held = slice(fits[0], fits[-1] + 1)
                self.windows[size] = a, z, np.repeat(need[held], (ends - self.begins)[held]).astype(self.kind)
        return self.windows[size]

    def best(self, query: str) -> tuple[float, int, str] | None:
        if not self.keys:
            return None
        if not self.bounded:
            found = max(((self.score(query, k), -p, k) for p, k in self.keys), default=None)
            return (found[0], -found[1], found[2]) if found and found[0] >= self.threshold else None
        ready = self.prepare(query)
        hit = self.exact.get(ready)
        if hit is not None and ready:
            return 100.0, *self.keys[hit]
        a, z, need = self._window(len(ready))
        if a == z:
            return None
        common, most = np.zeros(z - a, self.kind), np.iinfo(self.kind).max
        for c, m in Counter(ready).items():
            if c in self.column:
                common += np.minimum(self.counts[self.column[c], a:z], self.kind(min(m, most)))
        places = np.flatnonzero(common >= need)
        bound = 200.0 * common[places] / np.maximum(1, self.lengths[a:z][places] + len(ready))
        order = np.argsort(-bound, kind="stable")
        best: tuple[float, int] | None = None
        for most_, i in zip(bound[order].tolist(), (places[order] + a).tolist()):
            if best and most_ < best[0]:
                break
            s = self.plain(ready, self.ready[i])
            if s >= self.threshold and (best is None or s > best[0] or s == best[0] and self.keys[i] < self.keys[best[1]]):
                best = s, i
        return (best[0], *self.keys[best[1]]) if best else None


def _scored(matcher: Matcher, queries: pa.Array) -> pa.RecordBatch:
    hits = [matcher.best(q) for q in queries.to_pylist()]
    columns = [queries, *[pa.array([h and h[k] for h in hits], t) for k, t in ((0, pa.float64()), (1, pa.int64()), (2, pa.string()))]]
    return pa.RecordBatch.from_arrays(columns, names=["q", "s", "p", "k"])


def _best(queries: DataFrame, keys: list[tuple[int, str]], name: str, threshold: float) -> DataFrame:
    """The best key of each query; the keys, whose number is bounded, go to the tasks with the code."""
    mark = zlib.crc32(repr((keys, name, threshold)).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = per_worker(("matcher", mark), lambda: Matcher(keys, name, threshold))
            yield _scored(m, b.column(0))

    return queries.mapInArrow(run, BEST)


def _ready(c: Column, name: str) -> Column:
    """What :class:`Matcher` compares of a text."""
    return F.array_join(F.array_sort(F.filter(F.split(c, f"{SPACE_CLASS}+"), lambda w: w != "")), " ") if name == "token_sort_ratio" else c


def _ranges(lengths: list[tuple[int, int]], keys_at_once: int) -> list[tuple[int, int, int]]:
    """(least, most, shards) of runs of neighbouring lengths with about ``keys_at_once`` keys together, or one length more."""
    out: list[list[int]] = []
    for length, n in sorted(lengths):
        if out and out[-1][2] + n <= keys_at_once:
            out[-1][1:] = [length, out[-1][2] + n]
        else:
            out.append([length, length, n])
    return [(a, z, -(-n // keys_at_once)) for a, z, n in out]


def _best_in_blocks(queries: DataFrame, keys: DataFrame, name: str, threshold: float, keys_at_once: int, queries_at_once: int) -> DataFrame:
    """The same for any number of keys: a grid of blocks, each of about ``keys_at_once`` keys and ``queries_at_once`` queries,
    that one task scores at a time; the winners of a query's blocks merge by a maximum. Only counts by length go through the
    driver. For scorers that the common letters bound, queries that equal a key are joined to it, and a query goes only to
    blocks that hold keys of a length that may do."""
    bounded, every = name in BOUNDED, lambda a, n: F.explode(F.sequence(a, a + n - 1))
    asked, exact = queries.select("_q"), None
    if bounded:
        keys = durable(keys.select("key_pos", "term", _ready(F.col("term"), name).alias("r")))
        firsts = keys.filter("r <> ''").groupBy("r").agg(F.min(F.struct("key_pos", "term")).alias("x"))
        met = durable(asked.withColumn("r", _ready(F.col("_q"), name)).join(firsts, "r", "left"))
        exact = met.filter("x IS NOT NULL").select(F.col("_q").alias("q"), F.lit(100.0).alias("s"), F.col("x.key_pos").alias("p"), F.col("x.term").alias("k")).filter(F.col("s") >= threshold)
        asked = met.filter("x IS NULL").select("_q", F.length("r").alias("size"))
        keys = keys.withColumn("size", F.length("r"))
    else:
        asked, keys = asked.withColumn("size", F.lit(0)), keys.withColumn("size", F.lit(0))
    by_size = lambda df: [tuple(r) for r in df.groupBy("size").agg(F.count("*")).collect()]
    ranges, sizes, parts, first = _ranges(by_size(keys), keys_at_once), by_size(asked), [], 0
    fits = lambda n, a, z: not bounded or 200.0 * min(n, m := min(max(n, a), z)) / max(1, n + m) >= threshold
    for a, z, shards in ranges:
        blocks = max(1, -(-sum(c for n, c in sizes if fits(n, a, z)) // queries_at_once))
        parts += [(a, z, n, first, shards, blocks) for n, _ in sizes if fits(n, a, z)] or [(a, z, -1, first, shards, 1)]
        first += shards
    grid = keys.sparkSession.createDataFrame(parts, "least int, most int, size int, first int, shards int, blocks int")
    asked = asked.join(F.broadcast(grid), "size").withColumn("shard", every(F.col("first"), F.col("shards")))
    asked = asked.select("_q", F.pmod(F.xxhash64("_q"), F.col("blocks")).cast("int").alias("block"), "shard")
    whole = grid.select("least", "most", "first", "shards", "blocks").distinct()
    held = keys.join(F.broadcast(whole), F.col("size").between(F.col("least"), F.col("most")))
    held = held.select("key_pos", "term", (F.col("first") + F.pmod(F.xxhash64("term"), F.col("shards"))).cast("int").alias("shard"), every(F.lit(0), F.col("blocks")).alias("block"))

    def run(mine: pa.Table, those: pa.Table) -> pa.Table:
        found = list(zip(those.column("key_pos").to_pylist(), those.column("term").to_pylist()))
        q = pa.array(mine.column("_q").to_pylist(), pa.string())
        return pa.Table.from_batches([_scored(Matcher(found if len(q) else [], name, threshold), q)])

    best = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(run, BEST).filter("s IS NOT NULL")
    best = best.groupBy("q").agg(F.max_by(F.struct("s", "p", "k"), F.struct("s", -F.col("p"))).alias("x")).select("q", "x.*")
    return best if exact is None else best.unionByName(exact)


def verify_fuzzy(terms: DataFrame, entities: DataFrame, threshold: float = 85, scorer: str = "token_sort_ratio", limit: int = 3, keys_at_once: int = 20_000, queries_at_once: int = 20_000) -> DataFrame:
    """Adds the columns of :func:`verify_exact`. A term's lemma, or else its text, is compared with all glossary terms; the
    best score of at least ``threshold`` makes it a NEAR_MATCH (at 100 too) with confidence score/100; equal scores go to
    the term that the glossary names first. ``limit`` never changes the answer. Empty queries are UNKNOWN.

    Distinct queries are scored once, and the winners kept in a durable table before they are joined back. The glossary's
    terms are counted first: up to ``keys_at_once`` go to the tasks with the code, more are scored in blocks (see
    :func:`_best_in_blocks`). Hot queries skip the shuffle of the join back.
    """
    scorer_named(scorer)
    q = F.coalesce(F.when(F.col("lemma") != "", F.col("lemma")), F.col("text"), F.lit(""))
    rows = terms.withColumn("_q", q)
    counts = durable(rows.filter("_q <> ''").groupBy("_q").agg(F.count("*").alias("n")))
    keys = first_entities(glossary_index(entities)).select("key_pos", "term")
    n_keys = keys.count()
    if n_keys <= keys_at_once:
        best = _best(counts.select("_q"), [tuple(r) for r in keys.collect()], scorer, threshold).filter("s IS NOT NULL")
    else:
        best = _best_in_blocks(counts.select("_q"), keys, scorer, threshold, keys_at_once, queries_at_once)
    best = best.select(F.col("q").alias("_q"), F.col("s").alias("_s"), F.floor(F.col("p") / F.lit(2**20)).cast("long").alias("entity_pos"), F.col("k").alias("_k"))
    best = durable(_with_entity(best, entities))  # a row of each distinct query, so no entity is hot here
    joined = split_join(rows, best, "_q", heavy_keys(counts, "_q"), "left")
    near = F.col("_s").isNotNull()
    return joined.withColumns(
        {
            "confidence": F.when(near, F.col("_s") / 100).otherwise(0.0),
            "status": F.when(near, "NEAR_MATCH").otherwise("UNKNOWN"),
            "matched_synonym": F.col("_k"),
        }
    ).select("entity_pos", *terms.columns, "confidence", "status", "matched_synonym", "entity_id", "entity_label")
