"""Merging glossaries: an ordered fold of updates into a base.

Updates act on each other only if a chain of shared terms or ids links them, so each such component is folded on its own.
The default mode re-indexes an entity at once when an update takes its place; ``compat`` keeps a stale index and a doubled
append, effects that cross components, and therefore folds everything on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, durable_alone, partitions_for
from lexweave.functions.text import EDGE_CHARS

ON_MATCH = ("skip", "merge-synonyms", "replace")
ON_CONFLICT = ("keep-base", "keep-update", "report")
RELATIONS = "map<string,array<string>>"  # folds carry them along unread, as JSON: Python takes long to make maps
MERGED = "side int, pos long, part int, id string, label string, synonyms array<string>, relations string, definition string, source string"
ROWS_AT_ONCE = 10_000  # rows of the table that folds give at once
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINKED_AT_ONCE = 1_000_000  # linked entities whose components, two numbers each, are broadcast
EDGES_AT_ONCE = 4_000_000  # edges whose components one task finds: some 200 MB there
OUTCOME_ONLY = ("kind", "conflict_type", "message", "base_id", "update_id", "raw_data")
OUTCOME = MERGED + ", kind string, conflict_type string, message string, base_id string, update_id string, raw_data string"


@dataclass(frozen=True)
class MergePolicy:
    on_match: str = "merge-synonyms"
    on_conflict: str = "report"

    def __post_init__(self) -> None:
        if self.on_match not in ON_MATCH or self.on_conflict not in ON_CONFLICT:
            raise ValueError(f"unknown policy {self.on_match!r}, {self.on_conflict!r}")


def canonical(s: str) -> str:
    return " ".join(s.lower().replace("ё", "е").split()).strip(EDGE_CHARS)


class _Synonyms:
    """Synonyms of an entity that updates are merged into, by place. Each merge makes all of them canonical again; only loose
    ones, which that still changes, are looked at, so that a merge costs what comes in and not what is there."""

    __slots__ = ("own", "at", "place_of", "loose", "next")

    def __init__(self, label: str, synonyms: list[str]) -> None:
        self.own, self.at, self.place_of = canonical(label), dict(enumerate(synonyms)), {}
        self.loose, self.next = list(self.at), len(synonyms)

    def merge(self, synonyms: list[str]) -> tuple[set[str], set[str]]:
        """Terms that go from the entity and terms that come to it."""
        old, placed, fixed = [], [], set()
        for p in self.loose:
            s = self.at.pop(p)
            if self.place_of.get(s) == p:
                del self.place_of[s]
            old.append((p, canonical(s)))
        new = [(self.next + k, canonical(s)) for k, s in enumerate(synonyms)]
        self.next += len(new)
        for p, t in [*old, *new]:
            q = self.place_of.get(t, p)
            if t and t != self.own and q >= p:
                if q > p:
                    del self.at[q]
                self.at[p], self.place_of[t] = t, p
                placed.append((p, t, canonical(t)))
                if t == placed[-1][2]:
                    fixed.add(t)
        self.loose = [p for p, t, again in placed if t != again]
        come = {again for _, _, again in placed if again}
        gone = {t for _, t in old if t and t != self.own and t not in come and not (t in self.place_of and t == canonical(t))}
        return gone, come

    def terms(self) -> set[str]:
        return {t for t in (self.own, *map(canonical, self.at.values())) if t}

    def listed(self) -> list[str]:
        return [self.at[p] for p in sorted(self.at)]


class _Glossary:
    """Entities by place, with who owns an id and who is found under a term. What an update costs doesn't grow with what
    was merged before."""

    def __init__(self, policy: MergePolicy, compat: bool) -> None:
        self.policy, self.compat = policy, compat
        self.rows: list[dict] = []
        self.at: dict[str, int] = {}
        self.under: dict[str, int | set[int]] = {}  # nearly all terms have one place, and a set takes much room
        self.synonyms: dict[int, _Synonyms] = {}
        self.free: dict[str, int] = {}  # ids stay, so the first free number of an id only rises
        self.stale: dict[int, set[str]] = {}

    @staticmethod
    def terms(e: dict) -> set[str]:
        return {t for t in map(canonical, [e["label"], *e["synonyms"]]) if t}

    def held(self, place: int) -> set[str]:
        return self.synonyms[place].terms() if place in self.synonyms else self.terms(self.rows[place])

    def link(self, terms: Iterable[str], place: int) -> None:
        for t in terms:
            x = self.under.setdefault(t, place)
            if isinstance(x, set):
                x.add(place)
            elif x != place:
                self.under[t] = {x, place}

    def unlink(self, terms: Iterable[str], place: int) -> None:
        for t in terms:
            x = self.under.get(t)
            if isinstance(x, set):
                x.discard(place)
            elif x == place:
                del self.under[t]

    def matched(self, terms: Iterable[str]) -> list[str]:
        """Ids found under an update's terms; two tell enough where they aren't reported."""
        ids: set[str] = set()
        for t in terms:
            x = self.under.get(t, ())
            for p in (x,) if isinstance(x, int) else x:
                ids.add(self.rows[p]["id"])
                if len(ids) > 1 and self.policy.on_conflict != "report":
                    return sorted(ids)
        return sorted(ids)

    def add(self, e: dict, terms: Iterable[str], fresh_id: bool) -> None:
        if fresh_id and e["id"] in self.at:
            k = self.free.get(e["id"], 2)
            while f"{e['id']}_{k}" in self.at:
                k += 1
            self.free[e["id"]] = k
            e = e | {"id": f"{e['id']}_{k}"}
        self.at[e["id"]] = len(self.rows)
        self.rows.append(e)
        self.link(terms, len(self.rows) - 1)

    def put(self, place: int, e: dict, reindex: bool) -> None:
        old = self.held(place)
        self.synonyms.pop(place, None)
        self.rows[place] = {**e, "order": self.rows[place]["order"]}
        self.at.setdefault(e["id"], place)
        if reindex:
            self.unlink(old, place)
            self.link(self.terms(e), place)
        else:
            self.stale.setdefault(place, old)

    def rebuild(self) -> None:
        for place, old in self.stale.items():
            self.unlink(old, place)
            self.link(self.held(place), place)
        self.stale.clear()

    def merge(self, place: int, u: dict) -> None:
        old = self.rows[place]
        if place not in self.synonyms:
            self.synonyms[place] = _Synonyms(old["label"], old["synonyms"])
        gone, come = self.synonyms[place].merge([*u["synonyms"], u["label"]])
        self.unlink(gone, place)
        self.link(come, place)
        self.rows[place] = old | {"definition": old["definition"] or u["definition"], "source": old["source"] or u["source"]}

    def update(self, u: dict) -> tuple[str, dict | None]:
        """What came of the update, and its conflict."""
        on_match, on_conflict = self.policy.on_match, self.policy.on_conflict
        owner = self.at.get(u["id"])
        clash = owner is not None and canonical(self.rows[owner]["label"]) != canonical(u["label"])
        terms = () if clash else self.terms(u)
        matched = self.matched(terms)
        if clash or len(matched) > 1:
            if on_conflict == "report":
                if clash:
                    told = ("id_label_mismatch", "Update entity ID already exists with a different label", self.rows[owner]["id"], {"base_label": self.rows[owner]["label"], "update_label": u["label"]})
                else:
                    told = ("ambiguous_term_match", "Update term matches multiple base entities", None, {"matched_ids": matched, "candidate_label": u["label"]})
                return "skipped", dict(zip(("conflict_type", "message", "base_id"), told)) | {"update_id": u["id"], "raw_data": told[3], "order": u["order"]}
            if on_conflict == "keep-base":
                return "skipped", None
            if clash:
                self.put(owner, u, reindex=not self.compat)
                return "updated", None
            for part in range(2 if self.compat else 1):
                self.add(u | {"order": (*u["order"][:2], part)}, terms, fresh_id=True)
            return "added", None
        if not matched:
            self.add(u, terms, fresh_id=True)
            return "added", None
        if on_match == "skip":
            return "skipped", None
        self.rebuild()
        if on_match == "replace":
            self.put(self.at[matched[0]], u, reindex=True)
        else:
            self.merge(self.at[matched[0]], u)
        return "updated", None

    def merged(self) -> Iterable[dict]:
        for place, e in enumerate(self.rows):
            yield e | {"synonyms": self.synonyms[place].listed()} if place in self.synonyms else e


def fold(base: Iterable[dict], updates: Iterable[dict], policy: MergePolicy, compat: bool = False) -> tuple[list[dict], list[dict], list[dict]]:
    """(merged, conflicts, outcomes). Entities are dicts with id, label, synonyms, relations, definition, source, order."""
    g, conflicts, outcomes = _Glossary(policy, compat), [], []
    for e in base:
        g.add(e, g.terms(e), fresh_id=False)
    for u in updates:
        kind, conflict = g.update(u)
        outcomes.append({"kind": kind, "order": u["order"]})
        if conflict:
            conflicts.append(conflict)
    return list(g.merged()), conflicts, outcomes


def _tagged(entities: DataFrame, side: int) -> DataFrame:
    relations = F.to_json(F.coalesce("relations", F.create_map().cast(RELATIONS)))
    return entities.select(F.lit(side).alias("side"), F.col("entity_pos").alias("pos"), "id", "label", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), relations.alias("relations"), "definition", "source")


def _node() -> Column:
    return F.col("pos") * 2 + F.col("side")


def _term(c: Column) -> Column:
    """``canonical_term`` by one table of characters, as patterns take most of the time of this many terms."""
    t = F.btrim(F.translate(F.lower(c), SPACES + "ё", " " * len(SPACES) + "е"))
    return F.btrim(F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " +", " ")).otherwise(t), F.lit(EDGE_CHARS))


def components(rows: DataFrame) -> DataFrame:
    """(node, component) of the entities that others are linked to by a shared canonical term, id, or id without a number at
    its end. A key that no update has links nothing, as entities of the base don't act on each other. Keys are hashes: two
    that fall together link what doesn't act on each other, which folds to the same. A key that links a third of all rows
    is folded map-side. Up to EDGES_AT_ONCE edges go to one task, more are spread over (``_spread``)."""
    each = rows.select(_node().alias("node"), F.posexplode(F.concat(F.array("id", "label"), "synonyms")).alias("n", "s"))
    key = F.when(F.col("n") == 0, F.concat(F.lit("i:"), F.regexp_replace("s", r"(?:_\d+)+$", ""))).otherwise(F.concat(F.lit("t:"), F.coalesce(_term(F.col("s")), F.lit(""))))
    # Hashed before the empty ones go, as a filter on the text would make it a second time.
    every = durable(each.select("node", F.xxhash64(key).alias("key"))).filter(F.col("key") != F.xxhash64(F.lit("t:")))
    first = every.groupBy("key").agg(F.min("node").alias("to"), F.max(F.col("node") % 2).alias("met")).filter("met <> 0").select("key", "to")
    edges = durable(every.join(first, "key").filter("node <> to").select("node", "to"))
    if edges.count() > EDGES_AT_ONCE:
        return _spread(edges)
    return durable(edges.coalesce(1).mapInPandas(_joined, "node long, component long"))


def _joined(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest node of each node's component. Roots take over smaller roots that an edge leads to, and chains are cut short,
    until none changes."""
    tables = list(batches)
    if not tables:
        return
    table = pd.concat(tables)
    names, ends = np.unique(table.to_numpy(np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(names))
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (far := new[new]).tobytes() != new.tobytes():
            new = far
        root, apart = new, new[a] != new[b]
        a, b = a[apart], b[apart]
    for k in range(0, len(names), 100_000):
        yield pd.DataFrame({"node": names[k : k + 100_000], "component": names[root[k : k + 100_000]]})


def _spread(edges: DataFrame) -> DataFrame:
    """The same for any number of edges. Smallest labels spread over the edges, and labels of labels are taken over, until
    none changes: labels only fall, so that ends however long the chains are."""
    both = durable(edges.unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to"))))
    labels = both.select("node", F.col("node").alias("c")).distinct()
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), "c"), "to").groupBy("node").agg(F.min("c").alias("k"))
        jump = labels.select(F.col("node").alias("k"), F.col("c").alias("far"))
        new = labels.join(near, "node").withColumn("k", F.least("c", "k")).join(jump, "k").select("node", F.least("k", "far").alias("n"), "c")
        new = durable(new)
        done = new.filter("n < c").limit(1).count() == 0
        labels = new.select("node", F.col("n").alias("c"))
        if done:
            return labels.withColumnRenamed("c", "component")


def _dicts(pdf: pd.DataFrame) -> Iterator[dict]:
    text = lambda x: None if x is None or x != x else x
    for side, pos, i, label, synonyms, relations, definition, source in zip(*(pdf[c].tolist() for c in ("side", "pos", "id", "label", "synonyms", "relations", "definition", "source"))):
        yield {"id": i, "label": label, "synonyms": [s for s in synonyms if s is not None], "relations": relations, "definition": text(definition), "source": text(source), "order": (side, pos, 0)}


def _rows(entities: Iterable[dict], policy: MergePolicy, compat: bool) -> Iterator[tuple]:
    """What the fold of these entities in order gives, as rows of OUTCOME: of updates as they come, entities at the end."""
    g, none = _Glossary(policy, compat), (None,) * 6
    for e in entities:
        if not e["order"][0]:
            g.add(e, g.terms(e), fresh_id=False)
            continue
        kind, c = g.update(e)
        yield (*e["order"], *none, kind, *none[1:])
        if c:
            yield (*e["order"], *none, "conflict", c["conflict_type"], c["message"], c["base_id"], c["update_id"], json.dumps(c["raw_data"], ensure_ascii=False, sort_keys=True))
    for e in g.merged():
        yield (*e["order"], e["id"], e["label"], e["synonyms"], e["relations"], e["definition"], e["source"], "entity", *none[1:])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series(x, dtype=object) for c, x in zip(OUTCOME.split(", "), zip(*rows))})


def merge_glossaries(base: DataFrame, updates: DataFrame, policy: MergePolicy = MergePolicy(), compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, conflicts, summary). ``merged`` keeps the base's order, then the order of the updates that were appended
    (side, pos, part). ``summary`` is one row: added, updated, skipped, conflicts. Entities without an id or a label raise."""
    rows = _tagged(base, 0).unionByName(_tagged(updates, 1))
    if rows.filter("id IS NULL OR label IS NULL").limit(1).count():
        raise ValueError("an entity needs an id and a label")
    if compat:
        out = base.sparkSession.createDataFrame(list(_rows(sorted(_dicts(rows.toPandas()), key=itemgetter("order")), policy, True)), OUTCOME)
    else:
        out = durable_alone(lambda: _folded(rows, policy))
    merged = out.filter("kind = 'entity'").select("side", "pos", "part", "id", "label", "synonyms", F.from_json("relations", RELATIONS).alias("relations"), "definition", "source")
    conflicts = out.filter("kind = 'conflict'").select("pos", "conflict_type", "message", "base_id", "update_id", "raw_data")
    n = lambda k: F.count_if(F.col("kind") == k)
    summary = out.agg(n("added").alias("added"), n("updated").alias("updated"), n("skipped").alias("skipped"), n("conflict").alias("conflicts"))
    return merged, conflicts, summary


def _folded(rows: DataFrame, policy: MergePolicy) -> DataFrame:
    """Rows of OUTCOME. What meets nothing stays or is added as it is; only what acts on each other is folded, a component at
    a time."""

    def placed() -> DataFrame:
        found = components(rows)
        few = found.count() <= LINKED_AT_ONCE
        return rows.withColumn("node", _node()).join(F.broadcast(found) if few else found, "node", "left").drop("node")

    parts = durable_alone(placed)
    own = [c for c in rows.columns if c not in ("side", "pos")]
    single = parts.filter("component IS NULL").select("side", "pos", F.lit(0).alias("part"), *own, *[F.lit(None).cast("string").alias(c) for c in OUTCOME_ONLY])
    added = single.filter("side = 1").select("side", "pos", "part", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in own], *OUTCOME_ONLY)
    linked = parts.filter("component IS NOT NULL").repartition(partitions_for(rows), "component").sortWithinPartitions("component", "side", "pos")
    return linked.mapInPandas(_folds(policy, in_order=True), OUTCOME).unionByName(single.withColumn("kind", F.lit("entity"))).unionByName(added.withColumn("kind", F.lit("added")))


def _folds(policy: MergePolicy, in_order: bool = False):
    """Folds of components whose rows come together. ``in_order``: by side and place, so that updates which go into others
    needn't be held. What they give goes out together, as most components are a few entities and a table of each would cost
    far more than its fold."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        every = ((c, e) for pdf in batches for c, e in zip(pdf["component"].tolist(), _dicts(pdf)))
        for _, group in groupby(every, key=itemgetter(0)):
            entities = (e for _, e in group)
            for row in _rows(entities if in_order else sorted(entities, key=itemgetter("order")), policy, False):
                out.append(row)
                if len(out) >= ROWS_AT_ONCE:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)

    return run
