"""Parent-child links to full hierarchies (problem 2).

Each level contracts the chains inside every partition to their exits (the first node that the partition can't follow),
keeps of the contracted nodes only those that are exits of others (the quotient forest), solves that forest in the same
way and expands the fragments' paths with its answer. A coin per node puts a child beside its parent for a quarter of all
links at least, so chains of any shape shrink by a constant factor a level; once the forest fits one fragment, a single
task ends the recursion. The first level has as many fragments as the session has shuffle partitions, at least. The number
of levels is logarithmic, and nothing but row counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, heavy_keys, non_blank, norm_id, partitions_for, split_join

FRAGMENT_ROWS = 250_000


def declared_links(entries: DataFrame) -> DataFrame:
    """(child, parent), one row per child: links declared on either side between ids that have a row. Of several declared
    parents the smallest id counts. Null and blank ids, maps and arrays declare nothing."""
    me = norm_id(F.col("id"))
    listed = lambda k: F.filter(F.transform(F.try_element_at("relations", F.lit(k)), norm_id), non_blank)
    up = F.transform(listed("hyperonym"), lambda p: F.struct(me.alias("child"), p.alias("parent")))
    down = F.transform(listed("hyponym"), lambda c: F.struct(c.alias("child"), me.alias("parent")))
    rows = entries.filter(non_blank(F.col("id")))
    links = rows.select(F.explode(F.flatten(F.array_compact(F.array(up, down)))).alias("x")).select("x.child", "x.parent").groupBy("child", "parent").agg(F.count("*").alias("n"))
    ids = rows.select(me.alias("id")).groupBy("id").agg(F.count("*").alias("_rows"))
    known = ids.select(F.col("id").alias("parent")).join(links.select("parent").distinct(), "parent", "left_semi").withColumn("_known", F.lit(True))
    hot = heavy_keys(links.groupBy("parent").agg(F.count("*").alias("n")), "parent")
    with_parent = split_join(links, known, "parent", hot, "inner")
    return with_parent.groupBy("child").agg(F.min("parent").alias("parent")).join(ids.select(F.col("id").alias("child")), "child", "left_semi")


def _follow(child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For local links (unique children): position of the parent's own link or -1, the last link of each chain, hops to
    it, and whether the chain never ends. Doubling: log2(n) vector steps."""
    n = len(child)
    at = pd.Index(child).get_indexer(parent)
    jump, hops = np.where(at < 0, np.arange(n), at), (at >= 0).astype(np.int64)
    for _ in range(max(1, int(n).bit_length())):
        hops = hops + hops[jump]
        jump = jump[jump]
    return at, jump, hops, at[jump] >= 0


def _contract(batches: Iterator[pd.DataFrame], with_path: bool) -> Iterator[pd.DataFrame]:
    """Links (child, parent, hops, steps) of a partition to (child, exit, hops, looped, steps). ``steps`` lists the nodes
    between child and exit, nearest to the child first."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    pdf = pd.concat(parts, ignore_index=True)
    child, parent, weight = pdf["child"].to_numpy(object), pdf["parent"].to_numpy(object), pdf["hops"].to_numpy(np.int64)
    at, last, _, looped = _follow(child, parent)
    n = len(child)
    total, jump = weight.copy(), np.where(at < 0, -1, at)
    far = at.copy()
    for _ in range(max(1, int(n).bit_length())):
        ok = (far >= 0) & ~looped
        total[ok] += total[far[ok]]
        far[ok] = far[far[ok]]
    out = pd.DataFrame({"child": child, "exit": np.where(looped, child, parent[last]), "hops": np.where(looped, 0, total), "looped": looped})
    if not with_path:
        yield out
        return
    steps = pdf["steps"].to_list()
    for a in range(0, n, 5_000):
        block = out.iloc[a : a + 5_000].copy()
        paths = []
        for i in range(a, min(n, a + 5_000)):
            path: list[str] = []
            if not looped[i]:
                path.extend(steps[i])
                j = jump[i]
                while j >= 0:
                    path.append(child[j])
                    path.extend(steps[j])
                    j = jump[j]
            paths.append(path)
        block["steps"] = paths
        yield block


def solve(links: DataFrame, with_path: bool = False, fragment_rows: int = FRAGMENT_ROWS, level: int = 0, least: int = 1) -> DataFrame:
    """(node, root, depth, looped[, steps]) for every child of ``links(child, parent, hops, steps)``: ``root`` is the end
    of its chain, ``steps`` the nodes between, nearest first. A chain that runs into a cycle has ``looped`` true. This level has ``least`` fragments
    or more, those below as few as hold ``fragment_rows`` links each."""
    n = links.count()
    parts = max(1, min(n, least), -(-n // fragment_rows))
    if parts == 1:
        placed = links.coalesce(1)
    else:
        coin = lambda c: F.xxhash64(c, F.lit(level)) % 2 == 0
        crowded = heavy_keys(links.groupBy("parent").agg(F.count("*").alias("n")), "parent", share=0.25 / parts)
        beside = ~coin("child") & coin("parent")
        if crowded:
            beside = beside & ~F.col("parent").isin(crowded)
        placed = links.repartition(parts, F.when(beside, F.col("parent")).otherwise(F.col("child")))
    schema = "child string, exit string, hops long, looped boolean" + ", steps array<string>" * with_path
    contracted = placed.mapInPandas(lambda it: _contract(it, with_path), schema)
    steps = ["steps"] * with_path
    if parts == 1:
        return contracted.select(F.col("child").alias("node"), F.col("exit").alias("root"), F.col("hops").alias("depth"), "looped", *steps)
    contracted = durable(contracted)
    exits = contracted.filter("NOT looped").select(F.col("exit").alias("child")).distinct()
    quotient = contracted.join(exits, "child", "left_semi")
    inner = quotient.select("child", F.col("exit").alias("parent"), "hops", *steps)  # what loops goes on as its own parent
    solved = solve(inner, with_path, fragment_rows, level + 1).select(
        F.col("node").alias("exit"), F.col("root").alias("up_root"), F.col("depth").alias("up"), F.col("looped").alias("up_looped"), *[F.col("steps").alias("up_steps")] * with_path
    )
    answers = durable(solved)
    hot = heavy_keys(contracted.groupBy("exit").agg(F.count("*").alias("n")), "exit")
    joined = split_join(contracted, answers, "exit", hot, "left")
    looped = F.col("looped") | F.coalesce("up_looped", F.lit(False))
    more = F.when(F.col("up_root").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array("exit"), "up_steps")) if with_path else None
    return joined.select(
        F.col("child").alias("node"), F.coalesce("up_root", "exit").alias("root"), (F.col("hops") + F.coalesce("up", F.lit(0))).alias("depth"), looped.alias("looped"), *([more.alias("steps")] if with_path else [])
    )


def hierarchy(entries: DataFrame, with_path: bool = False, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(id, root_id, depth[, path]): one row per linked id. Roots have depth 0 and are their own root. Ids whose parents
    end in a cycle have root_id '', depth -1 and a null path; an id that is its own parent is a cycle. ``path`` runs from
    the root to the id. Extra columns are ignored; no links give no rows."""
    links = durable(declared_links(entries))
    empty = F.array().cast("array<string>")
    weighted = links.select("child", "parent", F.lit(1).cast("long").alias("hops"), *[empty.alias("steps")] * with_path)
    solved = solve(weighted, with_path, fragment_rows, least=partitions_for(links))
    bad = F.col("looped")
    path = F.when(~bad, F.reverse(F.concat(F.array("node"), "steps", F.array("root"))))
    below = solved.select(
        F.col("node").alias("id"), F.when(bad, "").otherwise(F.col("root")).alias("root_id"), F.when(bad, -1).otherwise(F.col("depth")).cast("int").alias("depth"), *([path.alias("path")] if with_path else [])
    )
    tops = links.select(F.col("parent").alias("id")).distinct().join(links.select(F.col("child").alias("id")), "id", "left_anti")
    roots = tops.select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), *([F.array("id").alias("path")] if with_path else []))
    return below.unionByName(roots)


def descendants(entries: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(ancestor, descendant, distance): all pairs along the paths of nodes outside cycles; as many rows as the paths are
    long in total, streamed from one explode without a join or a grouping."""
    paths = hierarchy(entries, True, fragment_rows).filter("depth > 0")
    return paths.select("id", "depth", F.posexplode("path").alias("pos", "ancestor")).filter("pos < depth").select(
        "ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("pos")).alias("distance")
    )
