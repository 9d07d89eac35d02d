"""References and hierarchies against brute force, with nulls, empty tables, ties and extra columns."""

import datetime as dt
import random
from collections import Counter

import pytest

from lexweave.operators import hierarchy as H
from lexweave.operators.references import check_references, orphan_counts, orphans_found

SCHEMA = "entry_id long, id string, relations map<string,array<string>>, loaded_at timestamp, deleted_at timestamp, period string, n int, target_id string"
DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def table(spark, rows):
    return spark.createDataFrame([(i, a, r, day(x), day(y), "p", 1, "t") for i, (a, r, x, y) in enumerate(rows)], SCHEMA)


def norm(x):
    return x.strip().lower() if x else ""


def brute_orphans(rows):
    out = set()
    for i, (_, rel, at, _) in enumerate(rows):
        for k in ("part_of", "used_in"):
            for t in (rel or {}).get(k) or []:
                t = norm(t)
                if t and not any(norm(a) == t and x is not None and at is not None and x <= at and (y is None or y > at) for a, _, x, y in rows):
                    out.add((i, k, t))
    return out


@pytest.mark.parametrize(("share", "hot_rows"), [(0.01, 100_000), (0.2, 0), (2.0, 0)])
def test_orphans_match_brute_force(spark, share, hot_rows):
    r = random.Random(3)
    ids = [f"id{k}" for k in range(12)] + ["gone"]
    rows = []
    for _ in range(250):
        target = lambda: r.choice(["id0"] * 8 + ids + [" ID1\t", "", None, "  "])
        rel = r.choice([None, {}, {"part_of": [target() for _ in range(r.randrange(4))]}, {"used_in": [target()], "part_of": None, "hyponym": ["gone"]}])
        at = r.choice([None, *range(0, 200, 3)])
        rows.append((r.choice([*ids[:-1], " Id2 ", None, ""]), rel, at, None if at is None or r.random() < 0.5 else at + r.randrange(-2, 60)))
    every = check_references(table(spark, rows), share=share, hot_rows=hot_rows).collect()
    got = [(x.entry_id, x.relation, x.target_id) for x in every if x.orphan]
    assert len(got) == len(set(got)) and set(got) == brute_orphans(rows)
    month = lambda x: x.ref_at and f"{x.ref_at:%Y-%m}"
    want = {k: (n, Counter((x.relation, month(x)) for x in every if x.orphan)[k]) for k, n in Counter((x.relation, month(x)) for x in every).items()}
    assert {(x.relation, x.month): (x.n_refs, x.n_orphans) for x in orphan_counts(table(spark, rows)).collect()} == want


def test_orphans_of_nothing_and_counts(spark):
    assert orphans_found(table(spark, [])).count() == 0
    rows = [("a", {"part_of": ["b", "c"]}, 40, None), ("b", None, 1, None)]
    assert [tuple(x) for x in orphan_counts(table(spark, rows)).collect()] == [("part_of", "2024-02", 2, 1)]


def brute_tree(rows):
    ids = {norm(a) for a, *_ in rows} - {""}
    links = set()
    for a, rel, *_ in rows:
        for p in (rel or {}).get("hyperonym") or []:
            links.add((norm(a), norm(p)))
        for c in (rel or {}).get("hyponym") or []:
            links.add((norm(c), norm(a)))
    parent = {}
    for c, p in sorted(links, reverse=True):
        if c in ids and p in ids:
            parent[c] = p
    out = {}
    for x in {y for e in parent.items() for y in e}:
        seen = [x]
        while seen[-1] in parent and parent[seen[-1]] not in seen:
            seen.append(parent[seen[-1]])
        out[x] = ("", -1) if seen[-1] in parent else (seen[-1], len(seen) - 1)
    return out


@pytest.mark.parametrize("fragment", [7, 60, 10_000])
def test_hierarchy_matches_brute_force(spark, fragment):
    r = random.Random(fragment)
    rows = [(f"n{k}", {"hyperonym": [f" N{k - 1} "]} if k % 40 else {}, 0, None) for k in range(160)]  # chains
    rows += [(f"s{k}", {"hyperonym": ["n5"]}, 0, None) for k in range(80)]  # a parent of many
    rows += [("x", {"hyperonym": ["y"]}, 0, None), ("y", {"hyponym": ["z"], "hyperonym": ["x"]}, 0, None), ("z", None, 0, None), ("me", {"hyponym": ["me", None, " "]}, 0, 1), ("lost", {"hyperonym": ["nowhere"]}, 0, None), (None, {"hyperonym": ["n1"]}, 0, None)]
    rows += [(f"t{k}", {"hyperonym": [f"t{r.randrange(k)}" if k else "n3"]}, 0, None) for k in range(120)]
    want = brute_tree(rows)
    got = H.hierarchy(table(spark, rows), True, fragment).collect()
    assert len(got) == len(want) and {x.id: (x.root_id, x.depth) for x in got} == want
    for x in got:
        assert (x.path is None) == (x.depth == -1)
        if x.path:
            assert x.path[0] == x.root_id and x.path[-1] == x.id and len(x.path) == x.depth + 1


def test_descendants_and_empty(spark):
    rows = [("a", None, 0, None), ("b", {"hyperonym": ["a"]}, 0, None), ("c", {"hyperonym": ["b"]}, 0, None)]
    assert {tuple(x) for x in H.descendants(table(spark, rows)).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert H.hierarchy(table(spark, [])).count() == 0


def test_small_forests_are_dealt_too(spark, monkeypatch):
    levels, solve = [], H.solve

    def watched(links, with_path=False, fragment_rows=H.FRAGMENT_ROWS, level=0, **kw):
        levels.append(level)
        return solve(links, with_path, fragment_rows, level, **kw)

    monkeypatch.setattr(H, "solve", watched)
    rows = [(f"n{k}", {"hyperonym": [f"n{k - 1}"]}, 0, None) for k in range(60)] + [("x", {"hyperonym": ["y"]}, 0, None), ("y", {"hyperonym": ["x"]}, 0, None)]
    assert {x.id: (x.root_id, x.depth) for x in H.hierarchy(table(spark, rows)).collect()} == brute_tree(rows)
    assert levels == [0, 1]
