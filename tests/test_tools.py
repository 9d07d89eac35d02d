"""Merge, sources, sinks, configuration, pipeline, command line, streaming."""

import asyncio
import datetime as dt
import json
import logging
import os
import random
import re

import pytest

from lexweave import common
from lexweave.common import durable, scope
from lexweave.operators.cvalue import extract_cvalue
from lexweave.operators.merge import ON_CONFLICT, ON_MATCH, MergePolicy, fold, merge_glossaries
from lexweave.operators.reports import QualityGates
from lexweave.operators.rules import rule_matches
from lexweave.operators.tokens import MissingModel, tokenize_with
from lexweave.plans import cli, config
from lexweave.plans.pipeline import ReportConfig, pipeline
from lexweave.plans.timing import timeit
from lexweave.schema import ENTITY
from lexweave.sources import files, sinks
from lexweave.streaming.stream import rolling_coverage, stream_documents


def entity(i, label, synonyms=(), definition=None, source=None):
    return {"id": i, "label": label, "synonyms": list(synonyms), "relations": {}, "definition": definition, "source": source}


def frame(spark, rows):
    return spark.createDataFrame([(k, e["id"], e["label"], e["synonyms"], e["relations"], e["definition"], e["source"]) for k, e in enumerate(rows)], ENTITY)


def ordered(rows, side):
    return [e | {"order": (side, k, 0)} for k, e in enumerate(rows)]


@pytest.mark.parametrize("seed", range(4))
def test_component_fold_equals_global_fold(spark, seed):
    r = random.Random(seed)
    make = lambda n: [entity(r.choice(["x", "x_2", "x_3", "y", "z", "q", "w"]) + r.choice(["", "7", "8"]), r.choice("abcdefghij") + r.choice("klm"), [r.choice("abcdefghij") + r.choice("klm") for _ in range(r.randrange(2))]) for _ in range(n)]
    base, updates = make(8), make(12)
    policy = MergePolicy(r.choice(ON_MATCH), r.choice(ON_CONFLICT))
    want, conflicts, outcomes = fold(ordered(base, 0), ordered(updates, 1), policy)
    merged, c, summary = merge_glossaries(frame(spark, base), frame(spark, updates), policy)
    got = [(x.id, x.label, x.synonyms) for x in merged.orderBy("side", "pos", "part").collect()]
    assert got == [(e["id"], e["label"], e["synonyms"]) for e in sorted(want, key=lambda e: e["order"])]
    kinds = [o["kind"] for o in outcomes]
    assert summary.first().asDict() == {k: kinds.count(k) for k in ("added", "updated", "skipped")} | {"conflicts": len(conflicts)}
    assert c.count() == len(conflicts)


def test_merge_cases(spark):
    base = [entity("a", "term", ["syn"])]
    merged, _, summary = merge_glossaries(frame(spark, base), frame(spark, [entity("b", "Term", ["new"], "d")]))
    row = merged.first()
    assert (row.id, row.synonyms, row.definition, summary.first().updated) == ("a", ["syn", "new"], "d", 1)
    _, conflicts, summary = merge_glossaries(frame(spark, base), frame(spark, [entity("a", "other")]))
    assert conflicts.first().conflict_type == "id_label_mismatch" and summary.first().skipped == 1
    two = [entity("a", "one", ["x"]), entity("b", "two", ["x"])]
    for compat, n in ((False, 3), (True, 4)):
        merged, _, summary = merge_glossaries(frame(spark, two), frame(spark, [entity("c", "three", ["x"])]), MergePolicy("skip", "keep-update"), compat)
        assert merged.count() == n and summary.first().added == 1
    assert merge_glossaries(frame(spark, []), frame(spark, []))[0].count() == 0
    with pytest.raises(ValueError):
        MergePolicy("nope")


@pytest.fixture
def folder(tmp_path):
    g = [{"id": "t:1", "label": "machine learning", "synonyms": ["ML"]}, {"id": "t:2", "label": "deep network"}]
    (tmp_path / "g.json").write_text(json.dumps(g), encoding="utf-8")
    (tmp_path / "bad.json").write_text("not json", encoding="utf-8")
    (tmp_path / "odd.json").write_text(json.dumps([{"id": "x", "label": "y", "other": 1}]), encoding="utf-8")
    (tmp_path / "doc.txt").write_text("Machine learning helps.\r\nA deep network learns.", encoding="utf-8")
    return tmp_path


def test_sources(spark, folder):
    assert [r.label for r in files.open_source(spark, str(folder / "g.json")).orderBy("entity_pos").collect()] == ["machine learning", "deep network"]
    for name, error in (("bad.json", ValueError), ("odd.json", ValueError), ("none.json", FileNotFoundError), ("x.ttl", NotImplementedError), ("x.csv", ValueError)):
        with pytest.raises(error):
            files.open_source(spark, str(folder / name))
    assert files.read_texts(spark, str(folder / "doc.txt")).first().text == "Machine learning helps.\nA deep network learns."


def test_report_and_glossary_round_trip(spark, folder):
    docs = files.read_texts(spark, str(folder / "doc.txt"))
    glossary = files.read_glossary(spark, str(folder / "g.json"))
    out = pipeline().with_cvalue(threshold=0).normalize().verify(glossary).report(ReportConfig(output_dir=str(folder / "out"))).run_and_collect(docs)
    kinds = {r["report_type"]: r for r in out}
    assert kinds["verification"]["total_items"] == 4 and kinds["verification"]["processed_items"] == 2 and kinds["quality_gate"]["exit_code"] == 1
    assert json.loads((folder / "out/verification.json").read_text())["data"]["coverage_pct"] == 50.0
    assert cli.main(["glossary", "from-report", "--report", str(folder / "out/ontology_update.json"), "--out", str(folder / "new.json")], spark) == 0
    assert cli.main(["glossary", "merge", "--base", str(folder / "g.json"), "--updates", str(folder / "new.json"), "--out", str(folder / "all.json"), "--summary-out", str(folder / "s.json")], spark) == 0
    assert json.loads((folder / "s.json").read_text())["added"] == 2 and len(json.loads((folder / "all.json").read_text())) == 4
    both = files.read_glossary(spark, str(folder / "all.json"))
    again = pipeline().with_cvalue(threshold=0).normalize().verify(both).report(ReportConfig()).run_and_collect(docs)
    assert next(r for r in again if r["report_type"] == "verification")["coverage_pct"] == 100.0
    assert not any(r["report_type"] == "ontology_update" for r in again)


def test_cli_exit_codes(spark, folder, monkeypatch, capsys):
    monkeypatch.chdir(folder)
    run = lambda *a: cli.main(["verify", str(folder / "doc.txt"), "--source", str(folder / "g.json"), "--output-dir", str(folder / "o"), *a], spark)
    assert run("--verifier", "fuzzy") == 0
    assert run("--fail-on-quality-gate") == 1
    assert run("--fail-on-quality-gate", "--min-coverage", "10", "--max-unknown", "50") == 0
    assert cli.main(["verify", "x.txt", "--source", "missing.json"], spark) == 2
    assert cli.main(["nonsense"], spark) == 2
    assert cli.main(["extract", str(folder / "doc.txt"), "--output-dir", str(folder / "e")], spark) == 0 and (folder / "e/extraction.json").exists()
    assert cli.main(["config"], spark) == 0 and cli.main(["validate"], spark) == 0


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.lexweave]\noutput-dir = "here"\n[tool.lexweave.quality-gates]\nmin-coverage = 50.0\n[tool.lexweave.verifier]\ntype = "fuzzy"\nfuzzy-params = {threshold = 0}\n')
    c = config.discover(start=tmp_path)
    assert (c.output_dir, c.quality_gates.min_coverage, c.verifier, c.fuzzy_params()["threshold"]) == ("here", 50.0, "fuzzy", 0)
    assert config.Config().quality_gates.max_unknown == 5 and config.Config().extractors == ["rule", "cvalue"]
    with pytest.raises(config.ConfigError):
        config.from_dict({"extraction": {"extractors": ["nope"]}}).check()
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "none.toml")


def test_unknown_exporter_raises(tmp_path):
    with pytest.raises(ValueError):
        sinks.export_reports([], tmp_path, ("html",))


def test_stream(spark, tmp_path):
    from lexweave.operators.cvalue import extract_cvalue

    spark.createDataFrame([(1, "machine learning"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    stream_documents(stream, extract_cvalue, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["machine learning"]


def test_long_lists_go_whole_to_rows(spark, folder):
    docs = files.read_texts(spark, str(folder / "doc.txt"))
    glossary = files.read_glossary(spark, str(folder / "g.json"))
    made = lambda **kw: {r["report_type"]: r for r in pipeline().with_cvalue(threshold=0).normalize().verify(glossary).report(ReportConfig(**kw)).run_and_collect(docs)}
    short, long, held = made(output_dir=str(folder / "short")), made(output_dir=str(folder / "long dir"), listed=1), made(listed=1)
    for kind, name in (("verification", "unknown_terms"), ("ontology_update", "suggested_entities")):
        terms = short[kind][name]
        assert len(terms) == 2 and held[kind][name] == terms and name not in long[kind]
        kept = json.loads((folder / f"long dir/{kind}.json").read_text())["data"][f"{name}_rows"]
        assert kept["count"] == 2 and kept == long[kind][f"{name}_rows"]
        rows = spark.read.json(kept["path"]).orderBy("seq").collect()
        assert [(r.text, list(r.span), r.score) for r in rows] == [(t["text"], t["span"], t["score"]) for t in terms]
    assert long["quality_gate"] == short["quality_gate"] and long["verification"]["coverage_pct"] == 50.0
    for name in ("short", "long dir"):
        assert cli.main(["glossary", "from-report", "--report", str(folder / name / "ontology_update.json"), "--out", str(folder / f"{name}.json")], spark) == 0
    assert json.loads((folder / "short.json").read_text()) == json.loads((folder / "long dir.json").read_text())


def test_verification_lists_matches_and_documents(spark, folder):
    docs = files.read_texts(spark, str(folder / "doc.txt"))
    glossary = files.read_glossary(spark, str(folder / "g.json"))
    made = lambda **kw: {r["report_type"]: r for r in pipeline().with_cvalue(threshold=0).normalize().verify(glossary).report(ReportConfig(**kw)).run_and_collect(docs)}
    short, long = made(output_dir=str(folder / "a")), made(output_dir=str(folder / "b"), listed=1)
    matches = {m["text_entity"]["text"]: m for m in short["verification"]["matches"]}
    assert matches["machine learning"]["entity"] == {"id": "t:1", "label": "machine learning", "synonyms": ["ML"], "relations": {}}
    assert matches["machine learning"]["status"] == "MATCHED" and matches["learning helps"] | {"text_entity": 0, "doc_id": 0} == {"text_entity": 0, "doc_id": 0, "entity": None, "confidence": 0.0, "status": "UNKNOWN", "matched_synonym": None}
    assert matches["learning helps"]["text_entity"]["properties"] == {"length": "2"}
    assert [(d["total_items"], d["coverage_pct"], d["exit_code"]) for d in short["verification"]["documents"]] == [(4, 50.0, 1)]
    kept = [json.loads(x.value) for x in spark.read.text(long["verification"]["matches_rows"]["path"]).collect()]
    assert len(kept) == 4 and all("entity" in x and "matched_synonym" in x for x in kept)
    # the pipeline's gate is the operator's
    strict = QualityGates(10.0, 50, 0.9, True)
    assert made(gates=QualityGates(10.0, 50))["quality_gate"]["quality_pass"] and made(gates=strict)["quality_gate"]["quality_pass"]
    assert not made(gates=QualityGates(10.0, 50, 1.1, True))["quality_gate"]["quality_pass"]
    assert made(include=("quality_gate",))["quality_gate"]["exit_code"] == 1


def test_model_tokens_reach_punctuation_patterns(spark):
    def fake_model():
        pos = {"red": "ADJ", "input": "NOUN", "output": "NOUN", "runs": "VERB", "-": "PUNCT", ".": "PUNCT"}

        def tag(text):
            out = []
            for m in re.finditer(r"[^.]+\.?", text):
                tokens = [(t[0], t[0].upper(), pos.get(t[0], "X"), m.start() + t.start(), False, pos.get(t[0]) == "PUNCT") for t in re.finditer(r"\w+|[-.]|\s", m[0])]
                out.append((m[0], tokens))
            return out

        return tag

    docs = spark.createDataFrame([(1, "red input-output runs. input runs output."), (2, None), (3, "")], "doc_id long, text string")
    tokens = tokenize_with(docs, fake_model, "fake")
    assert [(t.token, t.lemma, t.sent_id) for t in tokens.orderBy("tok_idx").collect()][:4] == [("red", "red", 0), ("input", "input", 0), ("-", "-", 0), ("output", "output", 0)]
    got = {(r.text, r.sentence) for r in rule_matches(tokens, docs).collect()}
    assert got == {("red input", "red input-output runs."), ("input-output", "red input-output runs."), ("input runs output", "input runs output.")}
    with pytest.raises(MissingModel):
        pipeline().with_rules(model="no_such_model")
    assert extract_cvalue(docs, tagger=lambda d: tokenize_with(d, fake_model, "fake")).count() > 0
    assert pipeline().with_cvalue(model="no_such_model").run(docs).count() > 0  # the heuristic mode


def test_merge_of_rows(spark, folder):
    assert cli.main(["glossary", "merge", "--base", str(folder / "g.json"), "--updates", str(folder / "g.json"), "--out", str(folder / "m.parquet")], spark) == 0
    assert cli.main(["glossary", "merge", "--base", str(folder / "m.parquet"), "--updates", str(folder / "g.json"), "--out", str(folder / "m.jsonl")], spark) == 0
    assert [(r.id, r.entity_pos) for r in files.open_source(spark, str(folder / "m.jsonl")).orderBy("entity_pos").collect()] == [("t:1", 0), ("t:2", 1)]


def test_rolling_coverage(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at, "MATCHED"), (at + dt.timedelta(minutes=59), "UNKNOWN"), (at + dt.timedelta(hours=1), "NEAR_MATCH")], "t timestamp, status string")
    got = rolling_coverage(rows, "t").orderBy("window_start").collect()
    assert [(r.window_start, r.total_items, r.processed_items) for r in got] == [(at, 2, 1), (at + dt.timedelta(hours=1), 1, 1)]


def test_first_file_gates(spark, folder, monkeypatch, capsys):
    monkeypatch.chdir(folder)
    (folder / "other.txt").write_text("Nothing known here.", encoding="utf-8")
    run = lambda *files, first=(): cli.main(["verify", *[str(folder / f) for f in files], "--source", str(folder / "g.json"), "--output-dir", str(folder / "o"), "--fail-on-quality-gate", "--min-coverage", "50", "--max-unknown", "50", *first], spark)
    assert run("doc.txt", "other.txt") == 1 and run("doc.txt", "other.txt", first=["--first-file"]) == 0 and run("other.txt", "doc.txt", first=["--first-file"]) == 1
    assert "coverage 50.0 % (2 of 4 terms)" in capsys.readouterr().out


def test_scope_removes_its_tables(spark):
    kept = durable(spark.range(3))
    with scope():
        gone = durable(spark.range(5))
        assert gone.count() == 5
        path = common._written[-1][1].removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.isdir(path) and kept.count() == 3


def test_timing(caplog):
    @timeit
    async def late():
        await asyncio.sleep(0.02)
        return 7

    @timeit
    def soon():
        return 8

    with caplog.at_level(logging.INFO, "lexweave"):
        assert asyncio.run(late()) == 7 and soon() == 8
    assert [r.args[0].rsplit(".")[-1] for r in caplog.records] == ["late", "soon"] and caplog.records[0].args[1] >= 0.02


def test_merge_folds_many_components_at_once():
    """Components of one task come out in one table, also if they go on in the next batch."""
    import pandas as pd

    from lexweave.operators.merge import _folds

    row = lambda c, side, pos, label: {"component": c, "side": side, "pos": pos, "id": f"{label}{side}", "label": label, "synonyms": [], "relations": {}, "definition": None, "source": None}
    rows = pd.DataFrame([row(c, side, 2 * c + side, f"t{c}") for c in range(50) for side in (1, 0)])
    got = list(_folds(MergePolicy())(iter([rows[:33], rows[33:]])))
    assert len(got) == 1 and (got[0]["kind"] == "entity").sum() == 50 and (got[0]["kind"] == "updated").sum() == 50


@pytest.mark.parametrize("on_conflict", ON_CONFLICT)
def test_merge_costs_what_comes_in(monkeypatch, on_conflict):
    """An entity that all updates go into isn't gone through again for each of them."""
    from lexweave.operators import merge

    calls, real = [0], merge.canonical

    def counted(s):
        calls[0] += 1
        return real(s)

    monkeypatch.setattr(merge, "canonical", counted)
    updates = [entity(f"u{k}", "hub", [f"synonym {k}", "other"]) for k in range(500)]
    merged, _, outcomes = fold(ordered([entity("a", "hub", ["x"])], 0), ordered(updates, 1), MergePolicy(on_conflict=on_conflict))
    assert merged[0]["synonyms"] == ["x", "synonym 0", "other", *[f"synonym {k}" for k in range(1, 500)]] and len(merged) == 1
    assert {o["kind"] for o in outcomes} == {"updated"} and calls[0] < 20 * len(updates)


def test_merged_synonyms_become_canonical_again():
    """Each merge makes all synonyms canonical anew, which changes those whose edges leave a space behind."""
    updates = [entity("u", "hub", ["! . a", "b"]), entity("v", "hub", ["c"]), entity("w", "hub", ["a"]), entity("x", "d", ["a"])]
    for n, want in ((1, [" . a", "b"]), (2, [" a", "b", "c"]), (3, ["a", "b", "c"]), (4, ["a", "b", "c", "d"])):
        merged, _, _ = fold(ordered([entity("h", "hub")], 0), ordered(updates[:n], 1), MergePolicy())
        assert [e["synonyms"] for e in merged] == [want]


def test_long_chain_takes_no_more_tables(spark, monkeypatch):
    """Components of any length are found in one task; a number of edges beyond its bound gives the same by rounds."""
    from lexweave.operators import merge

    made, real = [], merge.durable
    monkeypatch.setattr(merge, "durable", lambda df: made.append(1) or real(df))
    chain = [entity(f"u{'xyz'[k % 3]}{k}u", f"t{(k * 37) % 100}", [f"t{((k + 1) * 37) % 100}"]) for k in range(60)]
    rows = merge._tagged(frame(spark, [entity("b", "far")]), 0).unionByName(merge._tagged(frame(spark, chain), 1))
    found = sorted(tuple(r) for r in merge.components(rows).collect())
    assert found == [(2 * k + 1, 1) for k in range(60)] and len(made) <= 3
    monkeypatch.setattr(merge, "EDGES_AT_ONCE", 0)
    assert sorted(tuple(r) for r in merge.components(rows).collect()) == found and len(made) > 6
    assert merge.components(rows.filter("side = 0")).count() == 0


def test_keys_of_components_are_canonical_terms(spark):
    from lexweave.functions import text
    from lexweave.operators import merge

    words = [w for c in [*map(chr, range(1, 0x3002)), "﻿", "𐐀"] for w in (c, f"A{c}{c}b", f"{c}. Ё {c}")] + ["! . a  b ..", "", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", merge._term(merge.F.col("w")).alias("t"))
    same = got.withColumn("c", text.canonical_term(merge.F.col("w")))
    assert [tuple(r) for r in same.filter("NOT (t <=> c)").collect()] == []


def test_merge_of_many_linked_entities_is_the_same(spark, monkeypatch):
    """Neither the bound of what is broadcast nor that of one task's edges changes the result."""
    from lexweave.operators import merge

    r = random.Random(5)
    make = lambda n: [entity(r.choice("xyz") + r.choice(["", "7", "_2"]), r.choice("abcdefgh") + r.choice("klm"), [r.choice("abcdefgh") + r.choice("klm")]) for _ in range(n)]
    base, updates = frame(spark, make(8)), frame(spark, make(20))
    results = lambda: [[tuple(r) for r in df.orderBy(*df.columns[:3]).drop("relations").collect()] for df in merge_glossaries(base, updates)]
    want = results()
    for bound in ("LINKED_AT_ONCE", "EDGES_AT_ONCE"):
        monkeypatch.setattr(merge, bound, 0)
        assert results() == want


def test_folds_in_order_hold_no_update_that_went_into_another(monkeypatch):
    """What came of updates goes out while their component still comes in."""
    import pandas as pd

    from lexweave.operators import merge

    monkeypatch.setattr(merge, "ROWS_AT_ONCE", 10)
    came = []

    def batches():
        for k in range(10):
            came.append(k)
            yield pd.DataFrame([{"component": 7, "side": 1, "pos": 5 * k + j, "id": f"u{k}{j}", "label": "hub", "synonyms": [], "relations": "{}", "definition": None, "source": None} for j in range(5)])

    out = merge._folds(MergePolicy(), in_order=True)(batches())
    first = next(out)
    assert len(first) == 10 and set(first["kind"]) == {"added", "updated"} and len(came) < 5
    assert [k for pdf in out for k in pdf["kind"]].count("entity") == 1 and len(came) == 10


@pytest.mark.parametrize("compat", [False, True])
def test_merge_keeps_relations(spark, compat):
    relations = {"part_of": ["a", 'b "q" \\ ё\n'], "": [], "used_in": ["", None]}
    base = [entity("a", "one") | {"relations": relations}, entity("b", "two") | {"relations": None}]
    updates = [entity("c", "One") | {"relations": {"x": ["y"]}}, entity("d", "three") | {"relations": relations}]
    merged = merge_glossaries(frame(spark, base), frame(spark, updates), MergePolicy(), compat)[0].orderBy("side", "pos")
    assert dict(merged.dtypes)["relations"] == "map<string,array<string>>"
    assert [r.relations for r in merged.collect()] == [relations, {}, relations]


def test_merge_leaves_one_table(spark):
    """Tables on the way to a merge's outcome are removed as soon as they aren't needed."""
    before = len(common._written)
    merged, conflicts, summary = merge_glossaries(frame(spark, [entity("a", "one")]), frame(spark, [entity("b", "one"), entity("a", "x"), entity("c", "new")]))
    assert len(common._written) == before + 1
    assert (merged.count(), conflicts.count(), summary.first().added) == (2, 1, 1)
