"""Tokens, candidates, scores, rules, verification and reports."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexweave.functions.similarity import SCORERS, lcs_length, ratio, scorer, token_sort_ratio
from lexweave.functions.text import canonical_term
from lexweave.operators import candidates as C
from lexweave.operators import cvalue as V
from lexweave.operators import extract, glossary, reports, rules, tokens, verify
from lexweave.operators.merge import canonical

TOKENS = "doc_id long, tok_idx int, token string, lemma string, pos string, char_start int, char_end int, sent_id int, is_stop boolean, is_punct boolean"
ENTITIES = "entity_pos long, id string, label string, synonyms array<string>"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, token string, i int")


def tagged(spark, *sentences, doc=1):
    rows, k = [], 0
    for s, sentence in enumerate(sentences):
        for word, pos in sentence:
            rows.append((doc, k, word, word.lower(), pos, 10 * k, 10 * k + len(word), s, False, pos == "PUNCT"))
            k += 1
    return spark.createDataFrame(rows, TOKENS)


def texts(df):
    return sorted(r.text for r in df.collect())


def test_tokenize_as_the_regular_expression(spark):
    hard = ["été x² Ⅳab a_b c3po naïve", "state of art... e.g. 3.5!", "слово\r\nещё ё‿ж zero​width 漢字abc", "", None, "one two. three? Four"]
    got = defaultdict(list)
    for r in tokens.tokenize(docs(spark, *hard)).orderBy("tok_idx").collect():
        got[r.doc_id].append((r.token, r.char_start, r.char_end, r.sent_id))
    for k, t in enumerate(hard):
        t, sent, want = (t or "").replace("\r\n", "\n"), 0, []
        for m in re.finditer(r"\b[а-яёА-ЯЁa-zA-Z]{3,}\b|[.!?]+", t):
            if m[0][0] in ".!?":
                sent += 1
            else:
                want.append((m[0], m.start(), m.end(), sent))
        assert got[k] == want


def test_heuristic_candidates(spark):
    c = lambda t: texts(C.heuristic_candidates(tokens.tokenize(docs(spark, t))))
    assert c("machine learning systems") == ["learning systems", "machine learning"]
    assert c("neural networks and learning") == ["neural networks"]
    assert c("artificial intelligence uses learning") == ["artificial intelligence", "uses learning"]
    assert c("machine learning. deep learning") == ["deep learning", "machine learning"]
    assert C.heuristic_candidates(tokens.tokenize(docs(spark, "a b"))).count() == 0
    assert C.heuristic_candidates(tokens.tokenize(docs(spark, "machine learning systems")), 3, 4).count() == 0


def test_pos_candidates(spark):
    A, N, B = "ADJ", "NOUN", "VERB"
    c = lambda *s: texts(C.pos_candidates(tagged(spark, *s)))
    assert c([("machine", A), ("learning", N), ("methods", N)]) == ["learning methods", "machine learning", "machine learning methods"]
    assert c([("intelligence", N), ("deep", A), ("learning", N)]) == ["deep learning"]
    assert c([("artificial", A), ("intelligence", N), ("uses", B), ("deep", A), ("learning", N)]) == ["artificial intelligence", "deep learning"]
    assert c([("neural", A), ("networks", N)], [("deep", A), ("learning", N)]) == ["deep learning", "neural networks"]
    assert c([("deep", A), ("neural", A)]) == []


def occurrences(spark, *items):
    rows = [(1, t, len(t.split()), 0, k, k, k + 1, (0, k, 0)) for k, t in enumerate(items)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tok int, sent_id int, first_idx int, char_start int, char_end int, occ struct<a:int,b:int,c:int>")


def scores(spark, *items, min_freq=1):
    return {r.text: (r.freq, round(r.score, 9)) for r in V.score_candidates(V.count_candidates(occurrences(spark, *items), min_freq)).collect()}


def test_cvalue_scores(spark):
    ml = "machine learning"
    assert scores(spark) == {}
    assert scores(spark, ml) == {ml: (1, 1.0)}
    assert scores(spark, ml, ml) == {ml: (2, 2.0)}
    assert scores(spark, "learning") == {"learning": (1, 0.0)}
    assert scores(spark, ml, ml + " methods") == {ml: (1, 0.0), ml + " methods": (1, round(math.log2(3), 9))}
    assert scores(spark, ml, ml, ml + " a", ml + " b")[ml] == (2, 1.0)
    assert scores(spark, ml, ml, "rare term", min_freq=2) == {ml: (2, 2.0)}


def test_cvalue_against_brute_force(spark):
    r = random.Random(1)
    items = [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 5))) for _ in range(400)]
    freq = Counter(items)
    inside = lambda a, b: any(b[k : k + len(a)] == a for k in range(len(b) - len(a) + 1))
    want = {}
    for t, f in freq.items():
        w = t.split()
        over = [g for u, g in freq.items() if len(u.split()) > len(w) and inside(w, u.split())]
        s = 0 if len(w) == 1 else math.log2(len(w)) * (f - (sum(over) / len(over) if over else 0))
        want[t] = (f, round(max(0, s), 9))
    assert scores(spark, *items) == want


def test_extract_threshold_and_rank(spark):
    d = docs(spark, "machine learning improves machine learning systems", None, "  ")
    got = V.extract_cvalue(d, 0.0, min_length=2, max_length=2).orderBy("seq").collect()
    assert got[0].text == "machine learning" and got[0].frequency == 2 and (got[0].span_start, got[0].span_end) == (0, 16)
    assert V.extract_cvalue(d, 10.0).count() == 0


def test_rules(spark):
    t = tagged(spark, [("deep", "ADJ"), ("model", "NOUN"), ("fits", "VERB"), ("data", "NOUN"), (".", "PUNCT"), ("term", "NOUN")])
    got = {(r.text, r.span_start, r.span_end) for r in rules.rule_matches(t).collect()}
    assert got == {("deep model", 0, 2), ("model fits data", 1, 4), ("data . term", 3, 6)}
    many = tagged(spark, [("a1", "NOUN"), ("b1", "NOUN"), ("c1", "NOUN")])
    assert texts(rules.rule_matches(many, patterns=[[{"POS": "NOUN", "OP": "+"}]])) == ["a1", "a1 b1", "a1 b1 c1", "b1", "b1 c1", "c1"]
    for bad in ([{"LEMMA": "x"}], [{"POS": "NOUN", "OP": "{2}"}], []):
        with pytest.raises(ValueError):
            rules.compile_pattern(bad)
    with pytest.raises(ValueError):
        rules.rule_matches(t.drop("pos"))


def test_open_patterns_have_no_longest_run(spark, monkeypatch):
    run = tagged(spark, [(f"w{k}", "NOUN") for k in range(30)] + [("is", "VERB"), ("end", "NOUN")])
    monkeypatch.setattr(rules, "SPAN_TOKENS", 100)
    got = {(r.span_start, r.span_end) for r in rules.rule_matches(run, patterns=[[{"POS": "NOUN", "OP": "+"}]]).collect()}
    assert got == {(a, z) for a in range(30) for z in range(a + 1, 31)} | {(31, 32)}
    r = random.Random(4)
    pos = {d: [r.choice(["NOUN", "NOUN", "NOUN", "ADJ", "VERB", "PUNCT", "OTHER"]) for _ in range(40)] for d in range(3)}
    pos[0][5:25] = ["NOUN"] * 20
    t = tagged(spark, [(f"t{k}", p) for k, p in enumerate(pos[0])], doc=0).union(tagged(spark, [(f"t{k}", p) for k, p in enumerate(pos[1])], doc=1)).union(tagged(spark, [(f"t{k}", p) for k, p in enumerate(pos[2])], doc=2))
    patterns = [[{"POS": "ADJ", "OP": "*"}, {"POS": "NOUN", "OP": "+"}], [{"POS": "NOUN", "OP": "*"}, {"IS_PUNCT": True, "OP": "?"}, {"POS": "NOUN"}], [{"POS": "VERB"}, {"POS": "NOUN", "OP": "!"}, {"IS_PUNCT": False, "OP": "*"}]]
    code = lambda p: rules.CODES.get(p, "z") + str(int(p == "PUNCT"))
    want = {}
    for d, ps in pos.items():
        for a in range(40):
            for z in range(a + 1, 41):
                hit = [k for k, p in enumerate(patterns) if re.search(rules.compile_pattern(p)[0], "".join(map(code, ps[a:z])))]
                if hit:
                    want[d, a, z] = (zlib.crc32(repr(patterns[hit[0]]).encode()), " ".join(f"t{k}" for k in range(a, z)), ps[a:z])
    rows = rules.rule_matches(t, patterns=patterns).collect()
    assert len(rows) == len(want) and {(x.doc_id, x.span_start, x.span_end): (x.pattern_id, x.text, x.pos_tags) for x in rows} == want


def entities(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], ENTITIES)


def terms(spark, *rows):
    return spark.createDataFrame([(d, t, lemma, 0.9, "own") for d, t, lemma in rows], "doc_id long, text string, lemma string, score double, label string")


def test_verify_exact(spark):
    g = entities(spark, ("a", "Neural Network", ["NN", "net"]), ("b", "Net", []), ("c", "tree", None))
    t = terms(spark, (1, "neural network", "x"), (1, "nn", "nn"), (2, "net", "net"), (3, "trees", "Tree"), (3, None, None), (4, "cat", "cat"))
    got = {(r.doc_id, r.text): (r.status, r.confidence, r.entity_id) for r in verify.verify_exact(t, g).collect()}
    assert got == {(1, "neural network"): ("MATCHED", 1.0, "a"), (1, "nn"): ("UNKNOWN", 0.0, None), (2, "net"): ("UNKNOWN", 0.0, None), (3, "trees"): ("MATCHED", 0.5, "c"), (3, None): ("UNKNOWN", 0.0, None), (4, "cat"): ("UNKNOWN", 0.0, None)}
    assert {r.status for r in verify.verify_exact(t, entities(spark)).collect()} == {"UNKNOWN"}


def test_verify_fuzzy_against_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(2, 6)))
    keys = [f"{word()} {word()}" for _ in range(60)]
    asked = [(k, f"{word()} {word()}", r.choice(["", None])) for k in range(80)] + [(99, " ".join(reversed(keys[3].split())), ""), (98, "", "")]
    g = entities(spark, *[(f"e{k}", key, ["x " + key]) for k, key in enumerate(keys)])
    order = list(dict.fromkeys(t for key in keys for t in (key, "x " + key)))
    for name in ("token_sort_ratio", "ratio", "token_set_ratio"):
        for shards in (20_000, 25):
            got = {x.doc_id: (x.status, x.matched_synonym) for x in verify.verify_fuzzy(terms(spark, *asked), g, 60, name, keys_at_once=shards).collect()}
            for d, t, lemma in asked:
                q = lemma or t
                best = max(((scorer(name)(q, k), -i, k) for i, k in enumerate(order)), default=None) if q else None
                want = ("NEAR_MATCH", best[2]) if best and best[0] >= 60 else ("UNKNOWN", None)
                assert got[d] == want, (name, q)
    with pytest.raises(ValueError):
        verify.verify_fuzzy(terms(spark), g, scorer="nope")


def test_similarity_functions():
    assert lcs_length("kitten", "sitting") == 4 and ratio("", "") == 100 and token_sort_ratio("b a", "a b") == 100
    assert all(0 <= f("abc d", "abd") <= 100 for f in SCORERS.values())
    assert SCORERS["partial_ratio"]("abc", "xxabcxx") == 100 and SCORERS["QRatio"]("", "") == 0


def test_reports(spark):
    m = spark.createDataFrame([(1, 0.95, "UNKNOWN", 0.0), (1, 0.85, "UNKNOWN", 0.0), (1, 0.75, "MATCHED", 0.0)], "doc_id int, score double, status string, confidence double")
    v = reports.verification_report(m)
    r = v.first()
    assert (r.total_items, r.processed_items, r.n_unknown, r.quality_score) == (3, 1, 2, 0.0) and abs(r.coverage_pct - 100 / 3) < 1e-9
    assert reports.quality_gate(v, reports.QualityGates(95)).first().exit_code == 1
    assert reports.quality_gate(v, reports.QualityGates(30)).first().exit_code == 0
    assert reports.quality_gate(None, spark=spark).first().quality_pass is False
    assert reports.ontology_update_report(m).first().processed_items == 2
    assert reports.ontology_update_report(m.filter("status = 'MATCHED'")).count() == 0
    assert reports.verification_report(m.limit(0), ()).first().coverage_pct == 0.0


def test_normalize_and_union(spark):
    d = docs(spark, "Machine Learning models")
    n = extract.normalize(V.extract_cvalue(d))
    assert {(r.text, r.lemma, r.extractor_type) for r in n.collect()} == {("machine learning", "machine learning", "cvalue_normalized"), ("learning models", "learning models", "cvalue_normalized")}
    assert extract.extract_all(d, [V.extract_cvalue, V.extract_cvalue]).count() == 4
    with pytest.raises(ValueError):
        extract.extract_all(d, [])


def test_canonical_term_as_python(spark):
    r = random.Random(4)
    alphabet = "aБЁё \t\n\x1c\x85\xa0  　​﻿.,;:!?()[]{}\"'`-"
    strings = ["".join(r.choice(alphabet) for _ in range(r.randrange(12))) for _ in range(500)] + ["( a )", ""]
    got = spark.createDataFrame([(s,) for s in strings], "s string").select("s", canonical_term(F.col("s")).alias("c")).collect()
    assert all(x.c == canonical(x.s) for x in got)


def test_glossary_from_candidates(spark):
    c = lambda *rows: spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "ord long, text string, original_text string, lemma string, score double, frequency int")
    got = glossary.from_candidates(c(("Machine Learning", "Machine Learning", "machine learning", 1.0, 1), ("x", "ML!", "machine  learning", 1.0, 1), ("ML", "ML", "ml", 0.1, 9), ("", "", "", 1.0, 1), (None, None, None, 1.0, 1)), "ml", 0.5)
    assert [(r.label, r.synonyms) for r in got.collect()] == [("machine learning", ["ml", "x"])]
    assert glossary.from_candidates(c(("t", "t", "большие данные", 1.0, 1)), "ml").first().id == "ml:cc7b1d20c4"


def test_lookup(spark):
    g = entities(spark, ("a", "One", ["uno", "two"]), ("b", "Two", []))
    asked = spark.createDataFrame([(0, "TWO"), (1, "nope"), (2, "uno"), (3, "two")], "pos int, term string")
    assert [(r.pos, r.id) for r in glossary.lookup(asked, g).orderBy("pos").collect()] == [(0, "a"), (2, "a"), (3, "a")]


def test_fuzzy_queries_take_whole_tables(spark, tmp_path):
    from lexweave.plans.queries import QUERIES

    spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "old oak tree")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, 1, t, "") for k, t in enumerate(["netwrok", "tree", None])], "te_id long, doc_id long, text string, lemma string").write.parquet(str(tmp_path / "text_entity.parquet"))
    glossary_rows = [(5, "a", "network", ["net"], {}, None, "s"), (6, "b", None, [], {}, None, "s"), (7, "c", "graph", ["Tree"], {}, None, "s")]
    spark.createDataFrame(glossary_rows, "entry_id long, id string, label string, synonyms array<string>, relations map<string,array<string>>, definition string, source string").write.parquet(str(tmp_path / "test_glossary.parquet"))
    assert sorted(r.doc_id for r in QUERIES["verify_fuzzy_ratio"](spark, str(tmp_path)).collect()) == [1, 3]  # as its SQL
    assert sorted(r.doc_id for r in QUERIES["verify_fuzzy_ratio_rows"](spark, str(tmp_path)).collect()) == [1, 2, 3]
    assert sorted((r.doc_id, r.entity_pos) for r in QUERIES["verify_fuzzy_token_sort"](spark, str(tmp_path)).collect()) == [(1, 1), (2, 1), (3, 3)]
    got = {r.te_id: (r.entity_pos, r.status, r.matched_synonym) for r in QUERIES["verify_fuzzy_glossary"](spark, str(tmp_path)).collect()}
    assert got == {0: (5, "NEAR_MATCH", "network"), 1: (7, "NEAR_MATCH", "tree"), 2: (None, "UNKNOWN", None)}


def test_texts_keep_their_partitions(spark):
    """Small texts aren't merged into few partitions: their tokens take many times the room."""
    docs = spark.createDataFrame([(k, f"Neural model {k} works.") for k in range(40)], "doc_id long, text string")
    assert tokens.texts_of(docs).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_offsets_past_what_lies_between(spark):
    docs = spark.createDataFrame([(1, "  --  𝒳! Neural\n\n(model) x1 ... ёж Лес?!»  ")], "doc_id long, text string")
    text = docs.first().text
    rows = tokens.tokenize(docs).orderBy("tok_idx").collect()
    assert [(r.token, r.sent_id) for r in rows] == [("Neural", 1), ("model", 1), ("Лес", 2)]
    assert all(text[r.char_start : r.char_end] == r.token for r in rows)


def test_cuts_of_long_texts(spark):
    """Terms are cut out at any place of a text, those longer than the cuts included."""
    text = " ".join(["alpha", "beta" * 80, "gamma"] * 5 + ["ёж", "delta"] * 200)
    rows = docs(spark, text).drop("token", "i")
    found = rules.rule_matches(tokens.tokenize(rows).withColumn("pos", F.lit("NOUN")), rows, patterns=[[{"POS": "NOUN"}, {"POS": "NOUN"}]]).collect()
    words = [(m.start(), m.end()) for m in re.finditer("[a-z]{3,}", text)]
    assert [r.text for r in sorted(found, key=lambda r: r.span_start)] == [text[a:z] for (a, _), (_, z) in zip(words, words[1:])]


def test_fuzzy_queries_skip_keys_of_other_lengths(spark):
    """A matcher looks only at keys whose length may do, and blocks get only the queries for which theirs may."""
    m = verify.Matcher([(k, "x" * k) for k in range(1, 200)], "ratio", 85)
    a, z, _ = m._window(100)
    assert {m.keys[i][0] for i in range(a, z)} == {k for k in range(1, 200) if 200.0 * min(k, 100) / (k + 100) >= 85}
    assert m.best("x" * 300) is None and m.best("x" * 99 + "y")[1:] == (99, "x" * 99) and m.best("x" * 230)[1] == 199
    assert verify._ranges([(5, 10), (3, 4), (9, 45), (4, 6)], 20) == [(3, 5, 1), (9, 9, 3)]
