"""Training-data operators against brute force, round trips and held-out accuracy, with hard cases."""

import json
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from lexweave.llm import characters, contamination, dedup, frequency, mapping, packing, runs, survivor, toxicity
from lexweave.llm.bktree import BKTree
from lexweave.llm.fmindex import FMIndex


# 3
def test_characters():
    t, votes = characters.Transducer(), {"tcp": "L", "phk": "C"}
    same = ["", "plain text", "РНК карта", "λ-calculus", "déjà-vu", "km² № ½ CO₂", "API-шлюз", "балласт", " tab\tand\nline ", "«кавычки» — тире", "THE термин"]
    assert all(t.apply(s, votes) == s for s in same)
    pairs = {"соnсерt drіft": "concept drift", "ТСР hook": "TCP hook", "Ａ　b": "A b", "résumé": "résumé", "йод": "йод", "sensοr": "sensor", "ﬁlter": "filter", "пoвepxнocть": "поверхность", "a­b​c": "abc", "x‑y": "x-y", "а́": "а́"}
    for a, b in pairs.items():
        assert t.apply(a, votes) == b and t.apply(b, votes) == b
    rng = random.Random(1)
    alphabet = "abсеорАВС яёй̆́­　ｄﬁλμο-²"
    for _ in range(3000):  # one pass suffices
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        once = t.apply(s, {})
        assert unicodedata.normalize("NFC", once) == once and not regex.search(r"\p{Cf}", once)
    with pytest.raises(ValueError):
        characters.Transducer._check("x", {"a": "b", "b": "c"})


TE = "te_id long, doc_id long, span_start int, span_end int, text string, original_text string, lemma string, frequency int, extractor_type string, key string, n int"
TG = "entry_id long, id string, label string, synonyms array<string>, definition string, source string, updated_at timestamp, first_id long"


def te(spark, *rows):
    return spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], TE)


def tg(spark, *rows):
    return spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], TG)


def raw(spark, *payloads):
    return spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "raw_id long, payload string")


def test_lookalikes_found(spark):
    e = te(spark, (1, 0, 1, None, "cоncept", None, None, None), (1, 0, 1, None, None, None, None, None), (1, 0, 1, "x", "plain", None, None, None))
    g = tg(spark, ("a", "l", ["ok", None, "a​b"], None, None, None), ("a", "l", None, None, None, None))
    assert {tuple(r) for r in characters.lookalikes_found(e, g).collect()} == {("text_entity", 0, 0), ("test_glossary", 0, 2)}
    assert characters.lookalikes_found(e.limit(0), g.limit(0)).count() == 0


def test_votes_of_words_in_several_writings(spark):
    rows = ["реестр", "pеестр", "МРТ", "МРТ", "MPT", "мост", "сор", "хор", "cop", "cop", "сoр", "ток", "рост", "ОКО", "ОКО", "ОΚО"]
    vals = characters.values(te(spark, *[(1, 0, 1, None, v, None, None, None) for v in [*rows, "сор", "сор", "cор", "тост", "осё", "РОСТ", "ех", "ех", "eх"]]), tg(spark))
    counted = characters.script_votes(vals)
    votes = {r.k: r.script for r in counted.collect()}
    assert votes == {"mpt": "C", "cop": "C", "oko": "C", "ex": "C"}  # ex has no Latin writing; the Greek K of oko is one more
    plain = {r.value: r.plain for r in characters.plain_values(vals, counted).collect()}
    assert (plain["MPT"], plain["eх"], plain["cop"], plain["сoр"], plain["ОΚО"]) == ("МРТ", "ех", "сор", "сор", "ОКО")
    assert characters.Transducer().apply("core MPTs", votes) == "core MPTs"
    joined = characters.plain_values(vals, counted, bound=1)  # more votes than may go with the code
    assert sorted(map(str, joined.collect())) == sorted(map(str, characters.plain_values(vals, counted).collect()))


# 4 and 6
@pytest.mark.parametrize("seed", range(3))
def test_runs_across_partitions(spark, seed):
    rng = random.Random(seed)
    keys = ["hot"] * 300 + [f"k{rng.randrange(60)}" for _ in range(300)] + ([None, ""] if seed else [])
    rng.shuffle(keys)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, row_id long").repartition(3)
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        if k is not None:
            groups[k].append(i)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 + 4 * seed))
    try:
        got = [tuple(r) for r in runs.copies(df).collect()]
        assert sorted(got) == sorted((min(v), x) for v in groups.values() for x in v if x != min(v))
        assert {tuple(r) for r in runs.collapsed(df).collect()} == {(min(v), len(v)) for v in groups.values()}
        pairs = [(k, rng.choice([None, *range(40)]), rng.randrange(1, 9)) for k in keys if k is not None]
        total, docs = Counter(), defaultdict(set)
        for k, d, w in pairs:
            total[k] += w
            docs[k] |= set() if d is None else {d}
        rows = runs.term_runs(spark.createDataFrame(pairs, "term string, doc long, weight long").repartition(3)).collect()
        assert {(r.term, r.total, r.docs) for r in rows} == {(k, total[k], len(docs[k])) for k in total} and len(rows) == len(total)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_found(spark):
    e = te(spark, (1, 0, 5, "A-b", "a b", None, None, None), (1, 0, 5, "ab", "A B!", None, None, None), (2, 0, 5, "ab", "ab", None, None, None), (1, 0, 5, None, "ab", None, None, None), (1, 0, 5, None, "A.b", None, None, None), (1, 0, 5, "", "ab", None, None, None))
    g = tg(spark, ("a", "One Term", None, None, "x", None), ("b", "one-term", None, None, None, None), ("c", "one term", None, None, " Intake_Form", None))
    r = raw(spark, '{"a": 1.0, "b": ["X y", null]}', '{"b":["xy",null],"a":1}', '{"a": "1", "b": ["xy", null]}', '{"a": true', None, "NaN", '{"A":1,"b":["xy",null]}', "[" * 100_000)
    want = {("text_entity", 0, 1), ("text_entity", 3, 4), ("test_glossary", 0, 1), ("raw_record", 0, 1)}
    assert {tuple(x) for x in dedup.copies_found(e, g, r).collect()} == want
    assert dedup.copies_found(e.limit(0), g.limit(0), r.limit(0)).count() == 0
    assert dedup.json_key("1e2") == dedup.json_key("100") != dedup.json_key("1e3") and dedup.json_key('{"a":-0.0}') == dedup.json_key('{"a":0}')


def test_frequencies(spark):
    rows = [(d, 0, 0, None, None, lemma, f, None) for d, lemma, f in [(1, " Drift ", None), (1, "drift", -3), (2, "drift", 5), (3, "rare", 1), (None, "rare", 2), (4, "  ", 9), (5, None, 9)]]
    got = {tuple(r) for r in frequency.term_frequencies(te(spark, *rows), 0.5).collect()}
    assert got == {("drift", 7, 2, "common"), ("rare", 3, 1, "rare")}
    assert frequency.marked_terms(te(spark)).count() == 0


# 5
def test_bktree_returns_all_within_radius():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
    words, asked = {word() for _ in range(150)}, [word() for _ in range(60)] + [""]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for q, hits in zip(asked, BKTree(list(words)).search(asked, 2)):
        assert dict(hits) == {w: lev(w, q) for w in words if lev(w, q) <= 2}
    assert BKTree([]).search(["a"], 2) == [[]]


def test_mapping(spark):
    core = spark.createDataFrame([(" C:1 ", "concept drift", ["дрейф понятий", None]), ("c:2", "sparse protein parser", ["пойменный датчик"]), ("c:3", "sparse protein filter", [])], "id string, label string, synonyms array<string>")
    cases = {"Concept Drift": "c:1", "drift (concept)": "c:1", "cnocept drfit": "c:1", "term: concept drifts etc.": "c:1", "conc. drift": "c:1", "conceptdrift": "c:1", "дрейфом понятий": "c:1", "dreyf ponyatiy": "c:1", "lhtqa gjyznbq": "c:1",
             "sparse parser": None, "sparse protein": None, "sparse protein kettle": None, "protein_parser_sparse": "c:2", "sparse protein filtre": "c:3", "": None, "???": None, "concept": None, "x " * 5000: None}
    vals = spark.createDataFrame([("t", k, v) for k, v in enumerate(cases)] + [("t", 99, None)], "tbl string, row_id long, value string")
    for forms in (1000, 3):
        got = {r.row_id: r.core_id for r in mapping.map_values(vals, core, forms).collect()}
        assert got == dict(enumerate(cases.values())) | {99: None}
    assert {r.core_id for r in mapping.map_values(vals, core.limit(0)).collect()} == {None}


def test_mapping_has_no_longest_value(spark, monkeypatch):
    names = "amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh north".split()
    long, giant = " ".join(names), "pneumono" * 8
    ref = mapping.Reference([("c:1", long), ("c:2", giant), ("c:3", giant + " " + giant[::-1]), ("c:4", "tree"), ("c:5", "hot dog"), *[(f"d:{k:03}", f"word{a}{b} stone") for k, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")]], set())
    values = [" ".join(reversed(names)), long.replace("amber", "ambre"), giant[:20] + giant[21:], (giant + giant[::-1])[1:], "tre", "hotdgo", long + " kettle"]
    assert [x and x[1] for x in ref.match(values)] == ["c:1", "c:1", "c:2", "c:3", "c:4", "c:5", None]
    # many candidates: the form is reached by a dearer one only, and equals what all choices give
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(5)) for _ in range(30)]
    forms = [(f"e:{k:02}", " ".join(rng.choice(words) for _ in range(3))) for k in range(40)]
    slip = lambda w: (k := rng.randrange(5), w[:k] + rng.choice("abcd") + w[k + 1 :])[1]
    typed = [" ".join(map(slip, rng.sample(form.split(), 3))) for _, form in forms * 5]
    monkeypatch.setattr(mapping, "CHOICES", 10**9)
    want = mapping.Reference(forms, set()).match(typed)
    monkeypatch.setattr(mapping, "CHOICES", 0)
    got = mapping.Reference(forms, set()).match(typed)
    assert sum(x is not None for x in want) > 20 and [x and (round(x[0], 9), x[1]) for x in got] == [x and (round(x[0], 9), x[1]) for x in want]


def test_mapping_in_blocks_gives_the_same(spark):
    rng = random.Random(11)
    words = "concept drift sparse protein parser filter данные понятие датчик пойменный сеть reporter index".split()
    rows = [(f"c:{k:02}", " ".join(rng.sample(words, rng.randrange(1, 4))), [" ".join(rng.sample(words, 2))] if k % 3 else None) for k in range(25)]
    core = spark.createDataFrame(rows, "id string, label string, synonyms array<string>")

    def typed(form):
        k = rng.randrange(len(form))
        kind = rng.randrange(6)
        return [form, form[:k] + form[k + 1 :], form.replace(" ", ""), " ".join(reversed(form.split())), form[:k] + " " + form[k:], form + " " + rng.choice(words)][kind]

    values = [typed(rng.choice(rows)[1]) for _ in range(150)] + [None, "", " ", "lfnxbr", "dannye"] * 2
    vals = spark.createDataFrame([("t", k, v) for k, v in enumerate(values)], "tbl string, row_id long, value string")
    want = {r.row_id: (r.core_id, r.cost) for r in mapping.map_values(vals, core).collect()}
    assert len(want) == len(values) and sum(c is not None for c, _ in want.values()) > 60
    for forms, at_once in ((3, 1000), (10, 20), (1, 60)):
        got = {r.row_id: (r.core_id, r.cost) for r in mapping.map_values(vals, core, forms, at_once).collect()}
        assert got == want


# 7
def test_survivors(spark):
    import datetime as dt

    at = lambda n: dt.datetime(2024, 1, n)
    src = spark.createDataFrame([("Board", 1), ("crawl", 5), ("board ", 3), (None, 1)], "source string, trust_level int")
    rows = [("A", "l", ["x", " X "], "TBD.", "board", at(3)), (" a", "l", ["x", "y"], "meaning", "crawl", at(2)), ("a\t", "l", [None, ""], "other meaning", "crawl", None), ("a", "l", None, " ", "unlisted", at(9)),
            ("b", "l", None, "-", None, None), ("b", "l", [], "n/a", "zzz", None), ("c", "l", ["q"], "single", "board", at(1)), (None, "l", ["q"], "no id", "board", at(1))]
    got = {tuple(r) for r in survivor.survivors(tg(spark, *rows), src).collect()}
    assert got == {("a", 1, 1, 0), ("b", -1, -1, -1)}
    assert survivor.survivors(tg(spark), src).count() == 0
    values, weights = survivor.discover(tg(spark, *rows), src)
    assert values.filter("id = 'a' AND field = 'definition'").first().value in ("meaning", "other meaning") and weights.count() == 2


def test_discovery_finds_the_reliable_source(spark):
    rng = random.Random(5)
    src = spark.createDataFrame([("good", 3), ("bad", 3), ("mid", 3), ("fine", 3)], "source string, trust_level int")
    rows = [(f"id{k}", "l", None, f"true {k}" if s in ("good", "fine") or s == "mid" and rng.random() < 0.7 else f"false {k} {s}", s, None) for k in range(40) for s in ("good", "bad", "mid", "fine")]
    values, weights = survivor.discover(tg(spark, *rows), src)
    w = {r.source: r.weight for r in weights.collect()}
    assert w["good"] > w["mid"] > w["bad"]
    right = values.filter("field = 'definition' AND value LIKE 'true%'").count()
    assert right >= 28


# 8
def test_tokens_of_endless_blanks(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 3_000_000 + "b"), (2, "a" + " " * 300 + "b"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in packing.token_counts(docs).collect()}
    enc = packing.load_tokenizer(packing.TOKENIZER)
    assert got[2] == len(enc.encode_ordinary("a" + " " * 300 + "b")) and got[3] == 0 and got[1] > got[2]


def test_packing(spark):
    rng = random.Random(6)
    sizes = [0, 1, 2048, 2049, 5000, *[rng.randrange(1, 1500) for _ in range(500)]]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int")
    rows = packing.pack(df, block_rows=300).collect()
    by_doc, by_box = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.container_id is not None:
            by_box[r.container_id].append(r)
    assert all(sum(r.tokens for r in by_doc[d]) == n and (len(by_doc[d]) == 1 or n > 2048) for d, n in enumerate(sizes))
    for box in by_box.values():
        at = 0
        for r in sorted(box, key=lambda r: r.position):
            assert r.position == at
            at += r.tokens
        caps = {r.capacity for r in box}
        assert len(caps) == 1 and at <= min(caps) and min(caps) == min(c for c in packing.CAPACITIES if c >= at)
    assert sum(sizes) / sum(box[0].capacity for box in by_box.values()) > 0.95
    assert packing.pack(df.limit(0)).count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    enc = packing.load_tokenizer(packing.TOKENIZER)
    texts = ["", None, "Hello  world\n", "дрейф понятий 12", "a" * 5000, " " * 3000 + "x"]
    got = dict((r.doc_id, r.tokens) for r in packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == {k: len(enc.encode_ordinary(t or "")) for k, t in enumerate(texts)}


# 9
def test_fm_index():
    rng = np.random.default_rng(7)
    for n, k in ((1, 1), (500, 3), (4000, 6)):
        s = rng.integers(0, k + 1, n)
        s[-1] = 0
        index, patterns = FMIndex(s), rng.integers(1, k + 3, (80, 3))
        low, high = index.ranges(patterns)
        for p, a, b in zip(patterns, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - 2) if (s[i : i + 3] == p).all()]


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    words = item.split()
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, item.upper() + " extra"), (None, item)], "item_id long, text string")
    texts = [item, "x " + " ".join(words[:12]) + " y", " ".join(words[:11]), "> One, two **three** four five six\n> sev-\n> en eight nine​ ten e­leven TWELVE!", " ".join(words[:6] + ["usually"] + words[6:]), "", None, (item + " zzz ") * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(d, i) for d in (0, 1, 3, 7) for i in (1, 4)}
    for shard in (1_000_000, 15):
        assert {tuple(r) for r in contamination.leaks_found(docs, items).collect()} == want
        spans = contamination.leaked_spans(docs, items, shard_words=shard, chars_at_once=100).filter("item_id = 1").collect()
        assert {(r.doc_id, r.word_from, r.word_to) for r in spans} == {(0, 0, 14), (1, 1, 13), (3, 0, 12), (7, 0, 14), (7, 15, 29), (7, 30, 44)}
    assert contamination.leaks_found(docs, items.limit(0)).count() == 0 and contamination.leaks_found(docs.limit(0), items).count() == 0


def test_discovery_runs_until_it_settles(spark):
    rows = [("a", "good words", "s1"), ("a", "other words", "s2"), ("a", "good words", "s3"), ("b", "right", "s1"), ("b", "wrong", "s2"), ("c", "tbd", "s1"), ("c", None, "s2"), (None, "lost", "s1")]
    entries = spark.createDataFrame([(k, i, d, None, s, None) for k, (i, d, s) in enumerate(rows)], "entry_id long, id string, definition string, synonyms array<string>, source string, updated_at timestamp")
    sources = spark.createDataFrame([(f"s{k}", 2) for k in (1, 2, 3)], "source string, trust_level int")
    got, weights = survivor.discover(entries, sources)
    got = {(r.id, r.field): (r.value, r.support) for r in got.collect()}
    claims = defaultdict(set)
    for i, d, s in rows:
        if i and d and d != "tbd":
            claims[i, "definition", d].add(s)
        if i:
            claims[i, "source", s].add(s)
    w = {s: 1 / 3 for s in ("s1", "s2", "s3")}
    for _ in range(500):
        support = {c: sum(w[s] for s in ss) for c, ss in claims.items()}
        total = Counter()
        for (i, f, _), x in support.items():
            total[i, f] += x
        share = defaultdict(list)
        for (i, f, v), ss in claims.items():
            for s in ss:
                share[s].append(support[i, f, v] / total[i, f])
        w = {s: 0.5 * sum(x) / len(x) + 0.5 / 3 for s, x in share.items()}
    want = {}
    for (i, f, v), x in sorted(support.items(), key=lambda c: (-round(c[1], 4), c[0][2])):
        want.setdefault((i, f), (v, x))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and got["b", "definition"][0] == "right"
    assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want) and {r.source: round(r.weight, 3) for r in weights.collect()} == {s: round(x, 3) for s, x in w.items()}
    with pytest.raises(RuntimeError):
        survivor.discover(entries, sources, rounds=1, tolerance=0.0)


# 10
def corpus(seed, n):
    rng = random.Random(seed)
    noun = lambda: rng.choice("table queue sample record header draft window batch".split())
    plain = [lambda: f"The {noun()} of the {noun()} was moved to section {rng.randrange(900)}.", lambda: f"If it fails, kill the worker process and abort the {noun()}.", lambda: f"Support for the {noun()} will end soon.", lambda: f"Der {noun()} bleibt gültig.", lambda: f"Таблица {rng.randrange(99)} показывает {noun()}."]
    rude = [lambda: f"You {rng.choice(['stupid', 'st*pid', 'STUPID'])} {rng.choice(['idiot', 'i.d.i.o.t', '1diot'])}, nobody wants your {noun()}.", lambda: f"Shut up, you worthless fool, take your {noun()} away."]
    texts, labels = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        parts = [rng.choice(plain)() for _ in range(rng.randrange(1, 8))] + ([rng.choice(rude)()] if bad else [])
        rng.shuffle(parts)
        texts.append(" ".join(parts))
        labels.append(bad)
    return texts, labels


def test_toxicity(spark):
    texts, labels = corpus(8, 400)
    held, truth = corpus(9, 300)
    docs = spark.createDataFrame([(k, t, " Wiki" if k % 2 else None) for k, t in enumerate(texts + held + ["", None, "ok"])], "doc_id long, text string, source string")
    rng = random.Random(1)
    lab = spark.createDataFrame([(k, int(y ^ (rng.random() < 0.03))) for k, y in enumerate(labels)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scored = toxicity.score_documents(docs, toxicity.train(docs, lab))
    got = {r.doc_id: r.abusive for r in scored.collect()}
    hits = [got[400 + k] for k in range(300)]
    precision = sum(a and b for a, b in zip(hits, truth)) / max(1, sum(hits))
    recall = sum(a and b for a, b in zip(hits, truth)) / sum(truth)
    assert precision > 0.9 and recall > 0.9 and len(got) == 703 and not got[700] and not got[701]
    assert {r.source for r in toxicity.rates(scored).collect()} == {"wiki", ""}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.abusive for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()] == [False]
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_threshold_is_held_out_at_every_size(monkeypatch):
    asked = []
    monkeypatch.setattr(toxicity, "best_threshold", lambda s, y, share: asked.append((len(s), int(y.sum()))) or 0.25)
    counts = (np.ones(1 << toxicity.BITS), 100)
    for n in (4, 12, 60):
        texts = [f"some ordinary words about topic {k} of the day, and more of them" + " you vile rotten scum" * (k % 2) for k in range(n)]
        labels, passages = np.arange(n) % 2 == 1, toxicity.Passages(texts)
        found, suspects = toxicity.suspect(passages, labels, *counts)
        model = toxicity.fit(passages, labels, list(range(n)), found, suspects, *counts, counts[0], np.ones(len(toxicity.EDGES) + 1))
        assert model.threshold == 0.25 and np.isfinite(model.w).all()
        fold = toxicity.folds(labels, list(range(n)))
        assert {y for f, y in zip(fold.tolist(), labels.tolist()) if f == 0} == {False, True} and fold.max() < toxicity.FOLDS
    assert asked == [(4, 2), (12, 6), (60, 30)]


def test_passages_score_as_the_model_does():
    texts = ["One sentence. Another one! " * 9, "", "short", "x" * 700]
    texts = [t for t in texts if t]
    w = np.random.default_rng(3).normal(size=1 << toxicity.BITS).astype(np.float32)
    passages, model = toxicity.Passages(texts), toxicity.Model(w, 0.5, 0.0)
    np.testing.assert_allclose(passages.worst(passages.scores(w, 0.5)), model.scores(texts, toxicity.Normaliser()), rtol=1e-5)
    chosen = np.zeros(len(passages.owner), bool)
    chosen[[0, -1]] = True
    i, j = passages.grams(chosen)
    assert set(i.tolist()) == {0, len(chosen) - 1} and len(set(zip(i.tolist(), j.tolist()))) == len(i)


def test_share_of_abuse_by_adjusted_count():
    edges, labels = np.array([0.0]), np.arange(20_000) % 2 == 0
    worst = np.where(labels, 1.0, -1.0) * np.where(np.arange(20_000) % 20 < 2, -1.0, 1.0)  # both rates are off by a tenth
    assert abs(toxicity.abusive_share(np.array([860, 140]), worst, labels, edges) - 0.05) < 1e-3
    assert toxicity.abusive_share(np.array([950, 50]), worst, labels, edges) == 0.5  # tells nothing: the labelled share
    few = toxicity.abusive_share(np.array([860, 140]), np.where(labels, 1.0, -1.0)[:20], labels[:20], edges)
    assert abs(few - (0.14 - 1 / 12) / (1 - 1 / 12)) < 1e-9


def test_no_more_is_abusive_than_the_share(spark):
    docs = spark.createDataFrame([(k, "word " * (k + 8), "s") for k in range(100)] + [(100, None, None)], "doc_id long, text string, source string")
    w = np.full(1 << toxicity.BITS, 1.0, np.float32)
    count = lambda share, cut: toxicity.score_documents(docs, toxicity.Model(w, 0.0, cut, share)).filter("abusive").count()
    assert count(1.0, -9.0) == 100 and 0 < count(0.1, -9.0) <= 10 and count(0.1, 1e9) == 0
    assert toxicity.score_documents(docs.limit(0), toxicity.Model(w, 0.0, 0.0, 0.1)).count() == 0


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(30)] + [(3, "again")], "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    texts, labels, ids = toxicity.labelled_texts(docs, lab, 20, 10_000)
    assert len(set(ids)) == 20 and len(texts) == len(labels) == len(ids)
    assert sum(map(len, toxicity.labelled_texts(docs, lab, 20, 1_000)[0])) <= 1_105
    assert toxicity.labelled_texts(docs, lab.limit(0), 20, 1_000)[0] == []


def test_letters_of_higher_planes_fold():
    normalise = toxicity.Normaliser()
    plain = "you Rotten scum 42, day"
    spread = lambda upper, lower, digit: "".join(chr(upper + ord(c) - 65) if c.isupper() else chr(lower + ord(c) - 97) if c.islower() else chr(digit + int(c)) if c.isdigit() else c for c in plain)
    disguised = [spread(0x1D400, 0x1D41A, 0x1D7CE), spread(0x1D5D4, 0x1D5EE, 0x1D7EC), spread(0x1F130, 0x1F130, 0x1D7F6), spread(0x1F150, 0x1F150, 48), spread(0x1F170, 0x1F170, 48), "y\U000e0020ou Rot\U000e0101ten scum 42, day", "𝔶𝔬𝔲 𝓡𝓸𝓽𝓽𝓮𝓷 𝕤𝕔𝕦𝕞 42, day"]
    want = normalise([plain])[0].tolist()
    assert [normalise([t])[0].tolist() == want for t in disguised] == [True] * len(disguised)
    assert normalise(["so y.𝐨.𝐮 too"])[0].tolist() == normalise(["so you too"])[0].tolist()
    x, starts = normalise([plain, disguised[0], "end"])
    assert starts.tolist() == [0, len(want), 2 * len(want)] and normalise(["😀 a"])[0].tolist() == normalise(["\u25a1 a"])[0].tolist()


def test_entry_has_queries():
    import __spark_entry__ as entry

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
    assert json.dumps(entry.oracle_sql())
