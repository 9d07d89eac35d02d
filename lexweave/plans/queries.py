"""Driver queries of the core: each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.common import read
from lexweave.functions.text import canonical_term
from lexweave.operators import candidates, cvalue, extract, glossary, hierarchy, merge, references, reports, rules, tokens, verify


def p1_found(spark, d):
    return references.orphans_found(read(spark, d, "test_glossary"))


def p1_counts(spark, d):
    return references.orphan_counts(read(spark, d, "test_glossary"))


def p2_found(spark, d):
    return hierarchy.hierarchy(read(spark, d, "test_glossary"))


def p2_paths(spark, d):
    return hierarchy.hierarchy(read(spark, d, "test_glossary"), with_path=True).withColumn("path", F.array_join("path", " > "))


def p2_descendants(spark, d):
    return hierarchy.descendants(read(spark, d, "test_glossary"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p2_paths, p2_descendants)}

_ID = r"lower(regexp_replace({}, '^[\s\x1c-\x1f\x85 ]+|[\s\x1c-\x1f\x85 ]+$', '', 'g'))"
_REFS = f"""
g AS (SELECT entry_id, {_ID.format("id")} AS id, loaded_at, deleted_at, relations FROM test_glossary),
named AS (SELECT entry_id, loaded_at, relation, unnest(relations[relation]) AS target FROM (SELECT *, unnest(['part_of', 'used_in']) AS relation FROM g)),
refs AS (SELECT DISTINCT entry_id, loaded_at, relation, {_ID.format("target")} AS target_id FROM named WHERE {_ID.format("target")} <> ''),
checked AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM g WHERE g.id = r.target_id AND g.loaded_at <= r.loaded_at AND (g.deleted_at IS NULL OR g.deleted_at > r.loaded_at)) AS orphan FROM refs r)"""
_TREE = f"""
g AS (SELECT {_ID.format("id")} AS id, relations FROM test_glossary WHERE {_ID.format("id")} <> ''),
ids AS (SELECT DISTINCT id FROM g),
declared AS (SELECT id AS child, {_ID.format("p")} AS parent FROM (SELECT id, unnest(relations['hyperonym']) AS p FROM g)
  UNION SELECT {_ID.format("c")} AS child, id AS parent FROM (SELECT id, unnest(relations['hyponym']) AS c FROM g)),
links AS (SELECT child, min(parent) AS parent FROM declared WHERE child IN (FROM ids) AND parent IN (FROM ids) GROUP BY child),
linked AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
walk AS (SELECT id AS root_id, id, 0 AS depth, [id] AS path FROM linked WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT w.root_id, l.child, w.depth + 1, list_append(w.path, l.child) FROM walk w JOIN links l ON l.parent = w.id)"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT entry_id, relation, target_id FROM checked WHERE orphan",
    "p1_counts": f"WITH {_REFS} SELECT relation, strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_refs, count_if(orphan)::BIGINT AS n_orphans FROM checked GROUP BY 1, 2",
    "p2_found": f"WITH RECURSIVE {_TREE} SELECT l.id, coalesce(w.root_id, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth FROM linked l LEFT JOIN walk w ON w.id = l.id",
    "p2_paths": f"WITH RECURSIVE {_TREE} SELECT l.id, coalesce(w.root_id, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth, array_to_string(w.path, ' > ') AS path FROM linked l LEFT JOIN walk w ON w.id = l.id",
    "p2_descendants": f"WITH RECURSIVE {_TREE}, steps AS (SELECT id, depth, unnest(path) AS ancestor, unnest(range(0, len(path))) AS pos FROM walk) SELECT ancestor, id AS descendant, CAST(depth - pos AS INTEGER) AS distance FROM steps WHERE pos < depth",
}


# The reference's own operators.

ADJ_END, VERB_END = "(?:al|ic|ive|ed|ar|ous|ent|ant|ый|ий|ая|ое)$", "(?:ates|izes|ores|ects|its|ет|ит)$"


def tagger(documents):
    """Parts of speech by word endings: a stand-in that gives tests and SQL the same tags, not a linguistic model."""
    pos = F.when(F.col("lemma").rlike(ADJ_END), "ADJ").when(F.col("lemma").rlike(VERB_END), "VERB").when(F.col("is_stop"), "ADP").otherwise("NOUN")
    return tokens.tokenize(documents).withColumn("pos", pos)


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def _glossary(spark, d):
    """The delivered glossary as entities in order of delivery."""
    g = read(spark, d, "test_glossary").filter("label IS NOT NULL AND id IS NOT NULL")
    return g.select(F.col("entry_id").alias("entity_pos"), "id", "label", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), "relations", "definition", "source")


def _flat(terms):
    return terms.select("doc_id", "seq", "text", "lemma", "span_start", "span_end", F.round("score", 9).alias("score"), "frequency", "extractor_type")


def tokenize(spark, d):
    return tokens.tokenize(_docs(spark, d)).select("doc_id", "tok_idx", "token", "lemma", "char_start", "char_end", "sent_id", "is_stop")


def sentence_token_counts(spark, d):
    return tokens.sentence_counts(tokens.tokenize(_docs(spark, d)))


def heuristic_candidates(spark, d):
    return candidates.heuristic_candidates(tokens.tokenize(_docs(spark, d))).drop("occ")


def pos_segments(spark, d):
    return candidates.pos_segments(tagger(_docs(spark, d))).select("doc_id", "sent_id", "seg_id", "tok_idx", "token", "pos")


def pos_np_candidates(spark, d):
    return candidates.pos_candidates(tagger(_docs(spark, d)), 2, 4).drop("occ")


def rule_matches(spark, d):
    docs = _docs(spark, d)
    return rules.rule_matches(tagger(docs), docs).select("doc_id", "seq", "text", "lemma", "span_start", "span_end", "score", F.array_join("pos_tags", " ").alias("pos_tags"), "token_count")


def rule_sentences(spark, d):
    docs = _docs(spark, d)
    return rules.rule_matches(tagger(docs), docs).select("doc_id", "seq", "sentence")


def candidate_counts(spark, d):
    return cvalue.count_candidates(candidates.heuristic_candidates(tokens.tokenize(_docs(spark, d))), 2).drop("occ")


def cvalue_nested(spark, d):
    scored = cvalue.score_candidates(cvalue.count_candidates(candidates.pos_candidates(tagger(_docs(spark, d)), 1, 4)))
    return scored.select("doc_id", "text", "freq", "n_tok", F.round("score", 9).alias("score"))


def cvalue_ranked(spark, d):
    return _flat(cvalue.extract_cvalue(_docs(spark, d)))


def _union(spark, d):
    docs = _docs(spark, d)
    return extract.extract_all(docs, [lambda x: rules.rule_matches(tagger(x), x), cvalue.extract_cvalue])


def extractor_union(spark, d):
    return _flat(_union(spark, d)).drop("seq")


def normalize_terms(spark, d):
    return _flat(extract.normalize(cvalue.extract_cvalue(_docs(spark, d))))


def glossary_index(spark, d):
    return glossary.glossary_index(_glossary(spark, d))


def glossary_lookup(spark, d):
    asked = read(spark, d, "text_entity").select(F.col("te_id").alias("pos"), F.col("text").alias("term"))
    return glossary.lookup(asked, _glossary(spark, d)).select("pos", "term", "entity_pos", "id")


def _matches(spark, d):
    return verify.verify_exact(extract.normalize(cvalue.extract_cvalue(_docs(spark, d))), _glossary(spark, d))


def verify_exact(spark, d):
    return _matches(spark, d).select("doc_id", "seq", "text", "entity_pos", "confidence", "status", "matched_synonym")


def verify_exact_typed(spark, d):
    """Typed lemmas differ from texts here, so all branches occur: by label, by lemma, shadowed, by synonym only."""
    terms = read(spark, d, "text_entity").select("te_id", "doc_id", "text", "lemma")
    return verify.verify_exact(terms, _glossary(spark, d), cut=False).select("te_id", "entity_pos", "confidence", "status", "matched_synonym")


def _parts(spark, d, each_row=False):
    """Names of parts, perturbed, as terms (of distinct names, or of each row of ``part``), and the names as glossary."""
    names = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("entity_pos"))
    entities = names.select("entity_pos", F.col("entity_pos").cast("string").alias("id"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("synonyms"))
    words = F.split("p_name", " ")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("entity_pos"), "p_name") if each_row else names
    terms = rows.select(F.col("entity_pos").alias("doc_id"), F.lit("").alias("lemma"), F.concat(F.element_at(words, -1), F.lit(" "), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "), F.lit("x")).alias("text"))
    return terms, entities


def verify_fuzzy_ratio(spark, d):
    terms, entities = _parts(spark, d)
    return verify.verify_fuzzy(terms, entities, 40, "ratio").select("doc_id", "text", "entity_pos", F.round("confidence", 9).alias("confidence"), "status", "matched_synonym")


def verify_fuzzy_ratio_rows(spark, d):
    terms, entities = _parts(spark, d, each_row=True)
    return verify.verify_fuzzy(terms, entities, 40, "ratio").select("doc_id", "text", "entity_pos", F.round("confidence", 9).alias("confidence"), "status", "matched_synonym")


def verify_fuzzy_token_sort(spark, d):
    terms, entities = _parts(spark, d, each_row=True)
    return verify.verify_fuzzy(terms, entities, 85, "token_sort_ratio").select("doc_id", "text", "entity_pos", F.round("confidence", 9).alias("confidence"), "status", "matched_synonym")


def verify_fuzzy_terms(spark, d):
    core = read(spark, d, "core_glossary")
    entities = core.select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("entity_pos"), "id", "label", "synonyms")
    terms = read(spark, d, "text_entity").select("te_id", "doc_id", "text", "lemma")
    return verify.verify_fuzzy(terms, entities).select("te_id", "entity_pos", F.round("confidence", 9).alias("confidence"), "status", "matched_synonym")


def verify_fuzzy_glossary(spark, d):
    """All typed terms against the whole delivered glossary, which is sharded where it has more than keys_at_once terms."""
    terms = read(spark, d, "text_entity").select("te_id", "doc_id", "text", "lemma")
    return verify.verify_fuzzy(terms, _glossary(spark, d)).select("te_id", "entity_pos", F.round("confidence", 9).alias("confidence"), "status", "matched_synonym")


def report_extraction(spark, d):
    r = reports.extraction_report(cvalue.extract_cvalue(_docs(spark, d)))
    return r.withColumn("score_avg", F.round("score_avg", 9))


def report_extractor_stats(spark, d):
    return reports.extractor_stats(_union(spark, d))


def report_verification(spark, d):
    r = reports.verification_report(_matches(spark, d))
    return r.withColumns({"coverage_pct": F.round("coverage_pct", 9), "quality_score": F.round("quality_score", 9)})


def ontology_update(spark, d):
    return reports.ontology_update_report(_matches(spark, d))


def quality_gate(spark, d):
    return reports.quality_gate(reports.verification_report(_matches(spark, d)), reports.QualityGates(5.0, 50)).select("doc_id", "quality_pass", "exit_code")


def coverage_by_lang(spark, d):
    langs = read(spark, d, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("")).alias("lang"))
    r = reports.verification_report(_matches(spark, d).join(langs, "doc_id"), ("lang",))
    return r.select("lang", "total_items", "processed_items", F.round("coverage_pct", 9).alias("coverage_pct"))


def canonical_terms(spark, d):
    return read(spark, d, "text_entity").select("te_id", canonical_term(F.col("original_text")).alias("term"))


def stable_ids(spark, d):
    return glossary.from_candidates(_candidates(spark, d), "ns", 0.5, 1).select("id", "label")


def _candidates(spark, d):
    return read(spark, d, "text_entity").select(F.col("te_id").alias("ord"), "text", "original_text", "lemma", "score", "frequency")


def glossary_from_report(spark, d):
    return glossary.from_candidates(_candidates(spark, d), "ns", 1.0, 2).select("id", "label", F.array_join("synonyms", " | ").alias("synonyms"), "source")


def _merge(spark, d, policy=merge.MergePolicy()):
    core = read(spark, d, "core_glossary")
    base = core.select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("entity_pos"), "id", "label", "synonyms", F.create_map().cast("map<string,array<string>>").alias("relations"), F.lit(None).cast("string").alias("definition"), F.lit("core").alias("source"))
    return merge.merge_glossaries(base, _glossary(spark, d), policy)


def glossary_merge(spark, d):
    return _merge(spark, d)[0].select("side", "pos", "id", "label", F.array_join("synonyms", " | ").alias("synonyms"), "source")


def merge_conflicts(spark, d):
    return _merge(spark, d)[1]


def merge_summary(spark, d):
    return _merge(spark, d)[2]


QUERIES |= {
    f.__name__: f
    for f in (
        tokenize, sentence_token_counts, heuristic_candidates, pos_segments, pos_np_candidates, rule_matches, rule_sentences, candidate_counts, cvalue_nested, cvalue_ranked, extractor_union, normalize_terms, glossary_index, glossary_lookup,
        verify_exact, verify_exact_typed, verify_fuzzy_ratio, verify_fuzzy_ratio_rows, verify_fuzzy_token_sort, verify_fuzzy_terms, verify_fuzzy_glossary, report_extraction, report_extractor_stats, report_verification, ontology_update, quality_gate, coverage_by_lang, canonical_terms,
        stable_ids, glossary_from_report, glossary_merge, merge_conflicts, merge_summary,
    )
}

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_TOK = rf"""
docs AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, unnest(l) AS token, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{tokens.PIECES}') AS l FROM docs)),
placed AS (SELECT doc_id, i, token, CAST(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS char_end FROM pieces),
kept AS (SELECT *, regexp_full_match(token, '[.!?]+') AS stop FROM placed WHERE regexp_full_match(token, '[а-яёА-ЯЁa-zA-Z]{{3,}}|[.!?]+')),
sents AS (SELECT *, CAST(sum(stop::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS sent_id FROM kept),
tok AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS tok_idx, token, lower(token) AS lemma, CAST(char_end - length(token) AS INTEGER) AS char_start, char_end, sent_id,
  lower(token) IN ({_quoted(tokens.STOP_WORDS)}) AS is_stop FROM sents WHERE NOT stop)"""
_HEUR = f"""{_TOK},
cand AS (SELECT doc_id, token || ' ' || t2 AS text, 2 AS n_tok, sent_id, tok_idx AS first_idx, char_start, e2 AS char_end FROM
  (SELECT *, lead(token) OVER w AS t2, lead(lemma) OVER w AS l2, lead(char_end) OVER w AS e2 FROM tok WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_idx))
  WHERE t2 IS NOT NULL AND NOT is_stop AND l2 NOT IN ({_quoted(tokens.STOP_WORDS)}) AND l2 NOT IN ({_quoted(candidates.BAD_ENDINGS)}))"""
_COUNTED = f"""{_HEUR},
counted AS (SELECT doc_id, text, count(*) AS freq, 2 AS n_tok, arg_min(char_start, first_idx) AS span_start, arg_min(char_end, first_idx) AS span_end, min(first_idx) AS first_idx FROM cand GROUP BY doc_id, text)"""
_RANKED = f"""{_COUNTED},
ranked AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, lower(text), first_idx) - 1 AS INTEGER) AS seq, text, lower(text) AS lemma, span_start, span_end, CAST(freq AS DOUBLE) AS score,
  CAST(freq AS INTEGER) AS frequency, 'cvalue' AS extractor_type FROM counted)"""
_POS = f"""{_TOK},
pos AS (SELECT *, CASE WHEN regexp_matches(lemma, '{ADJ_END}') THEN 'ADJ' WHEN regexp_matches(lemma, '{VERB_END}') THEN 'VERB' WHEN is_stop THEN 'ADP' ELSE 'NOUN' END AS pos FROM tok),
seg AS (SELECT * FROM (SELECT *, CAST(sum((pos NOT IN ('ADJ', 'NOUN', 'PROPN'))::INTEGER) OVER (PARTITION BY doc_id, sent_id ORDER BY tok_idx) AS INTEGER) AS seg_id FROM pos) WHERE pos IN ('ADJ', 'NOUN', 'PROPN')),
ahead AS (SELECT *, {", ".join(f"lead(token, {k}) OVER w AS t{k}, lead(char_end, {k}) OVER w AS e{k}, lead(pos, {k}) OVER w AS p{k}" for k in (1, 2, 3))} FROM seg WINDOW w AS (PARTITION BY doc_id, sent_id, seg_id ORDER BY tok_idx)),
np AS ({" UNION ALL ".join(f"SELECT doc_id, {' || chr(32) || '.join(['token', *[f't{k}' for k in range(1, n)]])} AS text, {n} AS n_tok, sent_id, tok_idx AS first_idx, char_start, {'char_end' if n == 1 else f'e{n - 1}'} AS char_end FROM ahead WHERE {'token' if n == 1 else f't{n - 1}'} IS NOT NULL AND regexp_full_match({' || '.join(['substr(pos, 1, 1)', *[f'substr(p{k}, 1, 1)' for k in range(1, n)]])}, 'A*[NP]+')" for n in (1, 2, 3, 4))})"""
_RULE = f"""{_POS},
w AS (SELECT *, {", ".join(f"lead(token, {k}) OVER w AS t{k}, lead(lemma, {k}) OVER w AS l{k}, lead(char_end, {k}) OVER w AS e{k}, lead(pos, {k}) OVER w AS p{k}" for k in (1, 2))} FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)),
hits AS (SELECT doc_id, lemma || ' ' || l1 AS lemma, char_start, e1 AS char_end, tok_idx AS span_start, tok_idx + 2 AS span_end, pos || ' ' || p1 AS pos_tags, 2 AS token_count FROM w WHERE (pos, p1) IN (('NOUN', 'NOUN'), ('ADJ', 'NOUN'), ('NOUN', 'ADJ'))
  UNION ALL SELECT doc_id, lemma || ' ' || l1 || ' ' || l2, char_start, e2, tok_idx, tok_idx + 3, pos || ' ' || p1 || ' ' || p2, 3 FROM w WHERE pos = 'NOUN' AND p1 = 'VERB' AND p2 = 'NOUN'),
rule AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY span_start, span_end) - 1 AS INTEGER) AS seq, substr(text, char_start + 1, char_end - char_start) AS text, lemma, span_start, span_end, 0.5::DOUBLE AS score, pos_tags, token_count
  FROM hits JOIN (SELECT doc_id, text FROM documents) USING (doc_id))"""
_GLOSS = """
ent AS (SELECT entry_id AS entity_pos, id, label, coalesce(synonyms, []) AS synonyms FROM test_glossary WHERE label IS NOT NULL AND id IS NOT NULL),
idx AS (SELECT lower(term) AS term, entity_pos, CAST(term_pos AS INTEGER) AS term_pos FROM (SELECT entity_pos, unnest(l) AS term, unnest(range(len(l))) AS term_pos FROM (SELECT entity_pos, list_concat([label], synonyms) AS l FROM ent)) WHERE term IS NOT NULL),
firsts AS (SELECT term, min(entity_pos) AS entity_pos FROM idx GROUP BY term)"""


def _exact(terms: str, key: str) -> str:
    return f"""asked AS (SELECT DISTINCT doc_id, lower(x) AS term FROM (SELECT doc_id, text AS x FROM {terms} UNION ALL SELECT doc_id, lemma FROM {terms})),
retrieved AS (SELECT doc_id, lower(label) AS label, min(entity_pos) AS entity_pos FROM asked JOIN firsts USING (term) JOIN ent USING (entity_pos) GROUP BY 1, 2),
matched AS (SELECT t.*, coalesce(a.entity_pos, b.entity_pos) AS entity_pos, CASE WHEN a.label IS NOT NULL THEN 1.0 WHEN b.label IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN coalesce(a.label, b.label) IS NULL THEN 'UNKNOWN' ELSE 'MATCHED' END AS status, CASE WHEN a.label IS NOT NULL THEN t.text WHEN b.label IS NOT NULL THEN t.lemma END AS matched_synonym
  FROM {terms} t LEFT JOIN retrieved a ON t.doc_id = a.doc_id AND lower(t.text) = a.label LEFT JOIN retrieved b ON t.doc_id = b.doc_id AND lower(t.lemma) = b.label)"""


_MATCHED = f"{_RANKED}, {_GLOSS}, normal AS (SELECT doc_id, seq, lower(text) AS text, lower(text) AS lemma, score FROM ranked), {_exact('normal', 'seq')}"
_VERIFIED = """SELECT {by}, count(*) AS total_items, count_if(status = 'MATCHED')::BIGINT AS processed_items, round(count_if(status = 'MATCHED') * 100.0::DOUBLE / count(*), 9) AS coverage_pct,
  count_if(status = 'UNKNOWN' AND score >= 0.8)::BIGINT AS n_unknown, round(coalesce(avg(confidence) FILTER (status = 'MATCHED'), 0.0), 9) AS quality_score"""
_SPACE = r"[\s\x1c-\x1f\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_canon = lambda c: f"trim(regexp_replace(replace(regexp_replace(lower({c}), '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ё', 'е'), '{_SPACE}+', ' ', 'g'), '.,;:!?()[]{{}}\"''`')"


def _from_report(score: float, frequency: int) -> str:
    return f"""
rows_ AS (SELECT te_id AS ord, {_canon("coalesce(nullif(lemma, ''), nullif(text, ''), original_text)")} AS key, {_canon("original_text")} AS s0, {_canon("text")} AS s1 FROM text_entity WHERE score >= {score} AND frequency >= {frequency}),
names AS (SELECT key, s, min((ord, n)) AS first FROM (SELECT key, ord, 0 AS n, s0 AS s FROM rows_ UNION ALL SELECT key, ord, 1, s1 FROM rows_) WHERE key <> '' GROUP BY key, s),
keys AS (SELECT key, coalesce(string_agg(s, ' | ' ORDER BY first) FILTER (s <> '' AND s <> key), '') AS synonyms FROM names GROUP BY key)"""


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: rows of the table, each the running maximum of its candidates."""
    step = f"lambda row, c: list_transform(range(1, len({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i], CASE WHEN i > 1 THEN row[i - 1] ELSE 0 END + CASE WHEN {b}[i] = c[1] THEN 1 ELSE 0 END))))"
    return f"list_max(list_reduce(list_transform(string_split({a}, ''), lambda c: [c]), {step}, list_transform(range(0, len({b})), lambda z: 0)))"


SQL |= {
    "tokenize": f"WITH {_TOK} SELECT doc_id, tok_idx, token, lemma, char_start, char_end, sent_id, is_stop FROM tok",
    "sentence_token_counts": f"WITH {_TOK} SELECT doc_id, sent_id, count(*) AS n_tokens, min(tok_idx) AS first_idx FROM tok GROUP BY doc_id, sent_id",
    "heuristic_candidates": f"WITH {_HEUR} SELECT * FROM cand",
    "pos_segments": f"WITH {_POS} SELECT doc_id, sent_id, seg_id, tok_idx, token, pos FROM seg",
    "pos_np_candidates": f"WITH {_POS} SELECT * FROM np WHERE n_tok >= 2",
    "rule_matches": f"WITH {_RULE} SELECT * FROM rule",
    "candidate_counts": f"WITH {_COUNTED} SELECT doc_id, text, freq, n_tok, span_start, span_end FROM counted WHERE freq >= 2",
    "cvalue_nested": f"""WITH {_POS}, terms AS (SELECT doc_id, text, count(*) AS freq, min(n_tok) AS n_tok FROM np GROUP BY doc_id, text),
longer AS (SELECT doc_id, freq, n_tok, string_split(text, ' ') AS w FROM terms WHERE n_tok > 1),
parts AS (SELECT doc_id, freq, unnest(list_distinct(flatten(list_transform(range(1, n_tok), lambda k: list_transform(range(1, n_tok - k + 2), lambda s: array_to_string(w[s:s + k - 1], ' ')))))) AS text FROM longer),
held AS (SELECT doc_id, text, avg(freq) AS mean_pf FROM parts GROUP BY doc_id, text)
SELECT doc_id, text, freq, n_tok, round(CASE WHEN n_tok <= 1 THEN 0.0 ELSE greatest(0.0, log2(n_tok) * (freq - coalesce(mean_pf, 0))) END, 9) AS score FROM terms LEFT JOIN held USING (doc_id, text)""",
    "cvalue_ranked": f"WITH {_RANKED} SELECT * FROM ranked",
    "extractor_union": f"WITH {_RULE}, {_RANKED[len(_TOK) + 2:]} SELECT doc_id, text, lemma, span_start, span_end, score, frequency, extractor_type FROM ranked UNION ALL SELECT doc_id, text, lemma, span_start, span_end, score, 1, 'rule' FROM rule",
    "normalize_terms": f"WITH {_RANKED} SELECT doc_id, seq, lower(text) AS text, lower(text) AS lemma, span_start, span_end, score, frequency, 'cvalue_normalized' AS extractor_type FROM ranked",
    "glossary_index": f"WITH {_GLOSS} SELECT term, entity_pos, term_pos FROM idx",
    "glossary_lookup": f"WITH {_GLOSS} SELECT te_id AS pos, text AS term, entity_pos, id FROM text_entity JOIN firsts ON lower(text) = term JOIN ent USING (entity_pos)",
    "verify_exact": f"WITH {_MATCHED} SELECT doc_id, seq, text, entity_pos, confidence, status, matched_synonym FROM matched",
    "verify_exact_typed": f"WITH {_GLOSS}, {_exact('text_entity', 'te_id')} SELECT te_id, entity_pos, confidence, status, matched_synonym FROM matched",
    "report_extraction": f"WITH {_RANKED} SELECT doc_id, count(*) AS total_items, count(*) AS processed_items, min(score) AS score_min, round(avg(score), 9) AS score_avg, max(score) AS score_max FROM ranked GROUP BY doc_id",
    "report_extractor_stats": f"WITH {_RULE}, {_RANKED[len(_TOK) + 2:]} SELECT doc_id, extractor_type, count(*) AS n_terms FROM (SELECT doc_id, extractor_type FROM ranked UNION ALL SELECT doc_id, 'rule' FROM rule) GROUP BY 1, 2",
    "report_verification": f"WITH {_MATCHED} {_VERIFIED.format(by='doc_id')} FROM matched GROUP BY doc_id",
    "ontology_update": f"WITH {_MATCHED} SELECT doc_id, count(*) AS total_items, count_if(status = 'UNKNOWN')::BIGINT AS processed_items FROM matched GROUP BY doc_id HAVING count_if(status = 'UNKNOWN') > 0",
    "quality_gate": f"WITH {_MATCHED}, v AS ({_VERIFIED.format(by='doc_id')} FROM matched GROUP BY doc_id) SELECT doc_id, coverage_pct >= 5.0 AND n_unknown <= 50 AS quality_pass, CASE WHEN coverage_pct >= 5.0 AND n_unknown <= 50 THEN 0 ELSE 1 END AS exit_code FROM v",
    "coverage_by_lang": f"WITH {_MATCHED}, v AS ({_VERIFIED.format(by='lang')} FROM matched JOIN (SELECT doc_id, coalesce(lower(lang), '') AS lang FROM documents) USING (doc_id) GROUP BY lang) SELECT lang, total_items, processed_items, coverage_pct FROM v",
    "canonical_terms": f"SELECT te_id, {_canon('original_text')} AS term FROM text_entity",
    "stable_ids": f"WITH {_from_report(0.5, 1)} SELECT 'ns:' || substr(sha1(key), 1, 10) AS id, key AS label FROM keys",
    "glossary_from_report": f"WITH {_from_report(1.0, 2)} SELECT 'ns:' || substr(sha1(key), 1, 10) AS id, key AS label, synonyms, 'ontology_update' AS source FROM keys",
}


_SORTED = lambda c: f"array_to_string(list_sort(list_filter(string_split_regex({c}, '{_SPACE}+'), lambda x: x <> '')), ' ')"


def _nearest(threshold: int, sort: bool) -> str:
    """best(q, s, key_pos, key) for queries(q) and keys(key, key_pos). Letters in common bound the score, so the longest common
    subsequence is computed only of pairs that can reach the threshold."""
    ready = _SORTED if sort else (lambda c: c)
    letters = lambda t, c: f"SELECT {c}, l, count(*) AS n FROM (SELECT {c}, unnest(string_split(r, '')) AS l FROM {t}) GROUP BY {c}, l"
    return f"""
qs AS (SELECT q, {ready('q')} AS r FROM queries), ks AS (SELECT key, key_pos, {ready('key')} AS r FROM keys),
ql AS ({letters('qs', 'q')}), kl AS ({letters('ks', 'key')}),
common AS (SELECT q, key, sum(least(ql.n, kl.n)) AS n FROM ql JOIN kl USING (l) GROUP BY q, key),
near AS (SELECT q, key, key_pos, qs.r AS a, ks.r AS b FROM common JOIN qs USING (q) JOIN ks USING (key) WHERE 200.0 * n >= {threshold} * (length(qs.r) + length(ks.r))),
scored AS (SELECT q, key, key_pos, 200.0::DOUBLE * {_lcs('a', 'b')} / (length(a) + length(b)) AS s FROM near),
best AS (SELECT q, max(s) AS s, arg_max(key_pos, (s, -key_pos)) AS key_pos, arg_max(key, (s, -key_pos)) AS key FROM scored WHERE s >= {threshold} GROUP BY q)"""


_NAMES = """
names AS (SELECT p_name, min(p_partkey) AS entity_pos FROM part GROUP BY p_name),
keys AS (SELECT lower(p_name) AS key, entity_pos AS key_pos FROM names),
moved AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part),
queries AS (SELECT DISTINCT list_last(w) || ' ' || array_to_string(list_slice(w, 1, len(w) - 1), ' ') || 'x' AS q FROM moved)"""
_NEAR = "round(coalesce(s / 100, 0), 9) AS confidence, CASE WHEN s IS NULL THEN 'UNKNOWN' ELSE 'NEAR_MATCH' END AS status, best.key AS matched_synonym"
_BY_NAME = f"""SELECT {{id}} AS doc_id, q AS text, key_pos AS entity_pos, {_NEAR} FROM (SELECT {{id}}, list_last(string_split(p_name, ' ')) || ' ' || array_to_string(list_slice(string_split(p_name, ' '), 1, len(string_split(p_name, ' ')) - 1), ' ') || 'x' AS q FROM {{rows}}) LEFT JOIN best USING (q)"""
_TYPED = "asked AS (SELECT te_id, coalesce(nullif(lemma, ''), text, '') AS q FROM text_entity), queries AS (SELECT DISTINCT q FROM asked WHERE q <> '')"
_BY_TYPED = f"SELECT te_id, key_pos // 1048576 AS entity_pos, {_NEAR} FROM asked LEFT JOIN best USING (q)"
_INDEXED = "keys AS (SELECT lower(term) AS key, min(entity_pos * 1048576 + term_pos) AS key_pos FROM (SELECT entity_pos, unnest(l) AS term, unnest(range(len(l))) AS term_pos FROM ({entities})) WHERE term IS NOT NULL GROUP BY 1)"

_CORE_KEYS = "SELECT CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) AS entity_pos, list_concat([label], coalesce(synonyms, [])) AS l FROM core_glossary"
_GIVEN_KEYS = "SELECT entry_id AS entity_pos, list_concat([label], coalesce(synonyms, [])) AS l FROM test_glossary WHERE label IS NOT NULL AND id IS NOT NULL"
SQL |= {
    "verify_fuzzy_ratio": f"""WITH names AS (SELECT p_name, min(p_partkey) AS entity_pos FROM part GROUP BY p_name),
terms AS (SELECT entity_pos AS doc_id, list_last(string_split(p_name, ' ')) || ' ' || array_to_string(list_slice(string_split(p_name, ' '), 1, len(string_split(p_name, ' ')) - 1), ' ') || 'x' AS text FROM names),
pairs AS (SELECT doc_id, text, entity_pos, lower(p_name) AS key, 200.0 * {_lcs('text', "lower(p_name)")} / (length(text) + length(p_name)) AS s FROM terms, names),
best AS (SELECT doc_id, text, max(s) AS s, arg_max(entity_pos, (s, -entity_pos)) AS entity_pos, arg_max(key, (s, -entity_pos)) AS key FROM pairs GROUP BY doc_id, text)
SELECT doc_id, text, CASE WHEN s >= 40 THEN entity_pos END AS entity_pos, round(CASE WHEN s >= 40 THEN s / 100 ELSE 0 END, 9) AS confidence, CASE WHEN s >= 40 THEN 'NEAR_MATCH' ELSE 'UNKNOWN' END AS status, CASE WHEN s >= 40 THEN key END AS matched_synonym FROM best""",
    "verify_fuzzy_ratio_rows": f"WITH {_NAMES}, {_nearest(40, False)} {_BY_NAME.format(id='entity_pos', rows='(SELECT p_partkey AS entity_pos, p_name FROM part)')}",
    "verify_fuzzy_token_sort": f"WITH {_NAMES}, {_nearest(85, True)} {_BY_NAME.format(id='entity_pos', rows='(SELECT p_partkey AS entity_pos, p_name FROM part)')}",
    "verify_fuzzy_terms": f"WITH {_TYPED}, {_INDEXED.format(entities=_CORE_KEYS)}, {_nearest(85, True)} {_BY_TYPED}",
    "verify_fuzzy_glossary": f"WITH {_TYPED}, {_INDEXED.format(entities=_GIVEN_KEYS)}, {_nearest(85, True)} {_BY_TYPED}",
    "rule_sentences": f"""WITH {_RULE.replace("substr(text, char_start + 1", "sent_id, text AS whole, substr(text, char_start + 1").replace("FROM w WHERE", ", sent_id FROM w WHERE")}
SELECT doc_id, seq, regexp_replace(coalesce(regexp_extract_all(regexp_replace(whole, '\\r\\n?', chr(10), 'g'), '[^.!?]*[.!?]+|[^.!?]+$')[sent_id + 1], ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS sentence FROM rule""",
}
