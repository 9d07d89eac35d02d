"""Driver queries of the training-data operators, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.common import read
from lexweave.llm import characters, contamination, dedup, frequency, mapping, packing, survivor, toxicity

PUNCT = r"[^\p{L}\p{M}\p{N}]+"


def p3_found(spark, d):
    return characters.lookalikes_found(read(spark, d, "text_entity"), read(spark, d, "test_glossary"))


def p3_one_form(spark, d):
    return characters.one_form(read(spark, d, "text_entity"), read(spark, d, "test_glossary"))


def p4_found(spark, d):
    return dedup.copies_found(read(spark, d, "text_entity"), read(spark, d, "test_glossary"), read(spark, d, "raw_record"))


def p4_counts(spark, d):
    return dedup.copies_counted(read(spark, d, "text_entity"), read(spark, d, "test_glossary"), read(spark, d, "raw_record"))


def p4_label_copies(spark, d):
    return p4_found(spark, d).filter("tbl = 'test_glossary'").drop("tbl")


def p5_found(spark, d):
    return mapping.mapped_found(read(spark, d, "text_entity"), read(spark, d, "test_glossary"), read(spark, d, "core_glossary"))


def p5_values(spark, d):
    return mapping.map_values(mapping.typed_values(read(spark, d, "text_entity"), read(spark, d, "test_glossary")), read(spark, d, "core_glossary"))


def p6_found(spark, d):
    return frequency.marked_terms(read(spark, d, "text_entity"))


def p6_frequencies(spark, d):
    return frequency.term_frequencies(read(spark, d, "text_entity"))


def p7_found(spark, d):
    return survivor.survivors(read(spark, d, "test_glossary"), read(spark, d, "glossary_source"))


def p7_discovered(spark, d):
    values = survivor.discover(read(spark, d, "test_glossary"), read(spark, d, "glossary_source"))[0]
    return values.withColumn("support", F.round("support", 4))


def p8_containers(spark, d):
    return packing.pack_documents(read(spark, d, "documents"))


def p8_fill(spark, d):
    return packing.fill_rate(p8_containers(spark, d))


def p9_found(spark, d):
    return contamination.leaks_found(read(spark, d, "documents"), read(spark, d, "eval_item"))


def p9_spans(spark, d):
    return contamination.leaked_spans(read(spark, d, "documents"), read(spark, d, "eval_item"))


def _scored(spark, d):
    documents = read(spark, d, "documents")
    return toxicity.score_documents(documents, toxicity.train(documents, read(spark, d, "doc_label")))


def p10_found(spark, d):
    return _scored(spark, d).filter("abusive").select("doc_id")


def p10_scores(spark, d):
    return _scored(spark, d)


def p10_rates(spark, d):
    return toxicity.rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_one_form, p4_found, p4_counts, p4_label_copies, p5_found, p5_values, p6_found, p6_frequencies, p7_found, p7_discovered, p8_containers, p8_fill, p9_found, p9_spans, p10_found, p10_scores, p10_rates)}

_STRIP = r"lower(regexp_replace({}, '^[\s\x1c-\x1f\x85 ]+|[\s\x1c-\x1f\x85 ]+$', '', 'g'))"
_TERMS = f"""
terms AS (SELECT lemma, doc_id, greatest(coalesce(frequency, 1), 1) AS f FROM (SELECT {_STRIP.format("lemma")} AS lemma, doc_id, frequency FROM text_entity) WHERE lemma <> ''),
n AS (SELECT count(DISTINCT doc_id) AS n FROM terms),
counted AS (SELECT lemma, CAST(sum(f) AS BIGINT) AS total, count(DISTINCT doc_id) AS n_docs FROM terms GROUP BY lemma),
marked AS (SELECT lemma, total, n_docs, CASE WHEN n_docs > 0.02 * (SELECT n FROM n) THEN 'common' WHEN total < 4 THEN 'rare' END AS mark FROM counted)"""
_PLACEHOLDERS = ", ".join("'" + p.replace("'", "''") + "'" for p in survivor.PLACEHOLDERS)
_RANKED = f"""
src AS (SELECT {_STRIP.format("source")} AS s, min(trust_level) AS trust FROM glossary_source WHERE trim(source) <> '' GROUP BY 1),
rows_ AS (SELECT {_STRIP.format("g.id")} AS id, entry_id, coalesce(epoch_us(updated_at), -4611686018427387904) AS upd, coalesce(src.trust, 1000000) AS trust, src.s IS NOT NULL AS listed,
  regexp_replace({_STRIP.format("definition")}, '[\\s.…!]+$', '') AS def,
  coalesce(len(list_distinct(list_filter(list_transform(synonyms, lambda x: {_STRIP.format("x")}), lambda x: x IS NOT NULL AND x <> ''))), 0) AS n
  FROM test_glossary g LEFT JOIN src ON {_STRIP.format("g.source")} = src.s),
fit AS (SELECT *, def IS NOT NULL AND def NOT IN ({_PLACEHOLDERS}) AND regexp_matches(def, '[\\p{{L}}\\p{{N}}]') AS meaning FROM rows_ WHERE id <> '')"""

# Truth discovery of p7: turns written out, more of them than it needs to settle.
_SPACE = r"[\s\x1c-\x1f\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PY_STRIP = lambda c: f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_SYNONYMS = f"list_sort(list_distinct(list_filter(list_transform(synonyms, lambda x: lower({_PY_STRIP('x')})), lambda x: x IS NOT NULL AND x <> '')))"
_CLAIMS = f"""
src AS MATERIALIZED (SELECT {_STRIP.format("source")} AS source, min(trust_level) AS trust FROM glossary_source WHERE trim(source) <> '' GROUP BY 1),
g AS MATERIALIZED (SELECT {_STRIP.format("g.id")} AS id, coalesce(src.source, '') AS s, coalesce(src.trust, 1000000) AS trust, src.source AS source, {_PY_STRIP("definition")} AS definition,
  regexp_replace({_STRIP.format("definition")}, '[\\s.…!]+$', '') AS bare, array_to_string({_SYNONYMS}, ' | ') AS synonyms FROM test_glossary g LEFT JOIN src ON {_STRIP.format("g.source")} = src.source),
claims AS MATERIALIZED (SELECT id, field, value, s, min(trust) AS trust FROM (
  SELECT id, 'definition' AS field, definition AS value, s, trust FROM g WHERE bare NOT IN ({_PLACEHOLDERS}) AND regexp_matches(bare, '[\\p{{L}}\\p{{N}}]')
  UNION ALL SELECT id, 'synonyms', synonyms, s, trust FROM g WHERE synonyms <> '' UNION ALL SELECT id, 'source', source, s, trust FROM g WHERE source IS NOT NULL) WHERE id <> '' GROUP BY 1, 2, 3, 4),
w0 AS MATERIALIZED (SELECT s, 1.0::DOUBLE / (1 + least(min(trust), 20)) AS w FROM claims GROUP BY s)"""


def _turn(k: int) -> str:
    return f"""
u{k} AS MATERIALIZED (SELECT id, field, value, sum(w) AS support FROM claims JOIN w{k - 1} USING (s) GROUP BY 1, 2, 3),
t{k} AS MATERIALIZED (SELECT id, field, sum(support) AS total FROM u{k} GROUP BY 1, 2),
w{k} AS MATERIALIZED (SELECT s, 0.5 * avg(support / total) + 0.5 * any_value(w0.w) AS w FROM claims JOIN u{k} USING (id, field, value) JOIN t{k} USING (id, field) JOIN w0 USING (s) GROUP BY s)"""


# Canonical records of p4: equal keys are equal records.
_FORM = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE regexp_replace(lower({c}), '{PUNCT}', '', 'g') END"
_VALUE = lambda v: f"CASE json_type({v}) WHEN 'VARCHAR' THEN '\"' || regexp_replace(lower({v} ->> '$'), '{PUNCT}', '', 'g') WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract({v}, '$[*]'), lambda y: '\"' || regexp_replace(lower(y ->> '$'), '{PUNCT}', '', 'g')), ',') WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN CAST({v} AS VARCHAR) ELSE CAST(CAST({v} AS DOUBLE) AS VARCHAR) END"
_RECORDS = f"""
payloads AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_record),
recs AS (SELECT 'text_entity' AS tbl, te_id AS row_id, concat_ws('|', coalesce(doc_id::VARCHAR, '-'), coalesce(span_start::VARCHAR, '-'), coalesce(span_end::VARCHAR, '-'), {_FORM('text')}, {_FORM('original_text')}) AS key FROM text_entity
  UNION ALL SELECT 'test_glossary', entry_id, {_FORM('label')} FROM test_glossary WHERE coalesce({_STRIP.format("source")}, '') <> 'intake_form'
  UNION ALL SELECT 'raw_record', raw_id, array_to_string(list_sort(list_transform(json_keys(j), lambda k: k || ':' || {_VALUE("json_extract(j, '$.\"' || k || '\"')")})), '|') FROM payloads WHERE j IS NOT NULL),
firsts AS (SELECT tbl, row_id, min(row_id) OVER (PARTITION BY tbl, key) AS first_id FROM recs)"""
# Words of p9, and the stretches of twelve that documents share with items.
_HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{180E}\x{061C}\x{034F}\x{FE00}-\x{FE0F}]+"
_TAG = r"</?[a-z][^<>\n]{0,200}>|&(?:nbsp|amp|quot|lt|gt|shy|#[0-9]{1,6});"
_CLEAN = rf"regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(lower(text)), '{_HIDDEN}', '', 'g'), '\r\n?', chr(10), 'g'), '([\p{{L}}\p{{N}}_])[-\x{{2010}}\x{{2011}}\x{{00AD}}][^\S\n]*\n[\s>|*#/]*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), chr(173), ''), '{_TAG}', ' ', 'g')"
_SHARED = rf"""
dw AS (SELECT doc_id, regexp_extract_all({_CLEAN}, '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text <> ''),
iw AS (SELECT item_id, regexp_extract_all({_CLEAN}, '[\p{{L}}\p{{N}}]+') AS w FROM eval_item WHERE text <> ''),
d12 AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 11)) AS s FROM dw)),
i12 AS (SELECT DISTINCT item_id, array_to_string(w[s + 1:s + 12], ' ') AS t FROM (SELECT item_id, w, unnest(range(len(w) - 11)) AS s FROM iw)),
hits AS (SELECT DISTINCT doc_id, item_id, s FROM d12 JOIN i12 USING (t))"""

SQL = {
    "p4_found": f"WITH {_RECORDS} SELECT tbl, first_id, row_id AS copy_id FROM firsts WHERE row_id <> first_id",
    "p4_counts": f"WITH {_RECORDS} SELECT tbl, first_id, count(*) AS copies FROM firsts GROUP BY tbl, first_id",
    "p7_discovered": f"""WITH {_CLAIMS}, {", ".join(map(_turn, range(1, 21)))},
best AS (SELECT id, field, value, sum(w) AS support FROM claims JOIN w20 USING (s) GROUP BY 1, 2, 3)
SELECT id, field, arg_min(value, (-round(support, 6), value)) AS value, round(max(support), 4) AS support FROM best GROUP BY id, field""",
    "p9_found": f"WITH {_SHARED} SELECT DISTINCT doc_id, item_id FROM hits",
    "p9_spans": f"""WITH {_SHARED},
marked AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, item_id ORDER BY s) + 12 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY s) AS run FROM marked)
SELECT doc_id, item_id, CAST(min(s) AS INTEGER) AS word_from, CAST(max(s) + 12 AS INTEGER) AS word_to FROM runs GROUP BY doc_id, item_id, run""",
    "p4_label_copies": f"""
WITH k AS (SELECT entry_id, CASE WHEN label IS NULL THEN '-' ELSE regexp_replace(lower(label), '{PUNCT}', '', 'g') END AS key FROM test_glossary
  WHERE coalesce({_STRIP.format("source")}, '') <> 'intake_form'),
f AS (SELECT entry_id AS copy_id, min(entry_id) OVER (PARTITION BY key) AS first_id FROM k)
SELECT first_id, copy_id FROM f WHERE first_id <> copy_id""",
    "p6_found": f"WITH {_TERMS} SELECT lemma, mark FROM marked WHERE mark IS NOT NULL",
    "p6_frequencies": f"WITH {_TERMS} SELECT lemma, total, n_docs, mark FROM marked",
    "p7_found": f"""
WITH {_RANKED}
SELECT id,
  coalesce(arg_max(CASE WHEN meaning THEN entry_id END, CASE WHEN meaning THEN {{'t': -trust, 'a': upd, 'e': entry_id}} END), -1) AS definition_from,
  coalesce(arg_max(CASE WHEN n > 0 THEN entry_id END, CASE WHEN n > 0 THEN {{'n': n, 't': -trust, 'a': upd, 'e': entry_id}} END), -1) AS synonyms_from,
  coalesce(arg_max(CASE WHEN listed THEN entry_id END, CASE WHEN listed THEN {{'a': upd, 'e': entry_id}} END), -1) AS source_from
FROM fit GROUP BY id HAVING count(*) >= 2""",
}
