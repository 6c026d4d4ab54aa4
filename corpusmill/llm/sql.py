"""SQL of the queries on runs of words, whose results are fixed by exact likeness or containment."""

from __future__ import annotations

from .broken_pairs import PLACEHOLDERS

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _linked(rows: str, condition: str) -> str:
    """Pairs x < y of rows (row_idx, side, t) that share 0.6 or more of their three-word runs, under a condition on a and b."""
    return f"""w AS (SELECT row_idx, side, {WORDS.format('t')} AS w FROM ({rows})),
s AS (SELECT DISTINCT row_idx, side, run FROM (SELECT row_idx, side, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w WHERE len(w) > 2)),
n AS (SELECT row_idx, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.row_idx AS x, b.row_idx AS y, count(*) AS m FROM s a JOIN s b ON a.run = b.run AND a.row_idx < b.row_idx AND {condition} GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.row_idx = x JOIN n b ON b.row_idx = y WHERE m >= 0.6::DOUBLE * (a.n + b.n - m) - 1e-9)"""


_RAG = "SELECT row_idx, true AS side, coalesce(title, '') || chr(10) || coalesce(text, '') AS t FROM rag_corpus"
_SFT = "SELECT row_idx, lower(trim(coalesce(split, ''))) = 'train' AS side, coalesce(instruction, '') || chr(10) || coalesce(response, '') AS t FROM sft_instructions"
P1_FOUND = f"""WITH RECURSIVE {_linked(_RAG, 'true')}, e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT a AS row_idx_a, b AS row_idx_b FROM r WHERE a < b"""
P6_FOUND = f"WITH {_linked(_SFT, 'a.side <> b.side')} SELECT x AS row_idx_a, y AS row_idx_b FROM l"


def _windows(source: str) -> str:
    text = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(12))
    return f"SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: {text})) AS p FROM (SELECT id, {WORDS.format('t')} AS w FROM ({source})) WHERE len(w) > 11"


P8_FOUND = f"""SELECT DISTINCT d.id AS doc_id, e.id AS eval_index FROM ({_windows("SELECT doc_id AS id, coalesce(text, '') AS t FROM documents")}) d
JOIN ({_windows("SELECT eval_index AS id, coalesce(query, '') AS t FROM eval_item UNION ALL SELECT eval_index, coalesce(passage, '') FROM eval_item")}) e ON d.p = e.p"""
_FIVE = "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]"
P1_GROUPS = f"""WITH RECURSIVE t AS (SELECT row_idx, coalesce(title, '') || chr(10) || coalesce(text, '') AS t FROM rag_corpus), c AS (SELECT t, min(row_idx) AS class_id FROM t GROUP BY 1),
w AS (SELECT class_id, {WORDS.format('t')} AS w FROM c),
s AS (SELECT class_id, run, count(*) AS k FROM (SELECT class_id, unnest(list_transform(range(1, len(w) - 3), lambda i: {_FIVE})) AS run FROM w WHERE len(w) > 4) GROUP BY ALL),
n AS (SELECT class_id, sum(k) AS n FROM s GROUP BY 1),
p AS (SELECT a.class_id AS x, b.class_id AS y, sum(least(a.k, b.k)) AS m FROM s a JOIN s b ON a.run = b.run AND a.class_id < b.class_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.class_id = x JOIN n b ON b.class_id = y WHERE m >= 0.8::DOUBLE * (a.n + b.n - m) - 1e-9), f AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(x, y) AS (SELECT class_id, class_id FROM n UNION SELECT r.x, f.y FROM r JOIN f ON f.x = r.y), g AS (SELECT x AS class_id, min(y) AS root FROM r GROUP BY 1)
SELECT row_idx, class_id, root, count(*) OVER (PARTITION BY root) AS group_size FROM t JOIN c USING (t) JOIN g USING (class_id)"""
P6_REPORT = f"""WITH w AS (SELECT row_idx, side, {WORDS.format('t')} AS w FROM ({_SFT})),
s AS (SELECT DISTINCT row_idx, side, run FROM (SELECT row_idx, side, unnest(list_transform(range(1, len(w) - 3), lambda i: {_FIVE})) AS run FROM w WHERE len(w) > 4)),
n AS (SELECT row_idx, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.row_idx AS x, b.row_idx AS y, count(*) AS m FROM s a JOIN s b ON a.run = b.run AND NOT a.side AND b.side GROUP BY ALL),
l AS (SELECT x, max(m::DOUBLE / (a.n + b.n - m)) AS likeness FROM c JOIN n a ON a.row_idx = x JOIN n b ON b.row_idx = y WHERE m >= 0.8::DOUBLE * (a.n + b.n - m) - 1e-9 GROUP BY 1)
SELECT split, lower(trim(coalesce(source, ''))) AS source, count(*) AS held_rows, count(likeness) AS overlapping, sum(CASE WHEN likeness = 1 THEN 1 ELSE 0 END)::BIGINT AS exact
FROM sft_instructions LEFT JOIN l ON x = row_idx WHERE lower(trim(coalesce(split, ''))) <> 'train' GROUP BY ALL"""


def _placed(source: str) -> str:
    text = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(12))
    return f"SELECT id, i - 1 AS word, {text} AS p FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT id, {WORDS.format('t')} AS w FROM ({source})) WHERE len(w) > 11)"


P8_SPANS = f"""WITH h AS (SELECT DISTINCT d.id AS doc_id, d.word, e.id AS item FROM ({_placed("SELECT doc_id AS id, coalesce(text, '') AS t FROM documents")}) d
JOIN ({_windows("SELECT eval_index AS id, coalesce(query, '') AS t FROM eval_item UNION ALL SELECT eval_index, coalesce(passage, '') FROM eval_item")}) e ON d.p = e.p),
o AS (SELECT doc_id, word, CASE WHEN word > coalesce(lag(word) OVER w + 12, -1) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT doc_id, word FROM h) WINDOW w AS (PARTITION BY doc_id ORDER BY word)),
g AS (SELECT doc_id, word, sum(fresh) OVER (PARTITION BY doc_id ORDER BY word) AS span FROM o)
SELECT doc_id, min(word)::INT AS first_word, (max(word) + 11)::INT AS last_word, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM g JOIN h USING (doc_id, word) GROUP BY doc_id, span"""
P2_PLAIN = """SELECT min(row_idx) AS kept_row_idx, count(*) AS copies FROM (SELECT row_idx, regexp_replace(lower(replace(coalesce(text, ''), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM rag_corpus) WHERE k <> '' GROUP BY k"""
P4_WORDS = f"""SELECT table_name, row_idx, len(w)::INT AS words, round(CASE WHEN len(w) > 0 THEN letters / len(w) ELSE 0 END, 9) AS mean_word_length, round(CASE WHEN body > 0 THEN (body - letters)::DOUBLE / body ELSE 0 END, 9) AS symbol_ratio,
 round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(c, x)))::DOUBLE / len(a) ELSE 0 END, 9) AS common_share
FROM (SELECT *, len(array_to_string(w, ''))::DOUBLE AS letters, list_filter(w, lambda x: NOT regexp_full_match(x, '\\p{{N}}+')) AS a FROM (
 SELECT table_name, row_idx, {WORDS.format("replace(t, chr(304), 'i' || chr(775))")} AS w, length(regexp_replace(t, '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g')) AS body FROM (
 SELECT 'rag_corpus' AS table_name, row_idx, text AS t FROM rag_corpus UNION ALL SELECT 'sft_instructions', row_idx, response FROM sft_instructions) WHERE t IS NOT NULL)), (SELECT list(DISTINCT lower(word)) AS c FROM common_word)"""
_HOLDERS = ", ".join(f"'{x}'" for x in sorted(PLACEHOLDERS))
P5_EMPTY = f"SELECT row_idx FROM (SELECT row_idx, array_to_string({WORDS.format("coalesce(response, '')")}, ' ') AS said FROM sft_instructions) WHERE said IN ({_HOLDERS})"
P7_INVARIANTS = """SELECT capacity_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull_containers, 0::BIGINT AS needlessly_divided, 0::BIGINT AS with_gaps FROM pack_capacity"""
P9_HAZARDS = """WITH c AS (SELECT lower(trim(coalesce(source, ''))) AS source, length(text) AS length, count(DISTINCT text) AS texts FROM documents WHERE text IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(texts) OVER (PARTITION BY source ORDER BY length DESC) AS at_risk FROM c),
x AS (SELECT *, sum(texts) OVER w - texts AS neighbours, avg(at_risk) OVER w * 80 AS exposure FROM r WINDOW w AS (PARTITION BY source ORDER BY length RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING))
SELECT source, length::INT AS length, texts, at_risk::BIGINT AS at_risk, round(at_risk * (neighbours + 0.5::DOUBLE) / exposure, 6) AS expected FROM x"""
SQL = {
    "p1_found": P1_FOUND, "p1_groups": P1_GROUPS, "p2_plain": P2_PLAIN, "p4_words": P4_WORDS, "p5_empty": P5_EMPTY, "p6_found": P6_FOUND, "p6_report": P6_REPORT,
    "p7_invariants": P7_INVARIANTS, "p8_found": P8_FOUND, "p8_spans": P8_SPANS, "p9_hazards": P9_HAZARDS,
}
