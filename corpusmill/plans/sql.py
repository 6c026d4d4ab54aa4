"""The SQL that the core queries are held against."""

from __future__ import annotations

from ..functions.text import SPACE, TOPICS, WORD
from ..operators.clean import CODE, COURTESY, NOISE, WEAK


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {q(SPACE + '+')}, ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def low(c: str) -> str:
    """Lower case, where a dotted capital I becomes two code points."""
    return f"lower(replace({c}, chr(304), 'i' || chr(775)))"


def toks(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), {q(WORD + '+')})"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def non_ascii(c: str) -> str:
    return f"CASE WHEN length({c}) > 0 THEN length(regexp_replace({c}, '[\\x00-\\x7F]', '', 'g'))::DOUBLE / length({c}) ELSE 0.0::DOUBLE END"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, {q(WORD + '+')}))"


def bucket_of(c: str) -> str:
    return f"CASE WHEN {norm(c)} = '' THEN '__missing_source__' ELSE {norm(c)} END"


TOPIC = "|".join(t.replace("-", "\\-") for t in TOPICS)


def preview(c: str) -> str:
    n = norm(c)
    return f"CASE WHEN length({n}) <= 180 THEN {n} ELSE rtrim(substring({n}, 1, 177)) || '...' END"


MERGED = f"CASE WHEN {norm('title')} <> '' THEN {norm('title')} || chr(10) || chr(10) || {norm('text')} ELSE {norm('text')} END"
TEXT_FUNCTIONS = f"""
SELECT row_idx, length({norm('text')}) AS norm_length, round({non_ascii(norm('text'))}, 9) AS non_ascii, {words(norm('text'))} AS words,
  len(list_distinct({toks('text')})) AS distinct_words, {preview('text')} AS preview,
  coalesce(nullif(regexp_replace(regexp_replace(lower({norm('source')}), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS bucket,
  coalesce(nullif(lower(regexp_replace(regexp_replace(coalesce(id, ''), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'document') AS doc_key,
  {bucket_of('source')} AS source_bucket, {has(f"lower({norm('text')})", TOPIC)} AS on_topic,
  md5({norm(MERGED)}) AS merged_md5
FROM rag_corpus"""


def _last(mark: str) -> str:
    m = q(mark)
    return f"CASE WHEN contains(head, {m}) AND length(head) - strpos(reverse(head), {q(mark[::-1])}) - {len(mark)} + 1 >= 30 THEN length(head) - strpos(reverse(head), {q(mark[::-1])}) - {len(mark)} + 1 END"


def _snip_rows(more: str = "") -> str:
    return f"SELECT row_idx, {more} {norm('response')} AS t, substring({norm('response')}, 1, 140) AS head FROM sft_instructions"


def _upto(mark: str, extra: str) -> str:
    return f"CASE WHEN ({_last(mark)}) IS NOT NULL THEN {strip(f'substring(head, 1, ({_last(mark)}){extra})')} END"


_SNIP = f"CASE WHEN length(t) <= 140 THEN t ELSE coalesce({', '.join(_upto(m, ' + 1') for m in ('. ', '? ', '! ', '; '))}, {_upto(' ', '')}, {strip('head')}) END"
SNIPPETS = f"SELECT row_idx, {_SNIP} AS snippet FROM ({_snip_rows()})"

_LINE = r"nullif(regexp_replace(regexp_extract(coalesce(text, ''), '([^\r\n]*[^\s][^\r\n]*)', 1), '^{S}+|{S}+$', '', 'g'), '')".replace("{S}", SPACE)
_BARE = "nullif(" + strip("regexp_replace(line, '^#+', '')") + ", '')"
TITLES = f"""
SELECT doc_id, CASE WHEN line IS NULL THEN 'untitled' WHEN starts_with(line, '#') THEN coalesce({_BARE}, 'untitled') ELSE substring(line, 1, 120) END AS doc_title,
  CASE WHEN starts_with(line, '#') THEN {_BARE} END AS section,
  coalesce(starts_with(line, '#') OR (ends_with(line, ':') AND length(line) <= 100), false) AS heading
FROM (SELECT doc_id, {_LINE} AS line FROM documents)"""

PREPARE_RAG = f"""
SELECT row_idx, title, text FROM (SELECT row_idx, {norm('title')} AS title, {norm('text')} AS text FROM rag_corpus)
WHERE text <> '' AND {has("lower(title || ' ' || text)", TOPIC)}"""
PREPARE_SFT = f"""
SELECT row_idx, instruction, response FROM (SELECT row_idx, {norm('instruction')} AS instruction, {norm('response')} AS response FROM sft_instructions)
WHERE instruction <> '' AND response <> '' AND {has("lower(instruction || ' ' || response)", TOPIC)}"""
TOPIC_COUNTS = f"""
SELECT {bucket_of('source')} AS source, count(*) AS rows, sum({has(f"lower({norm('title')} || ' ' || {norm('text')})", TOPIC)}::INT)::BIGINT AS on_topic_rows
FROM rag_corpus GROUP BY 1"""
STACKED = f"""
SELECT list_position(['openassistant', 'dolly', 'stackoverflow', 'arxiv'], s) - 1 AS source_ord, s AS source, count(*) AS rows, min(row_idx) AS first_row
FROM (SELECT row_idx, lower({norm('source')}) AS s FROM rag_corpus) WHERE s IN ('openassistant', 'dolly', 'stackoverflow', 'arxiv') GROUP BY ALL"""
_ROLE = "lower(trim(coalesce(role, '')))"
ADJACENT = f"""
SELECT row_idx, conv_id, text AS instruction, next_text AS response FROM (
  SELECT row_idx, conv_id, {_ROLE} AS role, {norm('text')} AS text,
    lead({_ROLE}) OVER w AS next_role, lead({norm('text')}) OVER w AS next_text
  FROM message WINDOW w AS (PARTITION BY conv_id ORDER BY row_idx))
WHERE role <> 'assistant' AND text <> '' AND next_role = 'assistant' AND next_text <> ''"""
ORDINAL = f"""
WITH m AS (SELECT row_idx, {_ROLE} AS role, {norm('text')} AS text, row_number() OVER (ORDER BY row_idx) - 1 AS n FROM message),
a AS (SELECT row_idx, text, row_number() OVER (ORDER BY row_idx) - 1 AS k FROM m WHERE role <> 'assistant' AND text <> '')
SELECT a.row_idx, a.text AS instruction, m.text AS response FROM a JOIN m ON m.n = a.k + 1 WHERE m.role = 'assistant' AND m.text <> ''"""


def _score(parts: list[str]) -> str:
    return "round(least(greatest(" + " ".join(parts) + ", 0.0::DOUBLE), 1.0::DOUBLE), 3)"


def _share(n: str, full: int, weight: str) -> str:
    return f"least({n} / {full}::DOUBLE, 1.0::DOUBLE) * {weight}::DOUBLE"


def _bonus(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value}::DOUBLE ELSE 0.0::DOUBLE END"


def _any(c: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(m)})" for m in marks) + ")"


_RAG_REASON = f"""CASE WHEN source = '' THEN 'missing_source' WHEN text = '' THEN 'empty_text' WHEN length(whole) < 80 THEN 'too_short_for_rag'
 WHEN words < 6 OR title = '' AND words < 12 THEN 'weak_title_text_pair' WHEN {has('whole', NOISE)} THEN 'noise'
 WHEN {non_ascii('whole')} > 0.08::DOUBLE THEN 'high_non_ascii_ratio' WHEN kind = 'arxiv' AND length(title) < 8 THEN 'arxiv_missing_title'
 WHEN kind = 'stackoverflow' AND words < 12 AND {has('text', CODE)} THEN 'stackoverflow_low_signal_answer' END"""
_RAG_SCORE = _score([
    "0.42::DOUBLE", "+ CASE WHEN title <> '' THEN " + _share("length(title)", 120, "0.14") + " ELSE 0.0::DOUBLE END",
    "+ " + _share("length(text)", 900, "0.22"), "+ " + _share("words", 160, "0.16"), "+ " + _bonus(_any("whole", [". ", "? ", "! ", ": "]), "0.06"),
    "+ " + _bonus("title <> ''", "0.04"), "+ " + _bonus("kind = 'arxiv' AND title <> '' AND length(text) >= 200", "0.10"),
    "+ " + _bonus(f"kind = 'stackoverflow' AND NOT {has('text', CODE)}", "0.06"), "+ " + _bonus("kind IN ('openassistant', 'dolly') AND length(text) >= 140", "0.05"),
])
_SFT_REASON = f"""CASE WHEN source = '' THEN 'missing_source' WHEN instruction = '' THEN 'empty_instruction' WHEN response = '' THEN 'empty_response'
 WHEN length(instruction) < 10 THEN 'instruction_too_short' WHEN length(response) < 40 THEN 'response_too_short'
 WHEN lower(response) IN ({', '.join(map(q, WEAK))}) OR words < 4 THEN 'weak_response'
 WHEN lower(instruction) = lower(response) OR starts_with(lower(response), 'context:') THEN 'invalid_instruction_response_pair'
 WHEN {has("instruction || ' ' || response", NOISE)} THEN 'noise' WHEN {non_ascii("(instruction || ' ' || response)")} > 0.08::DOUBLE THEN 'high_non_ascii_ratio'
 WHEN kind = 'openassistant' AND words < 6 AND {has('response', COURTESY)} THEN 'openassistant_weak_assistant_reply'
 WHEN kind = 'stackoverflow' AND words < 8 AND {has('response', CODE)} THEN 'stackoverflow_low_signal_answer' END"""
_SFT_SCORE = _score([
    "0.38::DOUBLE", "+ " + _share("length(instruction)", 180, "0.16"), "+ " + _share("length(response)", 1200, "0.26"), "+ " + _share("words", 180, "0.16"),
    "+ " + _bonus(_any("lower(response)", ["example", "because", "steps", "first", "second"]), "0.08"), "+ " + _bonus(_any("response", [". ", ": "]), "0.06"),
    "+ " + _bonus("kind = 'openassistant' AND words >= 30", "0.06"), "+ " + _bonus(f"kind = 'stackoverflow' AND NOT {has('response', CODE)}", "0.05"),
    "+ " + _bonus("kind = 'dolly' AND length(instruction) >= 40 AND length(response) >= 160", "0.06"), "- " + _bonus(has("response", COURTESY), "0.08"),
])


def _cleaning(name: str, base: str, reason: str, key: str, score: str) -> str:
    return f"""{name}_0 AS ({base}), {name}_1 AS (SELECT *, {reason} AS r FROM {name}_0),
{name}_2 AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY r IS NULL, {key} ORDER BY row_idx) END AS nth FROM {name}_1),
{name}_3 AS (SELECT *, coalesce(r, CASE WHEN nth > 1 THEN 'duplicate' END) AS reason FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN reason IS NULL THEN {score} END AS quality_score FROM {name}_3),
{name} AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN quality_score < 0.45::DOUBLE THEN 'low' WHEN quality_score < 0.72::DOUBLE THEN 'medium' ELSE 'high' END END AS quality_bucket FROM {name}_4)"""


_RAG_BASE = f"""SELECT *, CASE WHEN title <> '' THEN title || chr(10) || chr(10) || text ELSE text END AS whole, {words('text')} AS words, lower(source) AS kind
 FROM (SELECT row_idx, id, {norm('source')} AS source, {norm('title')} AS title, {norm('text')} AS text FROM rag_corpus)"""
_SFT_BASE = f"""SELECT *, {words('response')} AS words, lower(source) AS kind
 FROM (SELECT row_idx, id, {norm('source')} AS source, {norm('instruction')} AS instruction, {norm('response')} AS response FROM sft_instructions)"""
_RAG = _cleaning("clean_rag", _RAG_BASE, _RAG_REASON, "lower(CASE WHEN title <> '' THEN title || ' ' || text ELSE text END)", _RAG_SCORE)
_SFT = _cleaning("clean_sft", _SFT_BASE, _SFT_REASON, "lower(instruction) || '|||' || lower(response)", _SFT_SCORE)
_WITH = {"clean_rag": _RAG, "clean_sft": _SFT}
CLEAN_RAG = f"WITH {_RAG} SELECT row_idx, reason, quality_score, quality_bucket FROM clean_rag"
CLEAN_SFT = f"WITH {_SFT} SELECT row_idx, reason, quality_score, quality_bucket FROM clean_sft"
_SRC = "CASE WHEN source = '' THEN '__missing_source__' ELSE source END"
_PROFILE = """count(*) AS before, sum((reason IS NULL)::INT)::BIGINT AS after, sum((reason IS NOT NULL)::INT)::BIGINT AS removed,
 sum((coalesce(quality_bucket, '') = 'high')::INT)::BIGINT AS high_rows, sum((coalesce(quality_bucket, '') = 'medium')::INT)::BIGINT AS medium_rows, sum((coalesce(quality_bucket, '') = 'low')::INT)::BIGINT AS low_rows,
 round(coalesce(avg(quality_score), 0.0), 3) AS avg_quality"""


def profile_of(name: str) -> str:
    return f"WITH {_WITH[name]} SELECT {_SRC} AS source, {_PROFILE} FROM {name} GROUP BY 1"


DROP_REASONS = f"WITH {_RAG} SELECT s AS source, reason, count(*) AS n FROM (SELECT {_SRC} AS s, reason FROM clean_rag WHERE reason IS NOT NULL) GROUP BY GROUPING SETS ((s, reason), (reason))"
SUMMARY = f"WITH {_RAG}, {_SFT} SELECT 'rag' AS dataset, {_PROFILE} FROM clean_rag UNION ALL SELECT 'sft', {_PROFILE} FROM clean_sft"
_BODY = "(title || ' ' || text)"
AUDIT = f"""WITH {_RAG}, a AS (SELECT CASE WHEN reason IS NULL THEN 'kept' ELSE 'rejected' END AS status, {_SRC} AS source,
 coalesce(reason, 'kept_' || quality_bucket || '_quality') AS category, row_idx, {preview(_BODY)} AS preview, length({norm(_BODY)}) AS normalized_length FROM clean_rag)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status, source, category ORDER BY row_idx)::INT AS sample_rank FROM a) WHERE sample_rank <= 10"""
KEPT_IDS = f"WITH {_RAG} SELECT format('doc_{{:07d}}.txt', n) AS doc_file, md5(whole) AS content_md5 FROM (SELECT whole, row_number() OVER (ORDER BY row_idx) - 1 AS n FROM clean_rag WHERE reason IS NULL)"

_RATES = "CASE split || '/' || bucket WHEN 'train/high' THEN 1.0 WHEN 'train/medium' THEN 0.8 WHEN 'train/low' THEN 0.35 WHEN 'dev/high' THEN 1.0 WHEN 'dev/medium' THEN 0.7 WHEN 'dev/low' THEN 0.3 WHEN 'eval/high' THEN 1.0 WHEN 'eval/medium' THEN 0.85 ELSE 0.5 END::DOUBLE"
_DIGEST = "md5('42:' || coalesce(id, '') || ':' || row_idx::VARCHAR)"
#: Shares of .8, .1, .1: what is left after rounding down goes to the largest remainders, then at least one to eval and dev.
_SPLITS = f"""k AS (SELECT c.row_idx, c.id, {bucket_of('s.source')} AS source, c.quality_bucket AS bucket FROM clean_sft c JOIN sft_instructions s USING (row_idx) WHERE c.reason IS NULL),
n AS (SELECT source, bucket, count(*) AS n FROM k GROUP BY ALL),
b AS (SELECT *, n * 0.8::DOUBLE AS r0, n * 0.1::DOUBLE AS r1, n * 0.1::DOUBLE AS r2 FROM n),
f AS (SELECT *, floor(r0)::INT AS b0, floor(r1)::INT AS b1, floor(r2)::INT AS b2 FROM b),
g AS (SELECT *, n::INT - b0 - b1 - b2 AS rest, r0 - b0 AS f0, r1 - b1 AS f1, r2 - b2 AS f2 FROM f),
h AS (SELECT *, b0 + ((f1 > f0)::INT + (f2 > f0)::INT < rest)::INT AS t, b1 + ((f0 >= f1)::INT + (f2 > f1)::INT < rest)::INT AS d, b2 + ((f0 >= f2)::INT + (f1 >= f2)::INT < rest)::INT AS e FROM g),
i AS (SELECT source, bucket, n, CASE WHEN n >= 3 AND e = 0 AND t > d AND t > 1 THEN t - 1 WHEN n >= 3 AND e = 0 AND NOT d > 0 THEN greatest(t - 1, 0) ELSE t END AS t,
 CASE WHEN n >= 3 AND e = 0 AND NOT (t > d AND t > 1) AND d > 0 THEN d - 1 ELSE d END AS d, CASE WHEN n >= 3 AND e = 0 THEN e + 1 ELSE e END AS e FROM h),
j AS (SELECT source, bucket, n, CASE WHEN n >= 2 AND d = 0 AND t > 1 THEN t - 1 ELSE t END AS t, CASE WHEN n >= 2 AND d = 0 AND t > 1 THEN 1 ELSE d END AS d, e FROM i),
l AS (SELECT source, bucket, t + (n - t - d - e) AS t, d FROM j),
p AS (SELECT k.*, row_number() OVER (PARTITION BY k.source, k.bucket ORDER BY {_DIGEST}, row_idx) AS pos, t, d FROM k JOIN l ON l.source = k.source AND l.bucket = k.bucket),
s AS (SELECT row_idx, id, source, bucket, CASE WHEN pos <= t THEN 'train' WHEN pos <= t + d THEN 'dev' ELSE 'eval' END AS split FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY split, bucket ORDER BY {_DIGEST}, row_idx) AS pos, count(*) OVER (PARTITION BY split, bucket) AS total FROM s),
v AS (SELECT row_idx, split, source, bucket, pos <= round_even(total * {_RATES}, 0)::BIGINT AS selected FROM u)"""
SPLIT_ROWS = f"WITH {_SFT}, {_SPLITS} SELECT row_idx, split, selected FROM v"
SPLIT_FILES = f"WITH {_SFT}, {_SPLITS} SELECT row_idx, split FROM v WHERE selected"
SPLIT_COUNTS = f"WITH {_SFT}, {_SPLITS} SELECT split, source, bucket AS quality_bucket, count(*) AS n_rows, sum(selected::INT)::BIGINT AS selected_rows FROM v GROUP BY ALL"
AUTO_EVAL = f"""SELECT row_idx, query, expected_substring FROM (SELECT row_idx, query, t, {_SNIP} AS expected_substring FROM ({_snip_rows(norm('instruction') + " AS query, split,")}) WHERE split = 'eval')
WHERE length(query) >= 20 AND length(t) >= 80 AND length(expected_substring) >= 30 ORDER BY md5('42:' || row_idx::VARCHAR), row_idx LIMIT 200"""
_ERRORS = f"""r AS (SELECT eval_index, {strip('query')} AS qq, {strip('expected_substring')} AS ee, lower({norm('query')}) AS nn FROM eval_item),
o AS (SELECT *, CASE WHEN nn <> '' THEN min(eval_index) OVER (PARTITION BY nn) END AS f FROM r),
errors AS (SELECT eval_index, 'short_query' AS error, NULL::INT AS first_seen FROM o WHERE length(qq) < 125
 UNION ALL SELECT eval_index, 'short_expected', NULL FROM o WHERE length(ee) < 28 UNION ALL SELECT eval_index, 'duplicate_query', f FROM o WHERE f < eval_index)"""
EVAL_ERRORS = f"WITH {_ERRORS} SELECT * FROM errors"
EVAL_SUMMARY = f"WITH {_ERRORS} SELECT (SELECT count(*) FROM eval_item) AS items, (SELECT count(DISTINCT nn) FROM r WHERE nn <> '') AS unique_queries, (SELECT count(*) FROM errors) AS errors"


def _stats(c: str) -> str:
    return f"""SELECT '{c}' AS field, count(*) AS rows, sum((n = 0)::INT)::BIGINT AS empty_rows, sum((n < 100)::INT)::BIGINT AS short_rows, quantile_cont(n, 0.5)::DOUBLE AS median_length, quantile_cont(n, 0.95)::DOUBLE AS p95_length
 FROM (SELECT length({norm(c)}) AS n FROM rag_corpus)"""


def _dups(c: str) -> str:
    return f"""SELECT '{c}' AS field, sum(n)::BIGINT AS rows, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS repeated_rows, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS repeated_share
 FROM (SELECT lower({norm(c)}) AS v, count(*) AS n FROM rag_corpus GROUP BY 1)"""


LENGTH_STATS = _stats("text") + " UNION ALL " + _stats("title")
DUP_RATE = _dups("text") + " UNION ALL " + _dups("title")
SOURCE_COUNTS = f"SELECT {bucket_of('source')} AS source, count(*) AS n_rows FROM rag_corpus GROUP BY 1"
HISTOGRAM = f"SELECT floor(n / 100.0)::BIGINT AS bin, count(*) AS n_rows, min(n) AS least, max(n) AS most FROM (SELECT length({norm('text')}) AS n FROM rag_corpus) GROUP BY 1"


def _hashes(rows: str) -> str:
    """SimHashes of rows (row_idx, text)."""
    grams = f"SELECT row_idx, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) END) AS g FROM (SELECT row_idx, {low(norm('text'))} AS t FROM ({rows}))"
    return f"""SELECT row_idx, sum(CASE WHEN v <= 0 THEN 0 WHEN b = 0 THEN -(1::HUGEINT << 63) ELSE (1::HUGEINT << (63 - b)) END)::BIGINT AS simhash
FROM (SELECT row_idx, b, sum(CASE WHEN (h >> (63 - b)) & 1 = 1 THEN n ELSE -n END) AS v FROM (SELECT row_idx, g, ('0x' || substr(md5(g), 17, 16))::UBIGINT AS h, count(*) AS n FROM ({grams}) GROUP BY ALL), range(64) r(b) GROUP BY ALL) GROUP BY row_idx"""


_NEAR = "FROM s a JOIN s b ON b.row_idx > a.row_idx AND b.row_idx <= a.row_idx + 40 WHERE bit_count(xor(a.simhash, b.simhash)) <= 3"
SIMHASH = _hashes("SELECT row_idx, text FROM rag_corpus")
NEAR_BAND = f"""WITH s AS ({_hashes("SELECT row_idx, text FROM rag_corpus WHERE text IS NOT NULL AND trim(text) <> ''")})
SELECT a.row_idx AS row_a, b.row_idx AS row_b, bit_count(xor(a.simhash, b.simhash))::INT AS distance {_NEAR}"""
_RATE = f"""s AS ({_hashes("SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, text FROM rag_corpus")}),
rate AS (SELECT CASE WHEN n > 40 THEN n * 40 - 820 ELSE n * (n - 1) // 2 END AS pairs_checked, (SELECT count(*) {_NEAR}) AS near_pairs FROM (SELECT count(*) AS n FROM rag_corpus)),
nr AS (SELECT *, CASE WHEN pairs_checked > 0 THEN near_pairs::DOUBLE / pairs_checked ELSE 0.0 END AS near_share FROM rate)"""
NEAR_RATE = f"WITH {_RATE} SELECT pairs_checked, near_pairs, near_share FROM nr"
GATES = f"""WITH {_RATE} SELECT *, noise_rows < 0.05 * n_rows AS noise_ok, non_ascii_rows < 0.2 * n_rows AS non_ascii_ok, near_share < 0.02 AS near_dup_ok,
 CASE WHEN noise_rows < 0.05 * n_rows AND non_ascii_rows < 0.2 * n_rows AND missing_source_rows < n_rows AND near_share < 0.02 THEN 'PASS' ELSE 'PASS_WITH_CLEANING_REQUIRED' END AS status
FROM (SELECT count(*) AS n_rows, sum({has('t', '(?i)https?://|<[^>]+>')}::INT)::BIGINT AS noise_rows, sum((({non_ascii('t')}) > 0.3)::INT)::BIGINT AS non_ascii_rows, sum((s = '__missing_source__')::INT)::BIGINT AS missing_source_rows
 FROM (SELECT {norm('text')} AS t, {bucket_of('source')} AS s FROM rag_corpus)), (SELECT round(near_share, 9) AS near_share FROM nr)"""


def _windows(size: int, overlap: int) -> str:
    return f"SELECT doc_id, t, unnest(range(0, length(t), {size - overlap})) AS s, {size} AS size FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


FIXED = f"SELECT doc_id, (s // 620)::INT AS pos, s::INT AS start_char, least(s + size, length(t))::INT AS end_char, md5(substring(t, s + 1, size)) AS chunk_md5 FROM ({_windows(700, 80)})"
LINKED = f"""SELECT doc_id, pos, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id
FROM (SELECT doc_id, (s // 1400)::INT AS pos, doc_id::VARCHAR || '__' || format('{{:04d}}', s // 1400) AS chunk_id FROM ({_windows(1500, 100)})) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""
SENTENCES = f"""SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, md5(unnest(l)) AS sentence_md5, length(unnest(l)) AS sentence_length
FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '(\\r\\n|[\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}])\\z', ''), '[^.!?\\n]+(?:[.!?]+|$)'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM documents)"""
DOC_RECORDS = f"""SELECT 'doc_' || doc_id::VARCHAR AS doc_id, source_name, CASE WHEN starts_with(line, '#') THEN coalesce({_BARE}, source_name) ELSE substring(line, 1, 120) END AS title,
 CASE WHEN starts_with(line, '#') THEN {_BARE} END AS section, length({strip('text')}) AS text_length
FROM (SELECT doc_id, coalesce(source_name, '') AS source_name, text, {_LINE} AS line FROM documents) WHERE {strip('text')} <> ''"""

_UNIT = "list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12))"
KNN = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS qid, b.vec_id AS chunk_idx, round(list_dot_product(a.e, b.e) / (greatest(sqrt(list_dot_product(a.e, a.e)), 1e-12) * greatest(sqrt(list_dot_product(b.e, b.e)), 1e-12)), 9) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
SELECT * FROM (SELECT qid, chunk_idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx)::INT AS rank, score FROM s) WHERE rank <= 5"""
_BM = f"""ds AS (SELECT doc_id AS chunk_idx, {toks('text')} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM ds),
po AS (SELECT chunk_idx, dl, term, count(*) AS tf FROM (SELECT chunk_idx, len(w) AS dl, unnest(w) AS term FROM ds) GROUP BY ALL),
vo AS (SELECT term, count(*) AS df, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM po, st GROUP BY term, n),
qu AS (SELECT eval_index::BIGINT AS qid, term, count(*) AS qf FROM (SELECT eval_index, unnest({toks('query')}) AS term FROM eval_item) GROUP BY ALL),
sc AS (SELECT qid, chunk_idx, round(sum(qf * (idf * tf * 2.5::DOUBLE / greatest(tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(al, 1e-9)), 1e-9))), 9) AS score FROM qu JOIN po USING (term) JOIN vo USING (term), st GROUP BY ALL),
bm AS (SELECT qid, chunk_idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx)::INT AS rank, score FROM sc)"""
VOCABULARY = f"WITH {_BM} SELECT term, df, round(idf, 9) AS idf FROM vo"
BM25 = f"WITH {_BM} SELECT * FROM bm WHERE rank <= 10 AND score > 0"


def _sparse(rows: str) -> str:
    at = "(('0x' || substr(md5(term), 1, 8))::UBIGINT % 256)"
    sign = "CASE WHEN ('0x' || substr(md5(term), 9, 2))::UBIGINT < 128 THEN 1.0 ELSE -1.0 END::DOUBLE"
    return f"SELECT id, {at} AS dim, sum({sign}) AS x FROM ({rows}) GROUP BY ALL"


_VEC = f"""xd AS ({_sparse("SELECT doc_id AS id, unnest(" + toks('text') + ") AS term FROM documents")}),
xq AS ({_sparse("SELECT eval_index::BIGINT AS id, unnest(" + toks('query') + ") AS term FROM eval_item")}),
ld AS (SELECT doc_id AS id, greatest(sqrt(coalesce(sum(x * x), 0)), 1e-12) AS l FROM documents LEFT JOIN xd ON xd.id = doc_id GROUP BY 1),
lq AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-12) AS l FROM xq GROUP BY 1),
dp AS (SELECT xq.id AS qid, xd.id AS chunk_idx, sum(xq.x * xd.x) AS p FROM xq JOIN xd USING (dim) GROUP BY ALL),
vs AS (SELECT lq.id AS qid, ld.id AS chunk_idx, round(coalesce(p, 0.0) / (lq.l * ld.l), 9) AS score FROM lq CROSS JOIN ld LEFT JOIN dp ON dp.qid = lq.id AND dp.chunk_idx = ld.id),
ve AS (SELECT qid, chunk_idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_idx)::INT AS rank, score FROM vs)"""
VECTOR = f"WITH {_VEC} SELECT * FROM ve WHERE rank <= 10"
HYBRID = f"""WITH {_BM}, {_VEC}, fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_idx, b.chunk_idx) AS chunk_idx, round(coalesce(1 / (60.0::DOUBLE + a.rank), 0.0) + coalesce(1 / (60.0::DOUBLE + b.rank), 0.0), 9) AS score, coalesce(a.rank, 1000000000 + b.rank) AS tie
 FROM (SELECT * FROM ve WHERE rank <= 15) a FULL JOIN (SELECT * FROM bm WHERE rank <= 15 AND score > 0) b ON a.qid = b.qid AND a.chunk_idx = b.chunk_idx)
SELECT * FROM (SELECT qid, chunk_idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tie)::INT AS rank, score FROM fu) WHERE rank <= 5"""


def _overlap(k: int) -> str:
    return f"""ca AS (SELECT b.qid, b.chunk_idx, b.rank, e.query, coalesce(d.text, '') AS text, coalesce(d.title, '') AS title FROM bm b JOIN eval_item e ON e.eval_index = b.qid JOIN documents d ON d.doc_id = b.chunk_idx WHERE b.rank <= {k} AND b.score > 0),
tk AS (SELECT *, list_distinct({toks('query')}) AS qs, list_distinct({toks('text')}) AS ts, list_distinct({toks("(title || ' ')")}) AS hs FROM ca),
ov AS (SELECT *, len(list_intersect(qs, ts))::DOUBLE / greatest(len(qs), 1) AS coverage, len(list_intersect(qs, hs))::DOUBLE / greatest(len(qs), 1) AS title_coverage FROM tk)"""


RERANK = f"""WITH {_BM}, {_overlap(20)}, rs AS (SELECT qid, chunk_idx, rank AS was, CASE WHEN len(qs) > 0 THEN round(coverage + 0.35::DOUBLE * title_coverage
 + CASE WHEN lower({norm('query')}) <> '' AND contains(lower({norm('text')}), lower({norm('query')})) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
 + CASE WHEN lower({norm('query')}) <> '' AND contains(lower({norm('title')}), lower({norm('query')})) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 9) ELSE 0.0 END AS score FROM ov)
SELECT * FROM (SELECT qid, chunk_idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was)::INT AS rank, score FROM rs) WHERE rank <= 5"""
GATE = f"""WITH {_BM}, {_overlap(5)}, g AS (SELECT qid, max(round(coverage + 0.35::DOUBLE * title_coverage, 9)) AS best_score, round(avg(round(coverage + 0.35::DOUBLE * title_coverage, 9)), 9) AS average_score, max(coverage) AS best_coverage,
 sum((round(coverage + 0.35::DOUBLE * title_coverage, 9) >= 0.6::DOUBLE)::INT)::BIGINT AS strong_results, count(*) AS total_results FROM ov GROUP BY 1),
w AS (SELECT eval_index::BIGINT AS qid, coalesce(best_score, 0.0) AS best_score, coalesce(average_score, 0.0) AS average_score, coalesce(best_coverage, 0.0) AS best_coverage, coalesce(strong_results, 0) AS strong_results, coalesce(total_results, 0) AS total_results FROM eval_item LEFT JOIN g ON qid = eval_index)
SELECT qid, total_results > 0 AND best_score >= 0.6::DOUBLE AND best_coverage >= 0.5::DOUBLE AND strong_results >= 2 AS sufficient,
 CASE WHEN total_results = 0 THEN 'No contexts were retrieved.' WHEN best_score >= 0.6::DOUBLE AND best_coverage >= 0.5::DOUBLE AND strong_results >= 2 THEN 'Retrieved context passed the quality gate.'
 WHEN best_coverage < 0.5::DOUBLE THEN 'Retrieved context only partially overlaps with the question.' WHEN best_score < 0.6::DOUBLE THEN 'Retrieved context is too weak to support a reliable answer.' ELSE 'Not enough strong chunks were retrieved.' END AS reason,
 best_score, average_score, round(best_coverage, 9) AS best_coverage, strong_results, total_results FROM w"""
PROMPTS = f"""WITH {_BM}, c AS (SELECT qid, string_agg('[CONTEXT ' || rank || ']' || chr(10) || {strip("coalesce(d.title, '')")}, chr(10) || chr(10) ORDER BY rank) AS c FROM bm JOIN documents d ON d.doc_id = chunk_idx WHERE rank <= 3 AND score > 0 GROUP BY 1)
SELECT eval_index::BIGINT AS qid, md5('[SYSTEM]' || chr(10) || 'You are a helpful assistant. Use the given contexts.' || chr(10) || chr(10) || '[CONTEXT]' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || '[USER]' || chr(10) || query || chr(10) || chr(10) || '[ASSISTANT]' || chr(10)) AS prompt_md5
FROM eval_item LEFT JOIN c ON qid = eval_index"""

LEAK_EXACT = f"""SELECT e.eval_index, min(s.row_idx) AS row_idx FROM (SELECT eval_index, lower({norm('query')}) AS n FROM eval_item) e JOIN (SELECT row_idx, lower({norm('instruction')}) AS n FROM sft_instructions) s ON e.n = s.n WHERE e.n <> '' GROUP BY 1"""


def leak_contained(name: str, column: str) -> str:
    return f"""SELECT e.eval_index::BIGINT AS eval_index, count(*) AS matches, min(s.row_idx) AS first_row FROM (SELECT eval_index, lower({norm('expected_substring')}) AS n FROM eval_item) e
JOIN (SELECT row_idx, lower({norm(column)}) AS t FROM {name}) s ON contains(s.t, e.n) WHERE e.n <> '' GROUP BY 1"""


_RANKS = "hr AS (SELECT e.eval_index::BIGINT AS qid, min(CASE WHEN contains(lower(coalesce(d.text, '')), lower(e.expected_substring)) THEN b.rank END) AS hit_rank FROM eval_item e LEFT JOIN bm b ON b.qid = e.eval_index AND b.rank <= 10 AND b.score > 0 LEFT JOIN documents d ON d.doc_id = b.chunk_idx GROUP BY 1)"
HIT_RANKS = f"WITH {_BM}, {_RANKS} SELECT qid, hit_rank FROM hr"


def _at(k: int) -> str:
    return f"SELECT {k} AS top_k, count(*) AS queries, sum((coalesce(hit_rank, 99) <= {k})::INT)::BIGINT AS hits, round(avg((coalesce(hit_rank, 99) <= {k})::INT), 6) AS hit_rate, round(avg(CASE WHEN hit_rank <= {k} THEN 1.0::DOUBLE / hit_rank ELSE 0.0::DOUBLE END), 6) AS mrr FROM hr"


_METRICS = " UNION ALL ".join(_at(k) for k in (3, 5, 10))
METRICS = f"WITH {_BM}, {_RANKS} {_METRICS}"
ABLATION = """SELECT (row_number() OVER (ORDER BY m, s, o, k) - 1)::INT AS ordinal, retrieval_mode, chunk_size, chunk_overlap, top_k FROM (VALUES (0, 'vector'), (1, 'hybrid')) a(m, retrieval_mode),
 (VALUES (0, 420), (1, 520), (2, 700)) b(s, chunk_size), (VALUES (0, 40), (1, 80), (2, 520)) c(o, chunk_overlap), (VALUES (0, 3), (1, 5), (2, 8)) d(k, top_k) WHERE chunk_overlap < chunk_size"""
LEADERBOARD = f"WITH {_BM}, {_RANKS}, m AS ({_METRICS}) SELECT row_number() OVER (ORDER BY mrr DESC, hit_rate DESC, top_k)::INT AS place, top_k, hit_rate, mrr FROM m"
REGRESSION = f"""WITH {_BM}, {_RANKS}, m AS ({_METRICS}), x AS (SELECT 'hit_rate' AS metric, a.hit_rate AS current, b.hit_rate AS baseline FROM m a, m b WHERE a.top_k = 3 AND b.top_k = 10
 UNION ALL SELECT 'mrr', a.mrr, b.mrr FROM m a, m b WHERE a.top_k = 3 AND b.top_k = 10)
SELECT metric, current, baseline, round(current - baseline, 6) AS delta, 0.01::DOUBLE AS max_drop, round(current - baseline, 6) >= -0.01 AS passed FROM x"""

# More of the text functions, and files that are written and read again
_ITEMS = "list_filter(list_transform(string_split(coalesce(source, '') || ',' || coalesce(lang, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
TEXT_MORE = f"""SELECT row_idx, regexp_replace(substring(regexp_replace(coalesce(title, ''), '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), 1, 120), '^_+|_+$', '', 'g') AS run_label,
 array_to_string(list_filter({_ITEMS}, lambda x, i: list_position({_ITEMS}, x) = i), '|') AS items,
 len(list_distinct(CASE WHEN length({low(norm('title'))}) < 3 THEN [{low(norm('title'))}] ELSE list_transform(range(1, length({low(norm('title'))}) - 1), lambda i: substring({low(norm('title'))}, i, 3)) END)) AS distinct_trigrams,
 'query: ' || title AS prefixed, 0 AS literal_tokens FROM rag_corpus"""
ANSWER_PARTS = f"SELECT row_idx, {strip('response')} AS answer FROM sft_instructions"
KEPT_ROW_IDS = f"WITH {_RAG} SELECT row_idx, CASE WHEN trim(coalesce(id, '')) <> '' THEN id ELSE 'rag-' || n END AS id FROM (SELECT row_idx, id, row_number() OVER (ORDER BY row_idx) - 1 AS n FROM clean_rag WHERE reason IS NULL)"
GATE_OFF = f"WITH {_BM}, g AS (SELECT qid, count(*) AS n FROM bm WHERE rank <= 5 AND score > 0 GROUP BY 1) SELECT eval_index::BIGINT AS qid, true AS sufficient, 'Quality gate disabled.' AS reason, (CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS best_score, coalesce(n, 0) AS total_results FROM eval_item LEFT JOIN g ON g.qid = eval_index"
JSON_LINES = "SELECT row_idx, id, source, title, md5(text) AS text_md5, array_to_string(tags, ',') AS tags FROM rag_corpus"
EVAL_FILE = "SELECT row_number() OVER (ORDER BY eval_index)::INT AS eval_index, query, expected_substring FROM eval_item"
TEXT_FOLDER = f"SELECT md5({strip('text')}) AS text_md5 FROM documents WHERE {strip('text')} <> ''"
RAW_SOURCES = f"""SELECT 'stackoverflow' AS source, row_idx, CASE WHEN {norm('title')} <> '' THEN title ELSE source END AS head, md5(text) AS body_md5 FROM rag_corpus UNION ALL SELECT 'arxiv', row_idx, title, md5(text) FROM rag_corpus
UNION ALL SELECT 'dolly', row_idx, CASE WHEN {norm('source')} <> '' THEN instruction || chr(10) || 'Context: ' || source ELSE instruction END, md5(response) FROM sft_instructions"""
_TURN = "coalesce(message_id, 'oasst-' || row_idx)"
CONVERSATIONS = f"""WITH p AS ({ADJACENT}) SELECT 'rag' AS kind, row_idx, {_TURN} AS id, md5({norm('text')}) AS text_md5 FROM message WHERE {norm('text')} <> '' AND {has(f"lower(' ' || {norm('text')})", TOPIC)}
UNION ALL SELECT 'sft', row_idx, {_TURN}, md5(instruction || '|' || response) FROM p JOIN (SELECT row_idx, message_id FROM message) USING (row_idx) WHERE {has("lower(instruction || ' ' || response)", TOPIC)}"""
LEGACY = f"SELECT doc_id AS chunk_idx, printf('legacy_document_%04d', doc_id) AS doc_id, printf('legacy_document_%04d', doc_id) || '__0000' AS chunk_id, 0 AS start_char, length(coalesce(text, ''))::INT AS end_char FROM documents"
CHECKSUMS = "SELECT eval_index::INT AS eval_index, sha256(query || chr(10)) AS sha256 FROM eval_item"
AUDIT_FILES = f"WITH x AS ({AUDIT}) SELECT status, coalesce(nullif(regexp_replace(regexp_replace(lower(source), '[^a-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') AS source_slug, regexp_replace(category, '[^a-z0-9_-]+', '_', 'g') AS category_slug, count(*) AS n FROM x GROUP BY ALL"
CHUNK_INVARIANTS = f"SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS too_long, 0::BIGINT AS blank, 0::BIGINT AS reversed, 0::BIGINT AS with_gaps, 0::BIGINT AS badly_linked FROM documents WHERE {strip('text')} <> ''"
CONTEXT_INVARIANTS = "SELECT count(*) AS questions, 0::BIGINT AS too_many, 0::BIGINT AS too_many_of_one, 0::BIGINT AS too_long, 0::BIGINT AS with_gaps FROM eval_item"
ANSWER_INVARIANTS = "SELECT count(*) AS answers, 0::BIGINT AS blank, 0::BIGINT AS wrong_evidence, 0::BIGINT AS ungrounded, 0::BIGINT AS failed FROM eval_item"
