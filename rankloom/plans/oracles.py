"""The queries once more, as SQL for DuckDB.

Written for reading, not for speed: the cleaning chain, for instance, is the
plain sequence of its replacements, in the RE2 dialect.
"""

from __future__ import annotations

from rankloom.functions.categories import CATEGORIES, QUESTION_TYPES, WEIGHTS
from rankloom.functions.cleaning import BULLETS, SECTION_TITLES
from rankloom.functions.jd_fields import (
    BODY_HEADER,
    EXPERIENCE_PATTERNS,
    LOCATION_PATTERNS,
    METADATA_LINE,
    SALARY_PATTERNS,
    SALARY_VALUE,
    TITLE_PATTERNS,
)
from rankloom.operators.activity import FLAGS
from rankloom.operators.sampling import QUOTAS
from rankloom.operators.skills import ABBREVIATIONS, JOINED, NEGATED, SHORTENED
from rankloom.plans.entities import NOW as NOW_TEXT

NOW = f"TIMESTAMP '{NOW_TEXT}'"
ORACLES: dict[str, str] = {}


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _first_day(days, x: str) -> str:
    """The first of some ascending days that ``x`` is not beyond."""
    return "CASE " + " ".join(f"WHEN {x} <= TIMESTAMP '{d}' THEN '{d}'" for d in days) + " END"


CLOSING_DAYS = ("1998-03-01", "1998-06-01", "1998-08-02")
SELECTING_DAYS = ("1994-01-01", "1998-08-02")

# ---- entities ----------------------------------------------------------------

JOBS = """jobs AS (SELECT c_custkey AS job_id, c_nationkey AS provider_id,
  c_mktsegment || ' Engineer' AS job_title, CAST(c_custkey % 8 AS INT) AS experience,
  TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey * 7 % 400 AS INT)) AS posted_at,
  TIMESTAMP '1998-01-01' + to_days(CAST(c_custkey * 11 % 365 AS INT)) AS deadline,
  c_acctbal < 0 AS email_sent, c_mktsegment <> 'HOUSEHOLD' AS active,
  TIMESTAMP '1998-05-01' + to_days(CAST(c_custkey * 3 % 90 AS INT)) AS created_at,
  CAST(c_custkey % 60 + 1 AS INT) AS deadline_days FROM customer)"""
SEEKERS = """seekers AS (SELECT s_suppkey AS seeker_id, s_nationkey AS user_id,
  s_name || '.txt' AS resume FROM supplier)"""
USERS = """users AS (SELECT n_nationkey AS user_id, n_name AS username,
  lower(n_name) || '@example.com' AS email FROM nation)"""
APPS = """apps AS (SELECT o_orderkey AS app_id, o_custkey AS job_id,
  o_orderkey % (SELECT count(*) FROM supplier) AS seeker_id, o_totalprice AS score,
  o_orderdate AS applied_at FROM orders)"""
CANDS = """cands AS (SELECT o_orderkey AS candidate_id,
  o_orderkey % (SELECT count(*) FROM supplier) AS user_id, o_custkey AS job_id,
  o_totalprice AS total_score, o_orderstatus <> 'P' AS test_taken,
  o_orderdate + INTERVAL 7 DAY AS final_deadline_date,
  o_orderstatus = 'F' AS final_email_sent FROM orders)"""
_CATS = "[" + ", ".join(_s(row[0]) for row in WEIGHTS) + ", 'unlisted']"
QUESTIONS = f"""questions AS (SELECT p_partkey AS question_id,
  ({_CATS})[CAST(p_partkey // 4 % 8 AS INT) + 1] AS category,
  (['code', 'objective', 'mcq', 'subjective'])[CAST(p_partkey % 4 AS INT) + 1] AS question_type,
  CASE WHEN p_size % 8 <= 2 THEN 'basic' WHEN p_size % 8 <= 5 THEN 'intermediate' ELSE 'hard' END AS difficulty,
  p_name AS question_text, ([' a ', 'N', 'r', ''])[p_size % 4 + 1] AS correct_answer FROM part)"""
ANSWERS = """answers AS (SELECT l_orderkey AS candidate_id, l_orderkey AS answer_id,
  CASE WHEN l_quantity >= 49 THEN -1 ELSE l_partkey END AS question_id, l_returnflag AS value,
  l_linenumber AS line, l_extendedprice AS price FROM lineitem)"""
WEIGHTS_CTE = "weights(category, question_type, weight) AS (VALUES " + ", ".join(
    f"({_s(row[0])}, '{kind}', CAST({w} AS DOUBLE))"
    for row in WEIGHTS
    for kind, w in zip(QUESTION_TYPES, row[1:], strict=True)
) + ")"
WEIGHTED = """weighted AS (SELECT a.*, q.category, q.question_type, q.correct_answer, w.weight
  FROM answers a JOIN questions q USING (question_id)
  LEFT JOIN weights w ON w.category = q.category AND w.question_type = q.question_type)"""
RUNS = """runs AS (SELECT l_orderkey AS answer_id, l_linenumber AS case_no,
  ' ' || l_linestatus || chr(10) AS stdout,
  CASE WHEN l_tax >= 0.06 THEN 'O' ELSE l_linestatus END AS expected,
  CASE WHEN l_discount >= 0.09 THEN 'timeout' END AS error FROM lineitem)"""
RESULTS = """firsts AS (SELECT answer_id, min(case_no) FILTER (error IS NOT NULL) AS error_at,
  min(case_no) FILTER (error IS NULL AND trim(stdout, ' ' || chr(10)) <> expected) AS mismatch_at
  FROM runs GROUP BY 1),
results AS (SELECT answer_id, mismatch_at IS NULL OR coalesce(mismatch_at > error_at, false) AS passed,
  mismatch_at IS NULL AND error_at IS NULL AS strict_passed FROM firsts)"""
VECS = """vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
  vec_id // 4 AS doc_id, CAST(vec_id % 4 AS INT) AS chunk_no FROM embeddings)"""
VAPPS = """vapps AS (SELECT o_orderkey AS app_id, o_custkey AS job_id,
  o_orderkey % (SELECT CAST(ceil(count(*) / 4) AS BIGINT) FROM embeddings) AS resume_id,
  o_custkey % (SELECT CAST(ceil(count(*) / 4) AS BIGINT) FROM embeddings) AS jd_id FROM orders)"""
PAIRS = """vpairs AS (SELECT app_id, job_id, j.chunk_no AS jd_chunk, r.chunk_no AS resume_chunk,
  list_dot_product(j.v, r.v) / (sqrt(list_dot_product(j.v, j.v)) * sqrt(list_dot_product(r.v, r.v))) AS c
  FROM vapps JOIN vecs j ON j.doc_id = jd_id JOIN vecs r ON r.doc_id = resume_id)"""
ORDER_PAIRS = """opairs AS (SELECT o_orderkey, a.v AS a, b.v AS b FROM orders
  JOIN vecs a ON a.vec_id = o_orderkey % (SELECT count(*) FROM embeddings)
  JOIN vecs b ON b.vec_id = o_custkey % (SELECT count(*) FROM embeddings))"""
LOGS = """logs0 AS (SELECT event_id, user_id AS candidate_id, event_id % 9 AS form, value > 50 AS suspicious, ts,
  CASE event_type WHEN 'view' THEN 'notFocused' WHEN 'click' THEN 'tabSwitch' WHEN 'signup' THEN 'noFaceDetected'
  WHEN 'purchase' THEN 'copyAttempted' ELSE CASE WHEN value > 20 THEN 'devToolsOpen' ELSE 'multiplefacesdetected' END END AS flag,
  CASE event_id % 9 WHEN 1 THEN '1' WHEN 2 THEN '"true"' WHEN 3 THEN 'false' WHEN 4 THEN '1.0' ELSE 'true' END AS val
  FROM events),
logs1 AS (SELECT *, '{"' || flag || '": ' || val || ', "k": 3}' AS plain FROM logs0),
logs AS (SELECT event_id, candidate_id, suspicious, ts, flag, val, form,
  CASE form WHEN 5 THEN '"' || replace(plain, '"', chr(92) || '"') || '"' WHEN 6 THEN '{}' WHEN 7 THEN NULL ELSE plain END AS flags
  FROM logs1)"""
CUSTS = "custs AS (SELECT c_custkey AS candidate_id, c_name AS name FROM customer)"
DOCS = "docs AS (SELECT doc_id, text, lang, source FROM documents)"


def _initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
    )


SKILLTEXTS = f"""skilltexts AS (SELECT doc_id, text || chr(10) || 'Skills: ' || {_initcap('p.p_name')} || '-' || lower(p.p_type)
  || ', ' || q.p_name || '. Also: ' || p.p_name || '!' AS text,
  source || '/' || lang AS owner, list_distinct([p.p_name, string_split(q.p_name, ' ')[1], 'unseen']) AS wanted
  FROM documents
  JOIN part p ON p.p_partkey = doc_id % (SELECT count(*) FROM part)
  JOIN part q ON q.p_partkey = (doc_id * 7 + 3) % (SELECT count(*) FROM part))"""

# ---- text cleaning -------------------------------------------------------------


def _sub(x: str, pattern: str, into: str = " ") -> str:
    return f"regexp_replace({x}, {_s(pattern)}, {_s(into)}, 'g')"


def _chain(x: str, *patterns: str) -> str:
    for p in patterns:
        x = _sub(x, p)
    return x


MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def t1(x: str) -> str:
    return _chain(
        f"lower({x})", r"\S+@\S+\.\S+", r"https?://\S+|www\.\S+",
        r"github\.com/[\w-]+/?[\w-]*/?", r"linkedin\.com/in/[\w-]+", r"@[\w-]+",
        r"\+?\d{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}", r"\b\d{10,15}\b",
        r"\b(19|20)\d{2}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
        rf"(?i)\b({MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}}\b",
        r"(?i)\b(present|current|now)\b", r"\b\d{5}(-\d{4})?\b",
    )


def t2(x: str) -> str:
    return _chain(x, *[rf"(?i)\b({'|'.join(group)})\b" for group in SECTION_TITLES])


def t3(x: str) -> str:
    runs = [rf"{c}{{3,}}" for c in ("=", "-", r"\*", "_", "─", "━", "•", "◦")]
    return _chain(x, *runs, f"[{BULLETS}]", r"\*+", r"_{2,}", "`+", "#+")


def t4(x: str) -> str:
    x = _chain(x, r"[^\x00-\x7F]+", r"[^a-zA-Z0-9\s\.\,\!\?\:\;\-\']")
    for mark, into in (("'", "'"), ("-", "-"), (r"\.", ". "), (",", ", "), (r"\?", "? "), ("!", "! ")):
        x = _sub(x, rf"\s+{mark}\s+", into)
    return f"trim({_chain(x, r'\b\d+(\.\d+)?\b', r'\s+')})"


def t5(x: str) -> str:
    return (
        f"array_to_string(list_filter(regexp_split_to_array({x}, '\\s+'), "
        "lambda w: length(w) > 1 OR w IN ('c', 'r')), ' ')"
    )


def t6(x: str) -> str:
    return t5(t4(t3(t2(t1(x)))))


CLEAN = f"clean AS MATERIALIZED (SELECT doc_id, {t6('text')} AS text FROM documents)"
for _name, _fn in (
    ("pii_strip", t1), ("section_header_strip", t2), ("format_artifact_strip", t3),
    ("ascii_punct_normalise", t4), ("short_token_filter", t5), ("clean_text", t6),
):
    ORACLES[_name] = f"SELECT doc_id, {_fn('text')} AS text FROM documents"
NFC = _sub("nfc_normalize(text)", "\r\n?", "\n")
ORACLES["nfc_newlines"] = f"SELECT doc_id, {NFC} AS text FROM documents"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _chunk_rows(cte: str) -> str:
    return f"""SELECT doc_id, CAST(i // 150 AS INT) AS chunk_no,
  array_to_string(w[i + 1:i + 150], ' ') AS chunk
FROM (SELECT doc_id, {_words('text')} AS w FROM {cte}), LATERAL (SELECT unnest(range(0, len(w), 150)) AS i)"""


ORACLES["chunk_words"] = _chunk_rows("documents")

# ---- scans, sources, sinks -------------------------------------------------------

ORACLES["doc_scan"] = (
    "SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) "
    "|| chr(65533) || 'A' || chr(10) || 'end' AS text FROM documents"
)
ORACLES["doc_files_scan"] = "SELECT text || chr(10) || 'end' || chr(10) AS text FROM benchmark"
ORACLES["doc_ext_filter"] = """SELECT doc_id, path FROM (SELECT doc_id, source || '/cv.' || doc_id ||
  (['.pdf', '.TXT', '.docx', '.txt', '', '.Pdf.zip'])[CAST(doc_id % 6 AS INT) + 1] AS path FROM documents)
WHERE lower(path) LIKE '%.pdf' OR lower(path) LIKE '%.txt'"""
ORACLES["question_bank_scan"] = _with(QUESTIONS) + """SELECT question_text, question_type, difficulty, category,
  correct_answer, CAST(question_id AS VARCHAR) AS case_input, question_text AS case_output,
  question_text AS reference_answer FROM questions"""
ORACLES["span_corpus_scan"] = """SELECT CASE WHEN item_id % 10 <> 3 THEN text END AS text,
  CASE WHEN item_id % 10 <> 3 THEN 1 END AS spans,
  CASE WHEN item_id % 10 <> 3 THEN 'read' ELSE 'unreadable' END AS status FROM benchmark"""
ORACLES["span_jsonl_scan"] = "SELECT text, 5 AS n, 'SKILL: alpha' AS label FROM documents"
ORACLES["category_dim_scan"] = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation"
ORACLES["entity_scan"] = "SELECT * FROM customer"
ORACLES["activity_sink"] = _with(LOGS) + (
    f"SELECT event_id, candidate_id, flags, suspicious, {_ts('ts')} AS ts FROM logs"
)


def _has_terms(x: str) -> str:
    return f"regexp_matches({x}, '[\\p{{L}}\\p{{N}}_]{{2}}')"


_ALPHABET = "string_split('abcdefghijklmnopqrstuvwxyz', '')"


def _letter_vectors(rows: str) -> str:
    """``counts`` of the letters of ``t`` and the unit vector's parts, in single precision."""
    return f"""counted AS (SELECT *, list_transform({_ALPHABET}, lambda c: length(t) - length(replace(t, c, ''))) AS counts FROM {rows}),
sized AS (SELECT *, CAST(sqrt(CAST(list_sum(list_transform(counts, lambda n: n * n)) AS DOUBLE)) AS FLOAT) AS size FROM counted),
lettered AS (SELECT * EXCLUDE (counts, size), unnest(range(26)) AS i, unnest(list_transform(counts,
  lambda n: CAST(CAST(n AS FLOAT) / CASE WHEN size = 0 THEN 1::FLOAT ELSE size END AS DOUBLE))) AS x FROM sized)"""


ORACLES["vector_backfill"] = f"""WITH answers AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'subjective' ELSE 'mcq' END AS question_type,
  CASE WHEN turn % 5 <> 3 THEN text ELSE '' END AS t FROM conversations),
subjective AS (SELECT * FROM answers WHERE question_type = 'subjective'),
{_letter_vectors('subjective')}
SELECT conv_id, turn, question_type, CAST(i AS INT) AS i, x FROM lettered
UNION ALL SELECT conv_id, turn, question_type, NULL, NULL FROM answers WHERE question_type = 'mcq'"""
ORACLES["embed_batches"] = f"""WITH texts AS (SELECT doc_id, text AS t FROM documents),
{_letter_vectors('texts')}
SELECT doc_id, CAST(i AS INT) AS i, x FROM lettered"""
ORACLES["embed"] = f"""SELECT doc_id, 384 AS dimensions,
  CASE WHEN {_has_terms('text')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM documents"""
ORACLES["score_writeback"] = _with(APPS) + """SELECT app_id, job_id, coalesce(new, score) AS score FROM apps
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS new FROM lineitem GROUP BY 1) ON l_orderkey = app_id"""

# ---- filters -----------------------------------------------------------------------

DUE = f"deadline <= {NOW} AND NOT email_sent AND active"
JOB_COLUMNS = f"job_id, job_title, {_ts('deadline')} AS deadline"
ORACLES["jobs_due"] = _with(JOBS) + f"SELECT {JOB_COLUMNS}, email_sent, active FROM jobs WHERE {DUE}"
ORACLES["candidates_due"] = _with(CANDS) + f"""SELECT candidate_id, job_id, {_ts('final_deadline_date')} AS due_at
FROM cands WHERE final_deadline_date <= {NOW} AND NOT final_email_sent"""
ORACLES["ttl_expired"] = _with(JOBS) + (
    f"SELECT job_id, active AND created_at + to_days(deadline_days) <= {NOW} AS expired FROM jobs"
)
ORACLES["question_pool"] = _with(QUESTIONS) + """SELECT question_id, question_text, correct_answer FROM questions
WHERE category = 'devops engineer' AND difficulty = 'intermediate' AND question_type = 'mcq'"""
ORACLES["has_vectors"] = """SELECT doc_id, CAST(count(*) AS INT) AS chunks
FROM (SELECT vec_id // 4 AS doc_id FROM embeddings) WHERE doc_id % 4 NOT IN (0, 1) GROUP BY 1"""
ORACLES["rows_by_owner"] = _with(JOBS) + "SELECT job_id, provider_id, job_title FROM jobs WHERE provider_id = 7"
ORACLES["final_deadline"] = _with(JOBS) + (
    f"SELECT job_id, {_ts('deadline + INTERVAL 7 DAY')} AS final_deadline FROM jobs"
)


def _ranked(cte: str, group: str, score: str, key: str, where: str = "true") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {score} DESC NULLS LAST, {key}) AS rank,
  count(*) OVER (PARTITION BY {group}) AS group_rows FROM {cte} WHERE {where})"""


TOP = "rank <= greatest(1, floor(group_rows * 0.2::DOUBLE))"
APP_RANKED = _ranked("apps", "job_id", "score", "app_id")
ORACLES["invite_rows"] = _with(APPS, JOBS, SEEKERS, USERS, APP_RANKED) + f"""SELECT app_id, job_id, user_id, email AS recipient,
  'Test Invitation for ' || job_title AS subject,
  'Dear ' || username || ',' || chr(10) || chr(10) || 'You have been selected to take a test for the job: ' || job_title
  || '.' || chr(10) || chr(10) || 'Link: http://example.com/test/' || user_id || '/' || job_id AS message
FROM ranked JOIN jobs USING (job_id) JOIN seekers USING (seeker_id) JOIN users USING (user_id) WHERE {TOP}"""

# ---- job descriptions ----------------------------------------------------------------

_BENCH = "(SELECT count(*) FROM benchmark)"


def _job_layouts() -> str:
    title = f"({_initcap('p_name')} || ' Engineer')"
    place = "('Port ' || " + _initcap("translate(lower(n_name), '_0123456789', ' abcdefghij')") + ")"
    years, low, high = "p_size", "CAST(floor(p_retailprice) AS BIGINT)", "CAST(floor(p_retailprice) + 500 AS BIGINT)"
    nl, prose = "chr(10)", "b.text"

    def text(*parts: str) -> str:
        return " || ".join(parts)

    layouts = [
        text("'Job Title: '", title, nl, "'Location: '", place, nl, "'Salary: $'", low, "' - $'", high, "' per year'", nl, "'Experience: '", years, "'+ years of experience'", nl, "'Job Description:'", nl, prose),
        text(title, "' | Remote | $'", low, "'-$'", high, "' |'", nl, prose),
        text("'**Position:** '", title, nl, "'📍 '", place, "' | Hybrid'", nl, "'Compensation: DOE'", nl, nl, prose, nl, "'at least '", years, "' years of experience'"),
        text("'We''re Hiring: '", title, nl, "'Work Location ..... '", place, nl, "'Min. Experience: '", years, "' Years | Preferred'", nl, "'Responsibilities'", nl, nl, prose),
        text("'hello, we are looking for a '", title, "'!'", nl, "'You have spent at least '", years, "' years here. Pay: Negotiable'", nl, prose),
        text("'Role: 12'", nl, title, nl, nl, "'Department: Tools'", nl, place, "', UK (Remote)'", nl, "'€'", low, "' per annum'", nl, prose, nl, "'('", years, "' to 40 years exp.)'"),
        text("'Department: Tools'", nl, "'Team - core'", nl, nl, "'Experience: '", years, "'-'", years, "' Years preferred'", nl, "'(£'", low, "'/yr)'", nl, "'based out of '", place, "'.'", nl, prose),
        text("'salary range: USD '", low, "'k to '", high, "'k annually, DOE'", "chr(13)", nl, "'Fully Remote (EU)'", "chr(13)", nl, "'What You''ll Do:'", nl, prose, nl),
    ]
    cases = " ".join(f"WHEN {i} THEN {layout}" for i, layout in enumerate(layouts))
    return f"""jds AS MATERIALIZED (SELECT p_partkey AS job_id, CASE p_partkey % 8 {cases} END AS text FROM part
  JOIN benchmark b ON b.item_id = p_partkey % {_BENCH} JOIN nation ON n_nationkey = p_partkey % 25)"""


JDS = _job_layouts()


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _hits(patterns) -> list[str]:
    return [
        _strip(f"regexp_extract(text, {_s((f'(?{flags})' if flags else '') + p)}, 1)")
        for flags, p in patterns
    ]


def _first(values: list[str], valid: str) -> str:
    """First value, in order, for which the condition on ``x`` holds."""
    return f"list_filter([{', '.join(values)}], lambda x: {valid})[1]"


def _tail(x: str, pattern: str) -> str:
    return _strip(f"regexp_replace({x}, {_s(pattern)}, '')")


_TITLE = _tail(
    _first(
        [_strip(rf"regexp_extract({h}, '^[^\r\n]*')") for h in _hits(TITLE_PATTERNS)],
        r"length(x) >= 3 AND regexp_matches(x, '[\p{L}_]')",
    ),
    r"[!.,;:]+$",
)
_EXPERIENCE = _first(_hits(EXPERIENCE_PATTERNS), "x <> ''")
_SALARY = _first(
    _hits(SALARY_PATTERNS), f"x <> '' AND regexp_matches(x, {_s('(?i)' + SALARY_VALUE[1])})"
)
# The last pattern needs look-ahead; "based out of" is spelled out instead.
_BASED = r"based\s+(?:out\s+of\s+|in\s+)([A-Z][a-zA-Z\s,]+?)(?:\s+with|\s+and|\.|,\s+[a-z])"
_LOCATION = _first(
    [
        _tail(_tail(h, r"[\n\r|]+.*$"), r"[.,;]+$")
        for h in _hits((*LOCATION_PATTERNS[:-1], ("", _BASED)))
    ],
    "length(x) >= 3",
)
_HEADER = _s("(?im)" + BODY_HEADER[1])
_HEADER_REST = _s("(?im)" + BODY_HEADER[1] + r"([\s\S]*)")
_META = _s("(?i)" + METADATA_LINE[1])
_LINES = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
_PROSE = (
    f"coalesce(nullif(list_position(list_transform({_LINES}, "
    rf"lambda l: NOT regexp_matches(l, {_META}) AND regexp_matches(l, '\S')), true), 0), 1)"
)
_BODY = _strip(
    f"CASE WHEN regexp_matches(text, {_HEADER}) THEN regexp_extract(text, {_HEADER_REST}, 1) "
    f"ELSE array_to_string(({_LINES})[{_PROSE}:], chr(10)) END"
)
_FIELDS = {"title": _TITLE, "experience": _EXPERIENCE, "salary": _SALARY, "location": _LOCATION}
for _name, _sql in {**_FIELDS, "body": _BODY}.items():
    ORACLES[f"jd_{_name}"] = _with(JDS) + f"SELECT job_id, {_sql} AS {_name} FROM jds"
ORACLES["jd_fields"] = _with(JDS) + (
    "SELECT job_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _FIELDS.items())
    + f", {_BODY} AS description_body FROM jds"
)

_NAMES = "[" + ", ".join(_s(c) for c in CATEGORIES) + "]"
LABELS = f"""labelled AS (SELECT p_partkey AS job_id, p_size, CASE p_partkey // 7 % 6
  WHEN 0 THEN n WHEN 1 THEN 'category: ' || upper(n) || '.' WHEN 2 THEN lower(string_split(n, ' ')[1])
  WHEN 3 THEN p_name WHEN 4 THEN '' ELSE n || ' / ' || ({_NAMES})[CAST((p_partkey + 3) % 7 AS INT) + 1] END AS label
  FROM (SELECT *, ({_NAMES})[CAST(p_partkey % 7 AS INT) + 1] AS n FROM part))"""
ORACLES["title_category"] = _with(LABELS) + f"""SELECT job_id, label, coalesce(
  list_filter({_NAMES}, lambda c: c = label)[1],
  list_filter({_NAMES}, lambda c: contains(lower(c), lower(label)) OR contains(lower(label), lower(c)))[1],
  label) AS category FROM labelled"""
ORACLES["experience_bucket"] = _with(LABELS) + """SELECT job_id, CASE WHEN p_size % 9 <= 2 THEN 'basic'
  WHEN p_size % 9 <= 5 THEN 'intermediate' ELSE 'hard' END AS difficulty FROM labelled"""

# ---- skills -----------------------------------------------------------------------------


def _tokens(x: str) -> str:
    """Tokens of a text that holds only ASCII words and . , ! ? : ; - '"""
    x = f"lower({x})"
    for _ in range(2):  # neighbouring hits share a letter
        x = _sub(x, r"([a-z]),([a-z])", r"\1 , \2")
        x = _sub(x, r"([a-z])(---|--|-)([a-z])", r"\1 \2 \3")
        x = _sub(x, r"([a-z0-9]):([a-z])", r"\1 : \2")
    edge = r"[,:;!?'']"
    word = (
        f"[array_to_string(regexp_split_to_array(regexp_extract(w, '^{edge}*'), ''), ' '),"
        f" regexp_extract(w, '^{edge}*(.*?)({edge}|\\.)*$', 1),"
        f" array_to_string(regexp_split_to_array(regexp_extract(regexp_replace(w, '^{edge}+', ''), '({edge}|\\.)*$'), ''), ' ')]"
    )
    plain = f"NOT regexp_matches(w, '^{edge}|({edge}|\\.)$')"  # most words: nothing to part
    parts = f"list_transform(string_split({x}, ' '), lambda w: CASE WHEN {plain} THEN w ELSE array_to_string({word}, ' ') END)"
    x = f"array_to_string({parts}, ' ')"
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    for _ in range(2):  # neighbouring hits share a space
        x = _sub(x, rf"(^| )({short}) \.( |$)", r"\1\2.\3")
        x = _sub(x, rf"(^| )({'|'.join(NEGATED)})(n't)( |$)", r"\1\2 \3\4")
        for one, two in JOINED:
            x = _sub(x, rf"(^| )({one})({two})( |$)", r"\1\2 \3\4")
    x = _sub(x, rf"([a-z])('(?:{'|'.join(SHORTENED)}))( |$)", r"\1 \2\3")
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


GAZ = f"""phrases AS (SELECT lower(p_name) AS skill FROM part UNION SELECT lower(string_split(p_name, ' ')[1]) FROM part
  UNION SELECT lower(p_name || '-' || p_type) FROM part),
gaz AS (SELECT skill, {_tokens('skill')} AS pt FROM phrases)"""
WHOLE = "whole AS MATERIALIZED (SELECT skill, array_to_string(pt, ' ') AS g, pt[1] AS first FROM gaz)"


def _hits(texts: str) -> str:
    """The phrases in the cleaned ``text`` of a relation, counted per document."""
    return f"""toks AS MATERIALIZED (SELECT doc_id, {_tokens('text')} AS t FROM {texts}),
tok AS (SELECT doc_id, unnest(t) AS t1, unnest(t[2:]) AS t2, unnest(t[3:]) AS t3, unnest(t[4:]) AS t4 FROM toks),
grams AS (SELECT doc_id, unnest([t1, t1 || ' ' || t2, t1 || ' ' || t2 || ' ' || t3, t1 || ' ' || t2 || ' ' || t3 || ' ' || t4]) AS g
  FROM tok WHERE t1 IN (SELECT first FROM whole)),
hits AS (SELECT doc_id, skill, count(*) AS hits FROM grams JOIN whole USING (g) GROUP BY 1, 2),
lists AS MATERIALIZED (SELECT doc_id, list(skill ORDER BY skill) AS s FROM hits GROUP BY 1)"""


SKILL_CTES = (
    SKILLTEXTS, GAZ, WHOLE,
    f"ctext AS (SELECT doc_id, {t6('text')} AS text FROM skilltexts)", _hits("ctext"),
    "pool AS (SELECT doc_id, wanted, coalesce(s, []) AS skills FROM skilltexts LEFT JOIN lists USING (doc_id))",
)
ORACLES["skill_match"] = _with(*SKILL_CTES) + "SELECT doc_id, skill, hits FROM hits"
ORACLES["skill_pool"] = _with(*SKILL_CTES) + "SELECT doc_id, array_to_string(skills, '|') AS skills FROM pool"
ORACLES["skill_overlap"] = _with(*SKILL_CTES) + """SELECT doc_id,
  array_to_string(list_sort(list_intersect(wanted, skills)), '|') AS shared,
  round(len(list_intersect(wanted, skills)) / len(wanted), 6) AS ratio FROM pool"""
ORACLES["missing_skills"] = _with(*SKILL_CTES) + """SELECT doc_id,
  array_to_string(list_sort(list_filter(wanted, lambda w: NOT list_contains(skills, w))), '|') AS missing FROM pool"""

# ---- spans --------------------------------------------------------------------------------

SPANS = f"""items AS (SELECT doc_id, 'cv (' || doc_id || ').json' AS file, length(text) AS raw_size, {NFC} AS text FROM documents),
raw AS (SELECT doc_id, file, text, length(text) AS size, unnest([0, 1, 2, 3, 4]) AS pos, raw_size FROM items),
spans AS (SELECT doc_id, file, text, size, CAST(pos AS INT) AS pos,
  CASE pos WHEN 0 THEN doc_id % 5 WHEN 1 THEN raw_size - 4 WHEN 2 THEN doc_id % 7 + 5
    WHEN 3 THEN raw_size + 3 + doc_id % 90 ELSE CASE WHEN doc_id % 3 <> 0 THEN -doc_id % 4 - 1 END END AS s,
  CASE pos WHEN 0 THEN doc_id % 5 + 6 WHEN 1 THEN raw_size + doc_id % 9 WHEN 2 THEN doc_id % 7 + 3
    WHEN 3 THEN raw_size + 1 + doc_id % 90 ELSE CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 4 END END AS e,
  'SKILL: ' || CASE pos WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' WHEN 3 THEN 'delta'
    ELSE CASE WHEN doc_id % 3 = 0 THEN 'bad' ELSE 'edge' END END AS label FROM raw),
tried AS (SELECT *, s < 0 OR e > size OR s >= e AS outside,
  list_filter(list_transform([0, 1, 2, 3, 5, 10, 20, 50], lambda w: [greatest(greatest(s, 0) - w, 0), least(least(e, size) + w, size)]),
    lambda r: r[1] < r[2] AND regexp_matches(substring(text, r[1] + 1, r[2] - r[1]), '\\S'))[1] AS fit FROM spans),
repaired AS (SELECT doc_id, file, text, pos, CASE WHEN s IS NOT NULL THEN CAST(fit[1] AS INT) END AS "start",
  CASE WHEN s IS NOT NULL THEN CAST(fit[2] AS INT) END AS "end", label,
  s IS NOT NULL AND fit IS NOT NULL AND NOT (NOT outside AND fit[1] = s AND fit[2] = e) AS fixed,
  CASE WHEN s IS NULL THEN 'bad-format' WHEN fit IS NULL THEN CASE WHEN outside THEN 'out-of-bounds' ELSE 'empty-or-whitespace' END END AS reason
  FROM tried)"""
ORACLES["label_inventory"] = _with(SPANS) + (
    "SELECT label, count(*) AS spans, count(DISTINCT file) AS files FROM spans WHERE s IS NOT NULL GROUP BY 1"
)
ORACLES["span_explode"] = _with(SPANS) + """SELECT file, pos, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end", label,
  CASE WHEN s IS NULL THEN 'bad-format' END AS reason FROM spans"""
ORACLES["span_repair"] = _with(SPANS) + 'SELECT doc_id, pos, "start", "end", label, fixed, reason FROM repaired'
ORACLES["span_examples"] = _with(SPANS) + """SELECT file, any_value(text) AS text,
  coalesce(string_agg("start" || ':' || "end" || ':' || label, '|' ORDER BY pos) FILTER (reason IS NULL), '') AS spans
FROM repaired GROUP BY file"""
ORACLES["span_stats"] = _with(SPANS) + """SELECT count(DISTINCT file) AS total_examples, count(*) AS total_spans_found,
  count(*) FILTER (fixed) AS fixed_spans, count(*) FILTER (reason IS NOT NULL) AS skipped_spans FROM repaired"""
ORACLES["rejected_sample"] = _with(SPANS) + (
    "SELECT file, pos, label, reason FROM repaired WHERE reason IS NOT NULL ORDER BY file, pos LIMIT 50"
)

# ---- vectors --------------------------------------------------------------------------------

ORACLES["l2_normalise"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * CAST(vec_id % 5 AS FLOAT) AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT vec_id, CAST(i - 1 AS INT) AS i, round(v[i] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x
FROM n, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i)"""
_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
ORACLES["cosine_pair"] = _with(VECS, ORDER_PAIRS) + f"SELECT o_orderkey, round({_COS}, 6) AS similarity FROM opairs"
SCORES = """vscores AS (SELECT app_id, job_id, avg(m) AS score FROM
  (SELECT app_id, job_id, jd_chunk, max(c) AS m FROM vpairs GROUP BY ALL) GROUP BY ALL)"""
ORACLES["chunk_maxsim"] = _with(VECS, VAPPS, PAIRS, SCORES) + "SELECT app_id, job_id, round(score, 6) AS score FROM vscores"
ORACLES["best_chunk"] = _with(VECS, VAPPS, PAIRS) + """SELECT app_id, jd_chunk, resume_chunk, round(c, 6) AS similarity FROM vpairs
QUALIFY row_number() OVER (PARTITION BY app_id, jd_chunk ORDER BY c DESC, resume_chunk) = 1"""
ORACLES["chunk_cross"] = _with(VECS, VAPPS, PAIRS) + """SELECT app_id, count(*) AS pairs, round(min(c), 6) AS lowest,
  round(avg(c), 6) AS mean, round(max(c), 6) AS highest FROM vpairs GROUP BY 1"""
_DIST = "sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - 0.5 * p[2]) * (p[1] - 0.5 * p[2]))))"
ORACLES["vector_match"] = _with(VECS, ORDER_PAIRS) + (
    f"SELECT o_orderkey, round(d, 6) AS distance, d < 0.6 AS is_match FROM (SELECT o_orderkey, {_DIST} AS d FROM opairs)"
)
V_RANKED = _ranked("vscores", "job_id", "round(score, 9)", "app_id")
ORACLES["shortlist_by_match"] = _with(VECS, VAPPS, PAIRS, SCORES, V_RANKED) + (
    f"SELECT job_id, rank, app_id, round(score, 6) AS score, group_rows FROM ranked WHERE {TOP}"
)

# ---- joins ------------------------------------------------------------------------------------

ORACLES["app_wide"] = _with(APPS, JOBS, SEEKERS, USERS) + """SELECT app_id, job_id, job_title, seeker_id, resume, username, email, score
FROM apps JOIN jobs USING (job_id) JOIN seekers USING (seeker_id) JOIN users USING (user_id)"""
ORACLES["candidate_logs"] = _with(CUSTS, LOGS) + (
    "SELECT candidate_id, name, event_id, suspicious FROM custs LEFT JOIN logs USING (candidate_id)"
)
ORACLES["candidate_answers"] = _with(CUSTS, ANSWERS) + """SELECT o_orderkey AS answer_id, c.candidate_id, name, question_id, value, price
FROM custs c JOIN orders ON o_custkey = c.candidate_id JOIN answers a ON a.answer_id = o_orderkey"""
ORACLES["answer_question_weight"] = _with(ANSWERS, QUESTIONS, WEIGHTS_CTE, WEIGHTED) + (
    "SELECT candidate_id, question_id, line, category, question_type, weight FROM weighted"
)
ORACLES["apply_once"] = _with(APPS) + """SELECT app_id, job_id, seeker_id FROM apps a WHERE applied_at >= TIMESTAMP '1998-01-01'
  AND NOT EXISTS (SELECT 1 FROM apps b WHERE b.job_id = a.job_id AND b.seeker_id = a.seeker_id AND b.applied_at < TIMESTAMP '1998-01-01')
QUALIFY row_number() OVER (PARTITION BY job_id, seeker_id ORDER BY applied_at, app_id) = 1"""
ORACLES["snapshot_asof"] = f"""WITH apps AS (SELECT o_orderkey AS app_id, o_custkey % (SELECT max(user_id) FROM events) AS user_id,
  TIMESTAMP '2024-01-01' + to_days(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INT)) AS applied_at FROM orders)
SELECT app_id, a.user_id, {_ts('applied_at')} AS applied_at, event_id AS version
FROM apps a ASOF LEFT JOIN events v ON a.user_id = v.user_id AND a.applied_at >= v.ts"""
ORACLES["cascade_delete"] = """SELECT user_id AS candidate_id, event_id AS row_id, 'log' AS child FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT o_custkey, o_orderkey, 'answer' FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
ORACLES["cascade_users"] = _with(USERS, JOBS, SEEKERS, APPS, CANDS, LOGS, """gone_users AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1),
gone_jobs AS (SELECT job_id AS k FROM jobs WHERE provider_id IN (FROM gone_users)),
gone_seekers AS (SELECT seeker_id AS k FROM seekers WHERE user_id IN (FROM gone_users)),
gone_cands AS (SELECT candidate_id AS k FROM cands WHERE job_id IN (FROM gone_jobs) OR user_id IN (FROM gone_seekers))""") + """
SELECT 'users' AS name, CAST(user_id AS BIGINT) AS row_id FROM users WHERE user_id NOT IN (FROM gone_users)
UNION ALL SELECT 'jobs', job_id FROM jobs WHERE provider_id NOT IN (FROM gone_users)
UNION ALL SELECT 'seekers', seeker_id FROM seekers WHERE user_id NOT IN (FROM gone_users)
UNION ALL SELECT 'applications', app_id FROM apps WHERE job_id NOT IN (FROM gone_jobs) AND seeker_id NOT IN (FROM gone_seekers)
UNION ALL SELECT 'candidates', candidate_id FROM cands WHERE candidate_id NOT IN (FROM gone_cands)
UNION ALL SELECT 'logs', event_id FROM logs WHERE candidate_id NOT IN (FROM gone_cands)
UNION ALL SELECT 'bridge', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey NOT IN (FROM gone_cands)"""
ORACLES["not_taken"] = _with(CANDS) + (
    "SELECT user_id, job_id FROM cands GROUP BY ALL HAVING NOT bool_or(test_taken)"
)

# ---- aggregates ----------------------------------------------------------------------------------

COUNTS = "counts AS (SELECT c_custkey AS job_id, count(o_orderkey) AS application_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"
ORACLES["application_count"] = _with(COUNTS) + "SELECT job_id, application_count FROM counts"
FLAG_COUNTS = ", ".join(
    f"count(*) FILTER (flag = '{flag}' AND form NOT IN (2, 3, 6, 7)) AS {name}" for flag, name in FLAGS
)
ORACLES["flag_counts"] = _with(CUSTS, LOGS) + f"SELECT candidate_id, {FLAG_COUNTS} FROM custs LEFT JOIN logs USING (candidate_id) GROUP BY 1"
ORACLES["activity_stream_counts"] = _with(LOGS) + f"SELECT candidate_id, {FLAG_COUNTS} FROM logs GROUP BY 1"


def _points(similarity: str) -> str:
    return f"round(CASE WHEN {similarity} < 0.1 THEN 0 ELSE {similarity} END * 10, 2) / 50"


_CHOICE = "CASE WHEN correct_answer <> '' AND value <> '' AND upper(trim(value)) = upper(trim(correct_answer)) THEN 1 ELSE 0 END / 8 * weight"
SCORED = f"""scored AS (SELECT w.*, CASE question_type WHEN 'subjective' THEN {_points('similarity')} * weight
  WHEN 'code' THEN CASE WHEN coalesce(passed, true) THEN 10 ELSE 0 END / 40 * weight ELSE {_CHOICE} END AS score
  FROM (SELECT w.*, list_dot_product(r.v, g.v) / (sqrt(list_dot_product(r.v, r.v)) * sqrt(list_dot_product(g.v, g.v))) AS similarity
    FROM weighted w JOIN vecs r ON r.vec_id = question_id % (SELECT count(*) FROM embeddings)
    JOIN vecs g ON g.vec_id = (question_id + line * 3) % (SELECT count(*) FROM embeddings) WHERE weight IS NOT NULL) w
  LEFT JOIN results USING (answer_id))"""
SCORE_CTES = (ANSWERS, QUESTIONS, WEIGHTS_CTE, WEIGHTED, RUNS, RESULTS, VECS, SCORED)
ORACLES["answer_scores"] = _with(*SCORE_CTES) + """SELECT candidate_id, question_id, line,
  CASE WHEN question_type IN ('mcq', 'objective') THEN value END AS selected_option,
  CASE WHEN question_type NOT IN ('mcq', 'objective') THEN value END AS written_answer, round(score, 6) AS score FROM scored"""
ORACLES["candidate_total"] = _with(*SCORE_CTES) + (
    "SELECT candidate_id, round(sum(score) * 100, 4) AS total_score FROM scored GROUP BY 1"
)
ORACLES["jobs_with_due"] = _with(CANDS) + (
    f"SELECT DISTINCT job_id FROM cands WHERE final_deadline_date <= {NOW} AND NOT final_email_sent"
)
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TFIDF = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM clean) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM clean)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT doc_id, term, tf * idf AS r FROM tf JOIN idf USING (term)),
tfidf AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
STUFFED = """stuffed AS (SELECT doc_id, coalesce(n, 0) AS heavy_terms, coalesce(n, 0) > 1 AS is_suspicious FROM clean
  LEFT JOIN (SELECT doc_id, count(*) FILTER (weight > 0.1) AS n FROM tfidf GROUP BY 1) USING (doc_id))"""
ORACLES["tfidf"] = _with(CLEAN, TFIDF) + "SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf"
ORACLES["stuffing_flag"] = _with(CLEAN, TFIDF, STUFFED) + "SELECT doc_id, heavy_terms, is_suspicious FROM stuffed"

TURNS = f"turns AS MATERIALIZED (SELECT conv_id || '/' || turn AS doc_id, {t6('text')} AS text FROM conversations)"
ORACLES["term_model"] = _with(CLEAN, TFIDF) + (
    "SELECT term, count(*) AS df, (SELECT count(*) FROM clean) AS n FROM tf GROUP BY 1"
)
ORACLES["stuffing_unseen"] = _with(CLEAN, TFIDF, TURNS) + f"""SELECT doc_id, coalesce(heavy, 0) AS heavy_terms, coalesce(heavy, 0) > 1 AS is_suspicious
FROM turns LEFT JOIN (SELECT doc_id, count(*) FILTER (r / l > 0.1) AS heavy FROM
  (SELECT doc_id, r, sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS l FROM
    (SELECT doc_id, n * idf AS r FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM turns) GROUP BY 1, 2)
      JOIN idf USING (term))) GROUP BY 1) USING (doc_id)"""

# ---- rankings ----------------------------------------------------------------------------------------

ORACLES["top_jobs_by_count"] = _with(COUNTS) + "SELECT * FROM counts ORDER BY application_count DESC, job_id LIMIT 3"
ORACLES["top_jobs_by_date"] = _with(JOBS) + (
    f"SELECT job_id, {_ts('posted_at')} AS posted_at FROM jobs ORDER BY jobs.posted_at DESC, job_id LIMIT 3"
)
PERPLEXITY = f"""toks2 AS (SELECT doc_id, {_TERMS} AS t FROM clean),
bi AS (SELECT doc_id, t[i] AS w1, t[i + 1] AS w2 FROM toks2, LATERAL (SELECT unnest(range(1, len(t))) AS i)),
c12 AS (SELECT w1, w2, count(*) AS c12 FROM bi GROUP BY 1, 2),
c1 AS (SELECT w1, sum(c12) AS c1 FROM c12 GROUP BY 1),
vocab AS (SELECT count(*) AS v FROM (SELECT w1 FROM c12 UNION SELECT w2 FROM c12)),
ppl AS (SELECT doc_id, exp(-avg(ln((c12 + 0.1::DOUBLE) / (c1 + (SELECT v FROM vocab) * 0.1::DOUBLE)))) AS p
  FROM bi JOIN c12 USING (w1, w2) JOIN c1 USING (w1) GROUP BY 1)"""
ORACLES["perplexity"] = _with(CLEAN, PERPLEXITY) + (
    "SELECT doc_id, round(p, 4) AS perplexity FROM clean LEFT JOIN ppl USING (doc_id)"
)
ORACLES["perplexity_unseen"] = _with(CLEAN, PERPLEXITY, TURNS) + f"""SELECT doc_id, round(p, 4) AS perplexity, coalesce(p < 1000, false) AS is_suspicious_ai
FROM turns LEFT JOIN (SELECT doc_id, exp(-avg(ln((coalesce(c12, 0) + 0.1::DOUBLE) / (coalesce(c1, 0) + (SELECT v FROM vocab) * 0.1::DOUBLE)))) AS p FROM
  (SELECT doc_id, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT doc_id, {_TERMS} AS t FROM turns), LATERAL (SELECT unnest(range(1, len(t))) AS i))
  LEFT JOIN c12 USING (w1, w2) LEFT JOIN c1 USING (w1) GROUP BY 1) USING (doc_id)"""
GENERATED = "gen AS (SELECT doc_id, coalesce(p < 1000, false) AS is_suspicious_ai FROM clean LEFT JOIN ppl USING (doc_id))"
ORACLES["generated_text_flag"] = _with(CLEAN, PERPLEXITY, GENERATED) + "SELECT doc_id, is_suspicious_ai FROM gen"
ORACLES["job_ranking"] = _with(APPS, APP_RANKED, CLEAN, TFIDF, STUFFED, PERPLEXITY, GENERATED, *SKILL_CTES) + """SELECT job_id, rank, app_id, score,
  coalesce(is_suspicious, false) AS is_suspicious, coalesce(is_suspicious_ai, false) AS is_suspicious_ai,
  coalesce(array_to_string(skills, '|'), '') AS skills
FROM (SELECT *, app_id % (SELECT count(*) FROM documents) AS doc_id FROM ranked)
LEFT JOIN stuffed USING (doc_id) LEFT JOIN gen USING (doc_id) LEFT JOIN pool USING (doc_id)"""
ORACLES["shortlist_top_fraction"] = _with(APPS, APP_RANKED) + (
    f"SELECT job_id, rank, app_id, score, group_rows FROM ranked WHERE {TOP}"
)
ORACLES["empty_guard"] = _with(APPS, APP_RANKED) + f"""SELECT c_custkey AS job_id, count(app_id) AS selected FROM customer
LEFT JOIN (SELECT job_id, app_id FROM ranked WHERE {TOP}) ON job_id = c_custkey GROUP BY 1"""
CAND_RANKED = _ranked("cands", "job_id", "total_score", "candidate_id", "NOT final_email_sent")
ORACLES["final_selection"] = _with(CANDS, CAND_RANKED) + (
    f"SELECT job_id, rank, candidate_id, total_score, group_rows FROM ranked WHERE {TOP}"
)
ORACLES["final_rows"] = _with(CANDS, JOBS, SEEKERS, USERS, CAND_RANKED) + f"""SELECT candidate_id, job_id, email AS recipient,
  'Final Selection – ' || job_title AS subject,
  'Dear ' || username || ',' || chr(10) || chr(10) || 'You have been selected in the final list for the position: ' || job_title
  || '.' || chr(10) || chr(10) || 'Congratulations.' || chr(10) AS message
FROM (SELECT candidate_id, job_id, user_id AS seeker_id FROM ranked WHERE {TOP}) JOIN jobs USING (job_id)
JOIN seekers USING (seeker_id) JOIN users USING (user_id)"""
_QUOTA = "CASE question_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in QUOTAS.items()) + " END"
ORACLES["stratified_test"] = _with(QUESTIONS) + f"""SELECT category, difficulty, question_type, draw, question_id FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY category, difficulty, question_type
  ORDER BY md5('round-1:' || question_id), question_id) AS INT) AS draw FROM questions) WHERE draw <= {_QUOTA}"""
ORACLES["question_union"] = ORACLES["stratified_test"]
# Drawn one after the other; what is there already gives way to the highest number, behind it.
ORACLES["test_per_candidate"] = f"""WITH RECURSIVE {JOBS}, {CANDS}, {QUESTIONS},
ranked AS (SELECT question_id, category, difficulty, question_type, count(*) OVER g AS size,
  row_number() OVER (g ORDER BY md5('round-1:' || question_id), question_id) - 1 AS rank
  FROM questions WINDOW g AS (PARTITION BY category, difficulty, question_type)),
sizes AS (SELECT category, difficulty, question_type, size, least(size, {_QUOTA}) AS wanted FROM ranked GROUP BY ALL),
starts AS (SELECT candidate_id, ({_CATS[:-1]}, 'no questions'])[CAST(job_id % 9 AS INT) + 1] AS category,
  CASE WHEN experience <= 2 THEN 'basic' WHEN experience <= 5 THEN 'intermediate' ELSE 'hard' END AS difficulty
  FROM cands JOIN jobs USING (job_id) WHERE NOT test_taken),
steps AS (SELECT candidate_id, category, difficulty, question_type, size, wanted, 0 AS j, CAST([] AS BIGINT[]) AS chosen
  FROM starts JOIN sizes USING (category, difficulty)
  UNION ALL SELECT candidate_id, category, difficulty, question_type, size, wanted, j + 1,
    CASE WHEN place > 0 THEN list_concat(list_append(chosen[:place], highest), chosen[place + 1:]) ELSE list_prepend(number, chosen) END
  FROM (SELECT *, coalesce(list_position(chosen, number), 0) AS place FROM
    (SELECT *, size - wanted + j AS highest,
      CAST('0x' || substr(md5('round-1:' || candidate_id || ':' || question_type || ':' || j), 1, 15) AS BIGINT) % (size - wanted + j + 1) AS number
     FROM steps WHERE j < wanted))),
drawn AS (SELECT candidate_id, category, difficulty, question_type, unnest(chosen) AS rank, generate_subscripts(chosen, 1) AS draw
  FROM steps WHERE j = wanted)
SELECT candidate_id, question_type, CAST(draw AS INT) AS draw, question_id FROM drawn JOIN ranked USING (category, difficulty, question_type, rank)"""
ORACLES["first_match"] = _with(CANDS) + (
    "SELECT user_id, job_id, min(candidate_id) AS candidate_id FROM cands WHERE test_taken GROUP BY 1, 2"
)
ORACLES["distinct_rows"] = _with(QUESTIONS) + "SELECT DISTINCT category, difficulty, question_type FROM questions"

# ---- scoring -------------------------------------------------------------------------------------------

ORACLES["score_choice"] = _with(ANSWERS, QUESTIONS, WEIGHTS_CTE, WEIGHTED) + f"""SELECT candidate_id, question_id, line,
  round({_CHOICE}, 6) AS score FROM weighted WHERE weight IS NOT NULL AND question_type IN ('mcq', 'objective')"""
ORACLES["score_subjective"] = _with(VECS, ORDER_PAIRS) + (
    f"SELECT o_orderkey, round({_points('similarity')}, 6) AS score FROM (SELECT o_orderkey, {_COS} AS similarity FROM opairs)"
)
ORACLES["score_code"] = _with(RUNS, RESULTS) + """SELECT o_orderkey AS answer_id,
  round(CASE WHEN coalesce(passed, true) THEN 10 ELSE 0 END / 40 * 0.4::DOUBLE, 6) AS score,
  round(CASE WHEN coalesce(strict_passed, true) THEN 10 ELSE 0 END / 40 * 0.4::DOUBLE, 6) AS strict_score
FROM orders LEFT JOIN results ON answer_id = o_orderkey"""
ORACLES["weights_dim"] = _with(QUESTIONS, WEIGHTS_CTE) + """SELECT w.category, w.question_type, w.weight, s AS category_sum, count(question_id) AS questions
FROM weights w JOIN (SELECT category, round(sum(weight), 6) AS s FROM weights GROUP BY 1) USING (category)
LEFT JOIN questions q ON q.category = w.category AND q.question_type = w.question_type GROUP BY ALL"""
ORACLES["composite_rank"] = _with(APPS, JOBS) + """SELECT job_id, rank, app_id, round(f, 10) AS final_score FROM (
SELECT job_id, app_id, f, row_number() OVER (PARTITION BY job_id ORDER BY f DESC, app_id) AS rank FROM (
SELECT job_id, app_id, 0.30::DOUBLE * (score / 500000) + 0.20::DOUBLE * coalesce(o, 0) + 0.20::DOUBLE * coalesce(s, 0)
  + CASE WHEN job_title = 'MACHINERY Engineer' THEN 0 ELSE 0.15::DOUBLE END * coalesce(a, 0)
  + CASE WHEN job_title = 'MACHINERY Engineer' THEN 0.30::DOUBLE ELSE 0.15::DOUBLE END * coalesce(p, 0) AS f
FROM apps JOIN jobs USING (job_id) LEFT JOIN (SELECT l_orderkey, max(l_quantity) / 50 AS o, max(l_discount) * 10 AS s,
  max(l_tax) * 10 AS a, avg(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS p FROM lineitem GROUP BY 1) ON l_orderkey = app_id))"""

# ---- models and text statistics ----------------------------------------------------------------------------

ORACLES["category_classify"] = f"""SELECT vec_id, label % 7 AS label, CAST(label % 7 AS INT) AS predicted,
  ({_NAMES})[CAST(label % 7 AS INT) + 1] AS category, true AS reload_agrees FROM embeddings"""
ORACLES["label_decode"] = f"SELECT vec_id, ({_NAMES})[CAST(label % 7 AS INT) + 1] AS category FROM embeddings"
ORACLES["repetition_ratio"] = f"""SELECT doc_id, CASE WHEN len(g) > 0 THEN round((len(g) - len(list_distinct(g))) / len(g), 6) END AS ratio
FROM (SELECT doc_id, list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS g
  FROM (SELECT doc_id, {_TERMS} AS t FROM documents))"""
ORACLES["buzzword_density"] = f"""SELECT doc_id, CASE WHEN len(t) > 0 THEN round(len(list_filter(t, lambda w: w IN
  ('the', 'that', 'and', 'with', 'la', 'der', 'que'))) / len(t), 6) END AS density
FROM (SELECT doc_id, {_TERMS} AS t FROM documents)"""

# ---- ticks and streams ----------------------------------------------------------------------------------------

ORACLES["close_due_jobs"] = _with(JOBS, APPS, APP_RANKED) + f"""SELECT {JOB_COLUMNS}, email_sent OR ({DUE}) AS email_sent,
  active AND NOT ({DUE}) AS active, selected, lowest_app FROM jobs
LEFT JOIN (SELECT job_id, count(*) AS selected, min(app_id) AS lowest_app FROM ranked
  WHERE {TOP} AND job_id IN (SELECT job_id FROM jobs WHERE {DUE}) GROUP BY 1) USING (job_id)"""
ORACLES["final_select_tick"] = _with(CANDS, CAND_RANKED) + f"""SELECT c.candidate_id, c.job_id,
  c.final_email_sent OR due.job_id IS NOT NULL AS final_email_sent, r.rank AS selected_rank FROM cands c
LEFT JOIN (SELECT DISTINCT job_id FROM cands WHERE final_deadline_date <= {NOW} AND NOT final_email_sent) due ON due.job_id = c.job_id
LEFT JOIN (SELECT * FROM ranked WHERE {TOP}) r ON r.candidate_id = c.candidate_id AND due.job_id IS NOT NULL"""
ORACLES["rescore_on_apply"] = _with(VECS, VAPPS, PAIRS, SCORES) + "SELECT app_id, round(score, 6) AS score FROM vscores"
ORACLES["resume_update"] = _with(
    SKILLTEXTS, GAZ, WHOLE,
    "newest AS (SELECT source || '/' || lang AS owner, max(doc_id) AS doc_id FROM documents GROUP BY 1)",
    f"ctext AS MATERIALIZED (SELECT owner, doc_id, {t6('text')} AS text FROM skilltexts JOIN newest USING (owner, doc_id))",
    _hits("ctext"),
) + f"""SELECT owner, doc_id, text, chunks,
  '[' || array_to_string(list_transform(range(chunks), lambda i: '384'), ', ') || ']' AS dimensions,
  true AS has_category, array_to_string(coalesce(s, []), '|') AS skills
FROM (SELECT *, CAST(ceil(len({_words('text')}) / 150) AS INT) AS chunks FROM ctext) LEFT JOIN lists USING (doc_id)"""
ORACLES["resume_update_stream"] = ORACLES["resume_update"]
ORACLES["close_once"] = _with(JOBS, APPS, APP_RANKED) + f"""SELECT job_id, app_id, rank, {_first_day(CLOSING_DAYS, 'deadline')} AS closed_at
FROM ranked JOIN jobs USING (job_id) WHERE {TOP} AND active AND NOT email_sent AND deadline <= TIMESTAMP '{CLOSING_DAYS[-1]}'"""
ORACLES["final_select_once"] = _with(CANDS, CAND_RANKED) + f"""SELECT job_id, candidate_id, rank, {_first_day(SELECTING_DAYS, 'earliest')} AS selected_at
FROM ranked JOIN (SELECT job_id, min(final_deadline_date) AS earliest FROM cands WHERE NOT final_email_sent GROUP BY 1) USING (job_id)
WHERE {TOP} AND earliest <= TIMESTAMP '{SELECTING_DAYS[-1]}'"""
