"""Equivalent DuckDB SQL for each registered query (the correctness gate).

Plain window functions, joins and ``string_agg`` over the same driver tables.
Shared with the Spark side, and so not checked here but by the literal cases in
tests: the fixed patterns (translated to RE2 by ``dialect.to_re2``), the token
grammar, the header, and the table of settings keys.
"""

from __future__ import annotations

import os

from ..functions import endpoint as ep
from ..functions import redact as rd
from ..functions import template as tp
from ..functions.dialect import WHITESPACE_CHARS, sql_string, to_re2
from ..operators import settings as stg
from ..operators import transcript as tr
from ..sources import fixtures as fx
from ..sources.templates import BUILTIN_DIR

NL = "chr(10)"
WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE_CHARS) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def _tsec(e: str) -> str:
    return f"CAST(trunc({e}) AS BIGINT)"


def _divmod(t: str) -> tuple[str, str]:
    r = f"((({t}) % 60 + 60) % 60)"
    return f"((({t}) - {r}) // 60)", r


def clock(e: str) -> str:
    m, s = _divmod(_tsec(e))
    return f"printf('%02d:%02d', {m}, {s})"


def duration(e: str) -> str:
    m, s = _divmod(_tsec(e))
    return f"printf('%d:%02d', {m}, {s})"


def time_range(a: str = "start_s", b: str = "end_s") -> str:
    return f"'[' || {clock(a)} || ' {tr.ARROW} ' || {clock(b)} || ']'"


def parse_clock(e: str) -> str:
    p0 = f"TRY_CAST(split_part({e}, ':', 1) AS BIGINT)"
    p1 = f"TRY_CAST(split_part({e}, ':', 2) AS BIGINT)"
    return f"CASE WHEN len(string_split({e}, ':')) = 2 THEN CAST({p0} * 60 + {p1} AS DOUBLE) END"


def _re2_quote(s: str) -> str:
    return "".join("\\" + c if c in "\\.^$|?*+()[]{}" else c for c in s)


def redact_patterns(e: str) -> str:
    out = e
    for pat, tok in rd.re2_rules():
        out = f"regexp_replace({out}, {sql_string(pat)}, {sql_string(tok)}, 'g')"
    return out


def redact_names(e: str, names) -> str:
    out = e
    for n in names:
        n = n.strip()
        if n:
            pat = "(?i)" + r"\b" + _re2_quote(n) + r"\b"
            out = f"regexp_replace({out}, {sql_string(pat)}, {sql_string(rd.NAME_TOKEN)}, 'g')"
    return out


def redact_text(e: str, names) -> str:
    return redact_names(redact_patterns(e), names)


# -- derived fixtures (FIXTURES.md §4) ---------------------------------------

def _lit(s: str) -> str:
    return sql_string(s)


FIXTURE_CTES = f"""
conv_t AS (
  SELECT conv_id, turn, role,
         CASE WHEN conv_id % 11 = 0 THEN t2 || {_lit(fx.DOLLAR_SUFFIX)} ELSE t2 END AS text
  FROM (SELECT conv_id, turn, role,
               CASE WHEN turn % 5 = 2 THEN {_lit(fx.NAME_PREFIX)} || t1 || {_lit(fx.NAME_SUFFIX)}
                    ELSE t1 END AS t2
        FROM (SELECT conv_id, turn, role,
                     CASE WHEN conv_id % 7 = 0 THEN text || {_lit(fx.PII_SUFFIX)} ELSE text END AS t1
              FROM conversations) c1) c2
),
seg AS (
  SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS seg_idx, role AS speaker, text,
         st AS start_s, st + dur AS end_s
  FROM (SELECT *, CAST(turn * 0.5 + COALESCE(SUM(dur) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS st
        FROM (SELECT *, CAST((LENGTH(text) - LENGTH(REPLACE(text, ' ', '')) + 1) * 0.25 AS DOUBLE) AS dur
              FROM conv_t) a) b
),
turns AS (
  SELECT session_id, seg_idx AS turn_idx, speaker,
         start_s + CASE WHEN seg_idx % 3 = 1 THEN 0.625 ELSE 0 END AS start_s,
         end_s + CASE WHEN seg_idx % 4 = 2 THEN 0.875 ELSE 0 END AS end_s
  FROM seg WHERE session_id % 10 <> 9
),
words AS (
  SELECT session_id,
         CAST(row_number() OVER (PARTITION BY session_id ORDER BY seg_idx, p) - 1 AS BIGINT) AS word_idx,
         ' ' || w AS text, CAST(start_s + p * 0.25 AS DOUBLE) AS start_s,
         CAST(start_s + p * 0.25 + 0.25 AS DOUBLE) AS end_s
  FROM (SELECT session_id, seg_idx, start_s,
               UNNEST(string_split(text, ' ')) AS w,
               UNNEST(range(0, len(string_split(text, ' ')))) AS p
        FROM seg) x
)"""

ALIGN_CTES = """
cand AS (
  SELECT w.session_id, w.word_idx, t.speaker, t.turn_idx,
         greatest(least(w.end_s, t.end_s) - greatest(w.start_s, t.start_s), 0) AS ov
  FROM words w JOIN turns t ON w.session_id = t.session_id
   AND (least(w.end_s, t.end_s) > greatest(w.start_s, t.start_s)
        OR (t.start_s <= (w.start_s + w.end_s) / 2 AND (w.start_s + w.end_s) / 2 <= t.end_s))
),
best AS (
  SELECT session_id, word_idx, speaker FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id, word_idx ORDER BY ov DESC, turn_idx) AS rn
    FROM cand) c WHERE rn = 1
),
has_turns AS (SELECT DISTINCT session_id FROM turns),
assigned AS (
  SELECT w.session_id, w.word_idx, w.text, w.start_s, w.end_s,
         CASE WHEN h.session_id IS NULL THEN 'Speaker' ELSE coalesce(b.speaker, 'Unknown') END AS speaker
  FROM words w
  LEFT JOIN best b ON w.session_id = b.session_id AND w.word_idx = b.word_idx
  LEFT JOIN has_turns h ON w.session_id = h.session_id
),
chg AS (
  SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY session_id ORDER BY word_idx)
                      IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS c
  FROM assigned
),
runs AS (
  SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY word_idx
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM chg
),
aligned AS (
  SELECT session_id, CAST(run - 1 AS BIGINT) AS seg_idx, any_value(speaker) AS speaker,
         """ + strip("string_agg(text, '' ORDER BY word_idx)") + """ AS text,
         arg_min(start_s, word_idx) AS start_s, arg_max(end_s, word_idx) AS end_s
  FROM runs GROUP BY session_id, run
)"""


def label_cte(src: str, names: list[str], name: str = "labeled") -> str:
    arr = "[" + ", ".join(sql_string(n.strip()) for n in names) + "]::VARCHAR[]"
    return f"""
{name}_ranks AS (
  SELECT session_id, speaker,
         row_number() OVER (PARTITION BY session_id ORDER BY min(seg_idx)) - 1 AS rnk
  FROM {src} GROUP BY session_id, speaker
),
{name} AS (
  SELECT s.session_id, s.seg_idx, coalesce(({arr})[r.rnk + 1], s.speaker) AS speaker,
         s.text, s.start_s, s.end_s
  FROM {src} s JOIN {name}_ranks r ON s.session_id = r.session_id AND s.speaker = r.speaker
)"""


def line_sql(timestamps: bool) -> str:
    body = "speaker || ': ' || text"
    return f"{time_range()} || ' ' || {body}" if timestamps else body


def transcript_sql(src: str, timestamps: bool) -> str:
    return (f"SELECT session_id, string_agg({line_sql(timestamps)}, {NL} || {NL} ORDER BY seg_idx) "
            f"AS transcript FROM {src} GROUP BY session_id")


def with_(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip().rstrip(",") + "\n" + body


EDITABLE_CTE = f"""
ed0 AS (
  SELECT session_id,
         string_agg({time_range()} || ' ' || speaker || ':' || {NL} || text, {NL} || {NL}
                    ORDER BY seg_idx) || {NL} AS editable
  FROM seg GROUP BY session_id
)"""

EDITED_CTE = """
ed AS (
  SELECT session_id,
    CASE WHEN session_id % 6 = 5 THEN replace(e3, chr(10), chr(13) || chr(10)) ELSE e3 END AS editable
  FROM (SELECT session_id,
    CASE WHEN session_id % 5 = 2 THEN e2 || chr(10) || '[1:2:3 → 00:04] bad:' || chr(10) || 'trailing'
         || chr(10) || chr(10) || chr(10) || 'more' || chr(10) ELSE e2 END AS e3
  FROM (SELECT session_id,
    CASE WHEN session_id % 4 = 1 THEN replace(e1, '] user:' || chr(10), '] Client :' || chr(10)) ELSE e1 END AS e2
  FROM (SELECT session_id,
    CASE WHEN session_id % 3 = 0 THEN 'draft notes' || chr(10) || chr(10) || editable ELSE editable END AS e1
  FROM ed0) a) b) c
)"""

HDR = sql_string(to_re2(tr.HEADER))

IMPORT_BODY = f"""
, lines AS (
  SELECT session_id, UNNEST(string_split(editable, chr(10))) AS line,
         UNNEST(range(0, len(string_split(editable, chr(10))))) AS line_no
  FROM ed
),
hl AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, {HDR}) THEN 1 ELSE 0 END)
              OVER (PARTITION BY session_id ORDER BY line_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk,
         regexp_matches(line, {HDR}) AS is_h
  FROM lines
),
heads AS (
  SELECT session_id, blk, regexp_extract(line, {HDR}, 1) AS a, regexp_extract(line, {HDR}, 2) AS b,
         {strip(f"regexp_extract(line, {HDR}, 3)")} AS speaker
  FROM hl WHERE is_h AND blk > 0
),
bodies AS (
  SELECT session_id, blk, string_agg(line, chr(10) ORDER BY line_no) AS body
  FROM hl WHERE NOT is_h AND blk > 0 GROUP BY session_id, blk
)
SELECT h.session_id, CAST(h.blk - 1 AS BIGINT) AS seg_idx, h.speaker,
       {strip("coalesce(bd.body, '')")} AS text,
       {parse_clock("h.a")} AS start_s, {parse_clock("h.b")} AS end_s
FROM heads h LEFT JOIN bodies bd ON h.session_id = bd.session_id AND h.blk = bd.blk"""

SPEAKER_NAMES = ["Therapist", "Client"]
RUN_DATE = "2024-06-30"


def _templates_values() -> str:
    rows = []
    for f in sorted(os.listdir(BUILTIN_DIR)):
        if f.endswith(".txt"):
            with open(os.path.join(BUILTIN_DIR, f), encoding="utf-8") as fh:
                rows.append(f"({sql_string(f[:-4])}, {sql_string(fh.read())})")
    return "templates(template_id, body) AS (VALUES " + ", ".join(rows) + ")"


def _pick(valid: str, other: str) -> str:
    return f"CASE conv_id % 3 WHEN 1 THEN {valid} WHEN 2 THEN {other} END"


SETTINGS_CTE = f"""
settings AS (
  SELECT conv_id AS session_id,
    {_pick("'Client-' || CAST(conv_id AS VARCHAR)", "''")} AS client_name,
    {_pick("'2024-05-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0')", "''")} AS session_date,
    {_pick("'Therapist, Client'", "'Dr A,'")} AS speaker_names,
    {_pick("true", "false")} AS redact,
    {_pick("'John, Jane Smith'", "CAST(NULL AS VARCHAR)")} AS redact_names,
    {_pick(sql_string(fx.LOCAL_BASE), sql_string(fx.REMOTE_BASE))} AS base_url,
    {_pick("false", "conv_id % 2 = 0")} AS allow_remote,
    {_pick("'llama3.1:8b'", "CAST(NULL AS VARCHAR)")} AS model,
    ([{", ".join(sql_string(t) for t in fx.TEMPLATE_IDS)}])[conv_id % {len(fx.TEMPLATE_IDS)} + 1] AS template_id
  FROM (SELECT DISTINCT conv_id FROM conversations) s
)"""


CFG_VALID = ('{"transcribe": {"speakers": "Therapist,Client", "num_speakers": 2, "min_speakers": 1, "max_speakers": 4}, '
             '"summarize": {"client_name": "Cfg-')
CFG_VALID_TAIL = ('", "session_date": "2024-07-01", "base_url": "http://127.0.0.1:8000/v1", '
                  '"model": "cfg-model", "template": "dap", "allow_remote": true}, '
                  '"redact": {"enabled": true, "names": "John"}}')
CFG_WRONG = ('{"transcribe": {"num_speakers": "two", "max_speakers": 2.5, "speakers": ["A", "B"]}, '
             '"summarize": {"client_name": 5, "allow_remote": "yes", "session_date": 20240701}, '
             '"redact": {"enabled": 0, "names": ["x"]}}')
CFG_BOOLINT = ('{"transcribe": {"num_speakers": true}, '
               '"summarize": {"allow_remote": false, "model": null}}')

CONFIG_CTE = f"""
cfg AS (
  SELECT conv_id AS session_id,
    CASE conv_id % 4
      WHEN 1 THEN {sql_string(CFG_VALID)} || CAST(conv_id AS VARCHAR) || {sql_string(CFG_VALID_TAIL)}
      WHEN 2 THEN {sql_string(CFG_WRONG)}
      WHEN 3 THEN {sql_string(CFG_BOOLINT)}
      ELSE '{{}}' END AS config
  FROM (SELECT DISTINCT conv_id FROM conversations) s
)"""


def _kind(path: str) -> str:
    t = f"json_type(config, '$.{path}')"
    return (f"(CASE WHEN {t} IN ('BIGINT', 'UBIGINT') THEN 'int' WHEN {t} = 'VARCHAR' THEN 'str' "
            f"WHEN {t} = 'BOOLEAN' THEN 'bool' WHEN {t} = 'DOUBLE' THEN 'float' "
            f"WHEN {t} = 'ARRAY' THEN 'list' WHEN {t} = 'OBJECT' THEN 'dict' WHEN {t} = 'NULL' THEN 'null' END)")


def _truthy(path: str) -> str:
    k, p = _kind(path), f"'$.{path}'"
    return (f"coalesce(CASE {k} WHEN 'bool' THEN CAST(json_extract(config, {p}) AS BOOLEAN) "
            f"WHEN 'int' THEN CAST(json_extract(config, {p}) AS DOUBLE) <> 0 "
            f"WHEN 'float' THEN CAST(json_extract(config, {p}) AS DOUBLE) <> 0 "
            f"WHEN 'str' THEN json_extract_string(config, {p}) <> '' "
            f"WHEN 'list' THEN json_array_length(config, {p}) > 0 "
            f"WHEN 'dict' THEN CAST(json_extract(config, {p}) AS VARCHAR) <> '{{}}' "
            f"WHEN 'null' THEN false END, false)")


def settings_sql() -> str:
    cols, ign = ["e.session_id"], []
    for col, (path, kind) in {**stg.STRING_KEYS, **stg.INT_KEYS}.items():
        typ = "VARCHAR" if kind == "str" else "BIGINT"
        given = f"e.{col}" if kind == "str" else "CAST(NULL AS BIGINT)"
        val = (f"json_extract_string(config, '$.{path}')" if kind == "str"
               else f"CAST(json_extract(config, '$.{path}') AS BIGINT)")
        cols.append(f"coalesce(CAST({given} AS {typ}), CASE WHEN {_kind(path)} = '{kind}' THEN {val} END) AS {col}")
        ign.append(f"CASE WHEN {given} IS NULL AND {_kind(path)} IS NOT NULL AND {_kind(path)} <> '{kind}' "
                   f"THEN '{path}' END")
    for col, path in stg.BOOL_KEYS.items():
        cols.append(f"(coalesce(e.{col}, false) OR {_truthy(path)}) AS {col}")
    col, path = stg.NAMES_KEY
    use = f"(e.{col} IS NULL AND {_truthy(path)})"
    cols.append(f"coalesce(e.{col}, CASE WHEN {use} AND {_kind(path)} = 'str' "
                f"THEN json_extract_string(config, '$.{path}') END) AS {col}")
    ign.append(f"CASE WHEN {use} AND {_kind(path)} <> 'str' THEN '{path}' END")
    cols.append("array_to_string(list_sort(list_filter([" + ", ".join(ign)
                + "], lambda x: x IS NOT NULL)), ',') AS ignored")
    return ("SELECT " + ",\n  ".join(cols)
            + "\nFROM settings e LEFT JOIN cfg c ON e.session_id = c.session_id")


RESOLVED_CTE = SETTINGS_CTE + "," + CONFIG_CTE + ",\nresolved AS (" + settings_sql() + ")"


def redact_resolved(text: str, r: str) -> str:
    """``text`` redacted as the resolved settings ``r`` of its session say."""
    return (f"CASE WHEN NOT coalesce({r}.redact, false) THEN {text} "
            f"WHEN {r}.redact_names = 'John, Jane Smith' THEN {redact_text(text, ['John', 'Jane Smith'])} "
            f"WHEN {r}.redact_names = 'John' THEN {redact_text(text, ['John'])} ELSE {redact_patterns(text)} END")


def substitute_sql(body: str, values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN tok IN ('${k}', '${{{k}}}') THEN {v}" for k, v in values.items())
    return (f"array_to_string(list_transform(regexp_extract_all({body}, {sql_string(tp.TOKEN)}), "
            f"lambda tok: CASE WHEN tok = '$$' THEN '$' {cases} ELSE tok END), '')")


PROMPT_CTES = FIXTURE_CTES + "," + RESOLVED_CTE + ",\n" + _templates_values() + f""",
rseg AS (SELECT seg.session_id, seg_idx, speaker, {redact_resolved('seg.text', 'r')} AS text, start_s, end_s
         FROM seg LEFT JOIN resolved r ON seg.session_id = r.session_id),
vals AS (
  SELECT session_id, string_agg({line_sql(True)}, {NL} || {NL} ORDER BY seg_idx) AS transcript,
         array_to_string(list_sort(list(DISTINCT speaker)), ', ') AS speakers,
         {duration('max(end_s) - min(start_s)')} AS duration
  FROM rseg GROUP BY session_id
),
pv AS (
  SELECT st.session_id, st.template_id, t.body, v.transcript, v.speakers, v.duration,
         coalesce(nullif(st.session_date, ''), {sql_string(RUN_DATE)}) AS dt,
         coalesce(nullif(st.client_name, ''), {sql_string(tp.DEFAULT_CLIENT)}) AS cn
  FROM resolved st JOIN vals v ON st.session_id = v.session_id
  LEFT JOIN templates t ON st.template_id = t.template_id
),
prompts AS (
  SELECT session_id, template_id,
         {substitute_sql("body", dict(transcript="transcript", speakers="speakers", date="dt",
                                      duration="duration", client_name="cn"))} AS prompt,
         CASE WHEN body IS NULL THEN 'template not found' END AS error
  FROM pv
)"""

HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)"


def is_local_sql(e: str) -> str:
    host = f"replace(replace(lower(regexp_extract({e}, {sql_string(HOST_RE)}, 1)), '[', ''), ']', '')"
    return f"coalesce({host} IN ({', '.join(sql_string(h) for h in ep.LOCAL_HOSTS)}), false)"


def gate_sql(base: str, allow: str) -> str:
    return (f"CASE WHEN {is_local_sql(base)} THEN 'ok' WHEN coalesce({allow}, false) "
            f"THEN 'remote_allowed' ELSE 'refused' END")


def url_sql(base: str) -> str:
    return f"regexp_replace({base}, '/+$', '') || {sql_string(ep.COMPLETIONS_PATH)}"


def est_sql(e: str) -> str:
    return f"CAST(length({e}) // {ep.CHARS_PER_TOKEN} AS BIGINT)"


GATE_TARGETS = r"""
tg AS (
  SELECT page_id,
    CASE page_id % 5
      WHEN 0 THEN url
      WHEN 1 THEN 'http://localhost:11434' || regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1)
      WHEN 2 THEN 'http://[::1]:8080' || regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1)
      WHEN 3 THEN 'HTTP://127.0.0.1' || regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1)
      ELSE 'no url ' || url END AS base_url,
    page_id % 2 = 0 AS allow_remote
  FROM pages
)"""

RESPONSES_CTE = """
resp AS (
  SELECT conv_id AS session_id, turn,
    CASE (conv_id + turn) % 10 WHEN 3 THEN 500 WHEN 5 THEN 302 WHEN 6 THEN NULL ELSE 200 END AS status,
    CASE (conv_id + turn) % 10
      WHEN 7 THEN NULL
      WHEN 8 THEN json_object('choices', [json_object('message',
                    json_object('role', 'assistant', 'content', text))])::VARCHAR || ' junk'
      WHEN 9 THEN json_object('choices', [json_object('message',
                    json_object('content', json_object('a', text)))])::VARCHAR
      WHEN 1 THEN '{"choices":[]}'
      WHEN 2 THEN json_object('choices', [json_object('text', text)])::VARCHAR
      WHEN 3 THEN 'internal error'
      WHEN 4 THEN '<html>' || text
      ELSE json_object('choices', [json_object('message',
                    json_object('role', 'assistant', 'content', text))])::VARCHAR END AS body
  FROM conversations
),
parsed AS (
  SELECT session_id, turn, status, body,
         CASE WHEN status BETWEEN 200 AND 299 AND json_valid(body)
                   AND json_type(body, '$.choices[0].message.content') = 'VARCHAR'
              THEN json_extract_string(body, '$.choices[0].message.content') END AS content
  FROM resp
)"""

JSONL_LINES = FIXTURE_CTES + f""",
jl AS (
  SELECT session_id, seg_idx, speaker, text, start_s, end_s,
         json_object('speaker', speaker, 'text', text, 'start', start_s, 'end', end_s)::VARCHAR AS line
  FROM seg
),
fl AS (
  SELECT session_id, seg_idx,
    CASE (session_id * 31 + seg_idx) % 13
      WHEN 0 THEN json_object('speaker', speaker, 'text', text, 'start', start_s)::VARCHAR
      WHEN 1 THEN substring(line, 1, length(line) - 1) || ',"mood":"x"}}'
      WHEN 2 THEN substring(line, 1, length(line) // 2)
      WHEN 3 THEN ''
      WHEN 4 THEN '  ' || chr(9)
      WHEN 5 THEN line || ' junk'
      WHEN 6 THEN json_object('speaker', speaker, 'text', json_object('a', 1), 'start', start_s, 'end', end_s)::VARCHAR
      WHEN 7 THEN line || line
      ELSE line END AS line
  FROM jl
)
"""

JSONL_DOCS = f"""
docs AS (SELECT session_id, string_agg(line, {NL} ORDER BY seg_idx) AS jsonl FROM fl GROUP BY session_id),
ln AS (
  SELECT * FROM (
    SELECT session_id, UNNEST(string_split(jsonl, {NL})) AS line,
           UNNEST(range(0, len(string_split(jsonl, {NL})))) AS line_no
    FROM docs) x
  WHERE {strip('line')} <> ''
)"""

JSONL_CHECK = f"""
chk AS (
  SELECT session_id, line_no, line,
    CASE WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN 'bad_json'
         WHEN list_sort(json_keys(line)) <> ['end', 'speaker', 'start', 'text'] THEN 'wrong_keys'
         WHEN json_type(line, '$.speaker') <> 'VARCHAR' OR json_type(line, '$.text') <> 'VARCHAR'
           OR json_type(line, '$.start') NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT')
           OR json_type(line, '$.end') NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'bad_value'
    END AS reason
  FROM ln
)"""


def jsonl_ctes(numbered: str) -> str:
    """Faulty lines, ``numbered`` as ``ln(session_id, line_no, line)``, checked."""
    return ",".join((JSONL_LINES, numbered, JSONL_CHECK))


JSONL_CTES = jsonl_ctes(JSONL_DOCS)

ASR_CTE = FIXTURE_CTES + """,
asr_words AS (
  SELECT session_id,
         CAST(row_number() OVER (PARTITION BY session_id ORDER BY seg_idx, p) - 1 AS BIGINT) AS word_idx,
         ' ' || w AS text, CAST(start_s + p * 0.25 AS DOUBLE) AS start_s,
         CAST(start_s + p * 0.25 + 0.25 AS DOUBLE) AS end_s
  FROM (SELECT session_id, seg_idx, start_s,
               UNNEST(string_split(text, ' ')) AS w,
               UNNEST(range(0, len(string_split(text, ' ')))) AS p
        FROM seg WHERE (session_id * 7 + seg_idx) % 9 <> 0) x
)"""

BATCH_CTES = FIXTURE_CTES + "," + RESOLVED_CTE + f""",
sizes AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_bytes FROM conversations GROUP BY conv_id),
expected0 AS (
  SELECT conv_id AS session_id, n_bytes FROM sizes
  UNION ALL
  SELECT conv_id + 1000000 AS session_id, CAST(NULL AS BIGINT) AS n_bytes FROM sizes WHERE conv_id % 50 = 0
),
expected AS (
  SELECT session_id, 'session-' || lpad(CAST(session_id AS VARCHAR), 7, '0') AS stem, n_bytes FROM expected0
),
wc AS (SELECT session_id, count(*) AS n_words FROM words GROUP BY session_id),
inputs AS (
  SELECT e.session_id, e.stem,
    CASE WHEN e.n_bytes IS NULL THEN 'missing' WHEN e.n_bytes = 0 OR w.n_words IS NULL THEN 'empty'
         ELSE 'ok' END AS input_status
  FROM expected e LEFT JOIN wc w ON e.session_id = w.session_id
),
gates AS (
  SELECT session_id,
         {gate_sql(f"coalesce(nullif(base_url, ''), {sql_string(ep.DEFAULT_BASE_URL)})", 'allow_remote')} AS gate
  FROM resolved
),
outs AS (
  SELECT i.session_id, i.stem, i.stem || '.wav' AS input_name,
    CASE WHEN i.input_status <> 'ok' OR g.gate = 'refused' THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN i.input_status <> 'ok' THEN 'input' WHEN g.gate = 'refused' THEN 'summarize' END AS stage,
    CASE WHEN i.input_status <> 'ok' THEN 'input ' || i.input_status
         WHEN g.gate = 'refused' THEN 'remote endpoint without allow_remote' END AS reason,
    CASE WHEN NOT (i.input_status <> 'ok' OR coalesce(g.gate = 'refused', false))
         THEN i.stem || '.note.txt' END AS file_name
  FROM inputs i LEFT JOIN gates g ON i.session_id = g.session_id
)"""

RESPONSE_ERROR = """
       CASE WHEN status IS NULL THEN 'LLM request failed: no status ' || coalesce(body, '')
            WHEN status < 200 OR status > 299
            THEN 'LLM request failed: ' || CAST(status AS VARCHAR) || ' ' || coalesce(body, '')
            WHEN content IS NULL THEN 'Unexpected LLM response format: ' || coalesce(body, '')
       END"""

NOTE_CTES = BATCH_CTES + ",\n" + _templates_values() + "," + RESPONSES_CTE + f""",
answer AS (SELECT session_id, content, {RESPONSE_ERROR} AS error FROM parsed WHERE turn = 0),
results AS (
  SELECT st.session_id, a.content,
    CASE WHEN t.template_id IS NULL THEN 'template not found' WHEN a.session_id IS NULL THEN 'no response'
         ELSE a.error END AS error
  FROM resolved st LEFT JOIN templates t ON st.template_id = t.template_id
  LEFT JOIN answer a ON st.session_id = a.session_id
),
nouts AS (
  SELECT o.session_id, o.stem, o.input_name,
    CASE WHEN o.status = 'failed' OR r.error IS NOT NULL THEN 'failed' ELSE 'ok' END AS status,
    coalesce(o.stage, CASE WHEN r.error IS NOT NULL THEN 'summarize' END) AS stage,
    coalesce(o.reason, r.error) AS reason,
    CASE WHEN o.status = 'ok' AND r.error IS NULL THEN o.file_name END AS file_name
  FROM outs o LEFT JOIN results r ON o.session_id = r.session_id
)"""

QUARANTINE = f"""
SELECT session_id, CAST(line_no AS BIGINT) AS line_no,
       CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason,
       CASE WHEN reason IS NULL THEN CAST(count(*) FILTER (WHERE reason IS NULL) OVER (
            PARTITION BY session_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            AS BIGINT) END AS seg_idx,
       CASE WHEN reason IS NULL THEN json_extract_string(line, '$.speaker') END AS speaker,
       CASE WHEN reason IS NULL THEN json_extract_string(line, '$.text') END AS text,
       CASE WHEN reason IS NULL THEN CAST(json_extract(line, '$.start') AS DOUBLE) END AS start_s,
       CASE WHEN reason IS NULL THEN CAST(json_extract(line, '$.end') AS DOUBLE) END AS end_s,
       CASE WHEN reason IS NOT NULL THEN {redact_patterns('line')} END AS line
FROM chk"""

ORACLE: dict[str, str] = {
    "redact_documents": f"SELECT doc_id, {redact_patterns('text')} AS text FROM documents",
    "redact_names": with_(FIXTURE_CTES,
                          f"SELECT session_id, seg_idx, {redact_text('text', fx.NAMES)} AS text FROM seg"),
    "transcript_plain": with_(FIXTURE_CTES, transcript_sql("seg", False)),
    "transcript_timed": with_(FIXTURE_CTES, transcript_sql("seg", True)),
    "session_summary": with_(FIXTURE_CTES, f"""
SELECT session_id, {duration('max(end_s) - min(start_s)')} AS duration,
       array_to_string(list_sort(list(DISTINCT speaker)), ', ') AS speakers,
       count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers
FROM seg GROUP BY session_id"""),
    "assign_speaker": with_(FIXTURE_CTES + "," + ALIGN_CTES,
                            "SELECT session_id, word_idx, speaker FROM assigned"),
    "align_runs": with_(FIXTURE_CTES + "," + ALIGN_CTES, "SELECT * FROM aligned"),
    "label_speakers": with_(FIXTURE_CTES + "," + label_cte("seg", SPEAKER_NAMES),
                            "SELECT session_id, seg_idx, speaker FROM labeled"),
    "editable_export": with_(FIXTURE_CTES + "," + EDITABLE_CTE, "SELECT * FROM ed0"),
    "editable_import": with_(FIXTURE_CTES + "," + EDITABLE_CTE + "," + EDITED_CTE, IMPORT_BODY),
    "transcript_pipeline": with_(
        FIXTURE_CTES + "," + ALIGN_CTES + "," + label_cte("aligned", SPEAKER_NAMES) + f""",
red AS (SELECT session_id, seg_idx, speaker, {redact_text('text', fx.NAMES)} AS text, start_s, end_s
        FROM labeled)""",
        transcript_sql("red", True)),
    "render_notes": with_(PROMPT_CTES, "SELECT * FROM prompts"),
    "prompt_budget": with_(PROMPT_CTES, f"""
SELECT template_id, count(*) AS n_prompts,
       count_if({est_sql('prompt')} > {ep.TOKEN_WARNING_THRESHOLD}) AS n_too_long,
       max({est_sql('prompt')}) AS max_tokens
FROM prompts WHERE prompt IS NOT NULL GROUP BY template_id"""),
    "chat_requests": with_(PROMPT_CTES, f"""
SELECT p.session_id, p.template_id,
       {gate_sql(f"coalesce(nullif(s.base_url, ''), {sql_string(ep.DEFAULT_BASE_URL)})", 's.allow_remote')} AS gate,
       {est_sql('p.prompt')} AS est_tokens, {est_sql('p.prompt')} > {ep.TOKEN_WARNING_THRESHOLD} AS too_long,
       {url_sql(f"coalesce(nullif(s.base_url, ''), {sql_string(ep.DEFAULT_BASE_URL)})")} AS url,
       CASE WHEN p.prompt IS NOT NULL THEN json_object('model', coalesce(nullif(s.model, ''), {sql_string(ep.DEFAULT_MODEL)}),
                   'messages', [json_object('role', 'user', 'content', p.prompt)],
                   'temperature', {ep.TEMPERATURE})::VARCHAR END AS request, p.error
FROM prompts p LEFT JOIN resolved s ON p.session_id = s.session_id"""),
    "endpoint_gate": with_(GATE_TARGETS, f"""
SELECT page_id, base_url, {is_local_sql('base_url')} AS is_local,
       {gate_sql('base_url', 'allow_remote')} AS gate, {url_sql('base_url')} AS url
FROM tg"""),
    "chat_responses": with_(RESPONSES_CTE, f"""
SELECT session_id, turn, content,
       {RESPONSE_ERROR} AS error
FROM parsed"""),
    "jsonl_roundtrip": with_(FIXTURE_CTES, """
SELECT session_id, CAST(seg_idx AS BIGINT) AS seg_idx, speaker, text, start_s, end_s FROM seg"""),
    "jsonl_quarantine": with_(JSONL_CTES, QUARANTINE),
    "flatten_asr": with_(ASR_CTE, "SELECT * FROM asr_words"),
    "settings_resolution": with_(RESOLVED_CTE, "SELECT * FROM resolved"),
    "session_redaction": with_(FIXTURE_CTES + "," + RESOLVED_CTE, f"""
SELECT s.session_id, s.seg_idx, {redact_resolved('s.text', 'r')} AS text
FROM seg s LEFT JOIN resolved r ON s.session_id = r.session_id"""),
    "rejected_words": with_(FIXTURE_CTES, """
SELECT session_id, word_idx, text,
       CASE (session_id + word_idx) % 50 WHEN 0 THEN 'missing time' ELSE 'implausible time' END AS reason
FROM words WHERE (session_id + word_idx) % 50 IN (0, 1)"""),
    "batch_outcomes": with_(BATCH_CTES, "SELECT * FROM outs"),
    "batch_report": with_(BATCH_CTES,
                          "SELECT status, stage, count(*) AS n_sessions FROM outs GROUP BY status, stage"),
    "batch_artifacts": with_(BATCH_CTES + ",\ntx AS (" + transcript_sql("seg", True) + ")", """
SELECT i.session_id, i.stem || '.txt' AS file_name, t.transcript || chr(10) AS content
FROM inputs i JOIN tx t ON i.session_id = t.session_id WHERE i.input_status = 'ok'"""),
    "note_outcomes": with_(NOTE_CTES, "SELECT * FROM nouts"),
    "note_artifacts": with_(NOTE_CTES, """
SELECT n.session_id, n.file_name, r.content || chr(10) AS content
FROM nouts n JOIN results r ON n.session_id = r.session_id WHERE n.status = 'ok'"""),
    "failed_names": with_(NOTE_CTES, "SELECT input_name, stage, reason FROM nouts WHERE status = 'failed'"),
    "failed_sessions": with_(NOTE_CTES, "SELECT session_id, stem FROM nouts WHERE status = 'failed'"),
    "render_fanout": with_(PROMPT_CTES, f"""
SELECT st.session_id, w.template_id,
       {substitute_sql("t.body", dict(transcript="v.transcript", speakers="v.speakers",
                                      date="coalesce(nullif(st.session_date, ''), " + sql_string(RUN_DATE) + ")",
                                      duration="v.duration",
                                      client_name="coalesce(nullif(st.client_name, ''), "
                                      + sql_string(tp.DEFAULT_CLIENT) + ")"))} AS prompt,
       CASE WHEN t.body IS NULL THEN 'template not found' END AS error
FROM settings st CROSS JOIN (SELECT unnest(['soap', 'dap', 'withdrawn']) AS template_id) w
LEFT JOIN templates t ON w.template_id = t.template_id
LEFT JOIN (
  SELECT session_id, string_agg({line_sql(True)}, {NL} || {NL} ORDER BY seg_idx) AS transcript,
         array_to_string(list_sort(list(DISTINCT speaker)), ', ') AS speakers,
         {duration('max(end_s) - min(start_s)')} AS duration
  FROM seg GROUP BY session_id) v ON st.session_id = v.session_id"""),
    "streaming_redact": with_(FIXTURE_CTES, f"""
SELECT session_id, CAST(seg_idx AS BIGINT) AS seg_idx, speaker, {redact_text('text', fx.NAMES)} AS text,
       start_s, end_s
FROM seg"""),
}
