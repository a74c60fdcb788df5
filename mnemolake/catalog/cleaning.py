"""Registered queries: cleaning rules as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.catalog.base import (
    MSG_SQL, QA_SQL, Registry, dump_sql, lstrip_sql, markers_sql, messages, planted, planted_sql,
    preamble_sql, prefixes_sql, q, stored_pairs, strip_sql,
)
from mnemolake.functions import clean as C
from mnemolake.functions import text as T
from mnemolake.functions import timefn
from mnemolake.operators import index_state, sessions, topics

reg = Registry()

MARKERS = {
    1: ("[Wed 2026-04-22 01:59 GMT+8] ", ""), 2: ("[message_id: m-9]\n", ""), 3: ("[[reply_to_current]] ", " \n"),
    4: ("  [Thu 2026-04-23 11:09 GMT+8] [message_id: z] [[reply_to_current]]\n", ""),
}


@reg.query("P1", f"WITH {planted_sql(MARKERS, 6)} SELECT doc_id, md5({markers_sql('c')}) AS body FROM d")
def host_marker_strip(t):
    return planted(t, MARKERS, 6).select("doc_id", F.md5(C.strip_host_markers(F.col("c"))).alias("body"))


WRAPPED = {1: ('Sender (untrusted metadata):\n```json\n{"a": 1}\n```\n', ""), 2: ('x Conversation info (untrusted metadata): ```json {"b": {"c": 2}} ``` ', "")}


@reg.query("P2", f"WITH {planted_sql(WRAPPED, 4)} SELECT doc_id, md5(regexp_replace(c, {q(R.UNTRUSTED_WRAPPER)}, '', 'g')) AS body FROM d")
def wrapper_strip(t):
    return planted(t, WRAPPED, 4).select("doc_id", F.md5(C.strip_wrapper(F.col("c"))).alias("body"))


PUA = {1: ("", ""), 3: ("", "")}


@reg.query("P3", f"WITH {planted_sql(PUA, 5)} SELECT doc_id, regexp_matches(c, {q(R.PRIVATE_USE)}) AS mojibake FROM d")
def mojibake_flags(t):
    return planted(t, PUA, 5).select("doc_id", C.has_mojibake(F.col("c")).alias("mojibake"))


MACHINE = {
    1: ("[SILENT]", ""), 2: (" [cron: job] ", ""), 3: ("[Fri 2026-05-01 7:05 GMT+0] [cron[x] ", ""),
    4: ('[{"type":"thinking","text":"', '"}]'), 5: ("I said [SILENT] ", ""), 6: ("[IMPORTANT: do this] ", ""),
}


@reg.query("P4", f"WITH {planted_sql(MACHINE, 9)} SELECT doc_id, {preamble_sql('c')} AS machine FROM d")
def machine_preambles(t):
    return planted(t, MACHINE, 9).select("doc_id", C.is_machine_preamble(F.col("c")).alias("machine"))


SHELLS = {
    1: ("[OUT-OF-BAND USER MESSAGE — x] ", "\n[/OUT-OF-BAND USER MESSAGE]"),
    2: ("[Continuing toward your standing goal]\nGoal: ", "\nContinue working toward this goal"),
    3: ("[Mentioned: A (id=1)] ", ""), 4: ("[Replying to: B]\n", ""), 5: ("[[reply_to_current]]\n", ""),
    6: ('[IMPORTANT: The user has invoked the "x" skill]\nThe user has provided the following instruction alongside the skill invocation: ', ""),
    7: ('[IMPORTANT: The user has invoked the "y" skill] ', ""),
}
_T = strip_sql("c")
UNWRAP_SQL = f"""CASE WHEN starts_with({_T}, {q(R.OOB_OPEN)}) THEN {strip_sql(f"regexp_extract({_T}, {q(R.OOB_BODY)}, 1)")}
 WHEN starts_with({_T}, {q(R.GOAL_OPEN)}) THEN {strip_sql(f"regexp_extract({_T}, {q(R.GOAL_BODY)}, 1)")}
 WHEN starts_with({_T}, '[Mentioned:') OR starts_with({_T}, '[Replying to:') THEN
   CASE WHEN strpos({_T}, ']' || chr(10)) > 0 THEN {strip_sql(f"substr({_T}, strpos({_T}, ']' || chr(10)) + 1)")}
        WHEN strpos({_T}, '] ') > 0 THEN {strip_sql(f"substr({_T}, strpos({_T}, '] ') + 1)")} ELSE '' END
 WHEN starts_with({_T}, {q(R.REPLY_MARK)}) THEN {strip_sql(f"substr({_T}, {len(R.REPLY_MARK) + 1})")}
 WHEN starts_with({_T}, {q(R.SKILL_OPEN)}) THEN {strip_sql(f"regexp_extract({_T}, {q(R.SKILL_BODY)}, 1)")} END"""
KIND_OF_SHELL_SQL = f"""CASE WHEN starts_with({_T}, {q(R.OOB_OPEN)}) THEN 'out_of_band' WHEN starts_with({_T}, {q(R.GOAL_OPEN)}) THEN 'standing_goal'
 WHEN starts_with({_T}, '[Mentioned:') OR starts_with({_T}, '[Replying to:') THEN 'platform_prefix' WHEN starts_with({_T}, {q(R.REPLY_MARK)}) THEN 'reply_quote'
 WHEN starts_with({_T}, {q(R.SKILL_OPEN)}) THEN 'skill_invocation' END"""


@reg.query("P5", f"WITH {planted_sql(SHELLS, 9)} SELECT doc_id, {KIND_OF_SHELL_SQL} AS kind, md5({UNWRAP_SQL}) AS body FROM d")
def shell_unwrap(t):
    d = planted(t, SHELLS, 9).withColumn("s", C.unwrap_injected(F.col("c")))
    return d.select("doc_id", "s.kind", F.md5("s.body").alias("body"))


NOISE = {
    1: ("[cron: a] ", ""), 2: ("ANNOUNCE_SKIP ", ""), 3: ("[2026-04-22] [Subagent Context] ", ""), 4: ("Continue where you left off ", ""),
    5: ("see HEARTBEAT_OK ", ""), 6: ("This image shows ", ""), 7: ("   ", ""),
}
_PL = strip_sql(f"regexp_replace({_T}, {q('^' + R.TS_PREFIX)}, '')")
NOISE_SQL = f"""CASE WHEN {_T} = '' THEN 'empty' WHEN regexp_matches({_PL}, {q(R.CRON_BRACKET)}) THEN 'cron'
 WHEN {prefixes_sql(_T, R.AUTOMATION_PREFIXES)} THEN 'automation'
 WHEN regexp_matches({_T}, {q(R.INJECTION_HEAD)}) OR regexp_matches({_T}, {q(R.SUBAGENT_ANYWHERE)}) OR regexp_matches({_PL}, {q(R.SYSTEM_INJECT_HEAD)}) THEN 'subagent'
 WHEN regexp_matches({_T}, {q(R.HEARTBEAT_ANYWHERE)}) THEN 'heartbeat'
 WHEN role = 'system' THEN 'system' WHEN role = 'tool' THEN 'tool'
 WHEN regexp_matches({_T}[1:200], {q(R.IMAGE_DESCRIPTION)}) THEN 'image_desc'
 WHEN c IN ('{{"action": "none"}}') THEN 'tool_json' END"""
_NOISE_ROLE_SQL = "CASE doc_id % 10 WHEN 8 THEN 'system' WHEN 9 THEN 'tool' ELSE 'user' END AS role"


@reg.query("P6", f"""WITH {planted_sql(NOISE, 13)}, e AS (SELECT doc_id, {_NOISE_ROLE_SQL}, CASE WHEN doc_id % 17 = 0 THEN '{{"action": "none"}}' WHEN doc_id % 29 = 0 THEN '{{"answer": 1}}' ELSE c END AS c FROM d)
SELECT reason, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, {NOISE_SQL} AS reason FROM e) GROUP BY reason""")
def noise_reasons(t):
    d = planted(t, NOISE, 13).withColumn(
        "role", F.when(F.col("doc_id") % 10 == 8, "system").when(F.col("doc_id") % 10 == 9, "tool").otherwise("user")
    ).withColumn(
        "c",
        F.when(F.col("doc_id") % 17 == 0, '{"action": "none"}').when(F.col("doc_id") % 29 == 0, '{"answer": 1}').otherwise(F.col("c")),
    )
    return d.withColumn("reason", C.noise_reason(F.col("role"), F.col("c"))).groupBy("reason").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc")
    )


DUMPS = {1: ('{"version": 2, ', "}"), 2: ("  # USER.md\n", ""), 3: ('{"x": 1, "processed_files": [', "]}"), 4: ("@file:a ", "")}


@reg.query("P7", f"WITH {planted_sql(DUMPS, 7)} SELECT doc_id, {dump_sql('c')} AS dump FROM d")
def machine_dumps(t):
    return planted(t, DUMPS, 7).select("doc_id", C.is_machine_dump(F.col("c")).alias("dump"))


GLUE = {1: ("\n[PRIOR CONTEXT] ", ""), 2: ("[STILL IN PROGRESS — a] ", ""), 3: ("not [PRIOR CONTEXT] ", "")}


@reg.query("P8", f"WITH {planted_sql(GLUE, 5)} SELECT doc_id FROM d WHERE NOT regexp_matches({lstrip_sql('c')}, {q(R.COMPACTION_HEAD)})")
def compaction_dropped(t):
    return planted(t, GLUE, 5).filter(~C.is_compaction_glue(F.col("c"))).select("doc_id")


HEADS = {1: ("Sat 2026-04-11 01:15 GMT+8] [Subagent Context] ", ""), 2: ("[12:30] [System: x] ", ""), 3: ("12:30 plain ", ""), 4: ("[2026-01-02][IMPORTANT: y] ", "")}
_HEAD_RE = q(r"^\s*\[?\s*(?:" + R.TIME_WRAPPER_BODY + r")\s*\]?\s*\[")


@reg.query("P10", f"WITH {planted_sql(HEADS, 6)} SELECT doc_id, md5(regexp_replace({lstrip_sql('c')}, {_HEAD_RE}, '[')) AS head FROM d")
def normalized_heads(t):
    return planted(t, HEADS, 6).select("doc_id", F.md5(C.normalize_head(F.col("c"))).alias("head"))


OOB = {1: ("[OUT-OF-BAND USER MESSAGE — a]\n", "\n[/OUT-OF-BAND USER MESSAGE]"), 2: ("[OUT-OF-BAND USER MESSAGE]\r\n", ""), 3: ("[OUT-OF-BAND USER MESSAGE no end ", "")}


@reg.query("P11", f"""WITH {planted_sql(OOB, 5).replace(chr(13), "' || chr(13) || '")}, h AS (SELECT doc_id, c, {lstrip_sql('c')} AS head FROM d),
o AS (SELECT doc_id, c, head, strpos(head, ']') AS p FROM h),
b AS (SELECT *, substr(head, p + 1) AS body FROM o)
SELECT doc_id, md5(CASE WHEN starts_with(head, {q(R.OOB_OPEN)}) AND p > 0 THEN trim(CASE WHEN contains(body, {q(R.OOB_CLOSE)}) THEN left(body, length(body) - length(string_split(body, {q(R.OOB_CLOSE)})[-1]) - {len(R.OOB_CLOSE)}) ELSE body END, chr(13)||chr(10)) ELSE c END) AS payload FROM b""")
def oob_payloads(t):
    return planted(t, OOB, 5).select("doc_id", F.md5(C.oob_payload(F.col("c"))).alias("payload"))


@reg.query("P13", "SELECT count(*) AS rows_with_nul, sum(length(text)) AS chars FROM documents")
def nul_sanitize(t):
    d = t.documents.select("doc_id", F.concat(F.lit("\x00"), "text", F.lit("\x00")).alias("c"))
    return d.agg(F.count_if(C.had_nul(F.col("c"))).alias("rows_with_nul"), F.sum(F.length(C.remove_nul(F.col("c")))).alias("chars"))


TS_VARIANTS_SQL = """v AS (SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, date_trunc('second', ts) AS sec FROM events),
w AS (SELECT event_id, s, CASE event_id % 7 WHEN 0 THEN CAST(s AS VARCHAR) WHEN 1 THEN CAST(s * 1000 AS VARCHAR) WHEN 2 THEN strftime(sec, '%Y-%m-%dT%H:%M:%SZ')
 WHEN 3 THEN strftime(sec, '%Y-%m-%d %H:%M:%S+02') WHEN 4 THEN strftime(sec, '%Y-%m-%d %H:%M:%S') WHEN 5 THEN strftime(sec, '%Y-%m-%dT%H:%M:%S.500Z') ELSE 'not a time' END AS raw FROM v)"""


@reg.query("P14 F12", f"""WITH {TS_VARIANTS_SQL}
SELECT event_id, CASE event_id % 7 WHEN 3 THEN (s - 7200) * 1000 WHEN 5 THEN s * 1000 + 500 WHEN 6 THEN NULL ELSE s * 1000 END AS epoch_ms,
 CASE event_id % 7 WHEN 0 THEN strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE raw END AS iso FROM w""")
def timestamps_normalised(t):
    s = F.unix_timestamp(F.date_trunc("second", "ts"))
    sec = F.timestamp_seconds(s)
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, s.cast("string")).when(k == 1, (s * 1000).cast("string"))
        .when(k == 2, F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, F.date_format(sec, "yyyy-MM-dd HH:mm:ss'+02'"))
        .when(k == 4, F.date_format(sec, "yyyy-MM-dd HH:mm:ss")).when(k == 5, F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'.500Z'"))
        .otherwise("not a time")
    )
    e = t.events.select("event_id", raw.alias("raw"))
    return e.select(
        "event_id", F.unix_millis(timefn.parse_ts(F.col("raw"))).alias("epoch_ms"), timefn.to_iso(F.col("raw")).alias("iso")
    )


@reg.query("P15", f"SELECT doc_id, md5(CASE WHEN {strip_sql('text')} = '' THEN '' ELSE {strip_sql('text')} || chr(10) || chr(10) END || source) AS joined FROM documents")
def text_blocks(t):
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit("ignored").alias("text")),
        F.struct(F.lit("text").alias("type"), F.lit("  ").alias("text")),
        F.struct(F.lit("text").alias("type"), F.col("source").alias("text")),
    )
    return t.documents.select("doc_id", F.md5(C.join_text_blocks(blocks)).alias("joined"))


@reg.query("P16", """WITH m AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 9 = 0 THEN '[System note: x' || text WHEN (conv_id + turn) % 10 = 0 THEN '  ' ELSE text END AS c,
 CASE WHEN turn % 6 = 5 THEN 'hidden' END AS dk FROM conversations)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN role NOT IN ('user','assistant') THEN 'skipped_roles' WHEN trim(c) = '' THEN 'skipped_empty'
 WHEN starts_with(c, '[System note:') THEN 'skipped_system_text' WHEN dk = 'hidden' THEN 'skipped_display_kind' END AS reason FROM m) GROUP BY 1""")
def import_skip_ladder(t):
    n = F.col("conv_id") + F.col("turn")
    m = t.conversations.select(
        "role",
        F.when(n % 9 == 0, F.concat(F.lit("[System note: x"), "text")).when(n % 10 == 0, "  ").otherwise(F.col("text")).alias("c"),
        F.when(F.col("turn") % 6 == 5, "hidden").alias("dk"),
    )
    reason = F.coalesce(C.import_skip_reason(F.col("role"), F.col("c"), F.col("dk")), F.lit("kept"))
    return m.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_IQ, _IA = strip_sql("q2"), strip_sql("a2")


@reg.query("P17", f"""WITH {QA_SQL}, v AS (SELECT id, CASE id % 11 WHEN 1 THEN 'heartbeat ' || question WHEN 2 THEN '[IMPORTANT: ' || question WHEN 3 THEN 'abc' ELSE question END AS q2,
 CASE id % 13 WHEN 1 THEN '(tool call only)' WHEN 2 THEN 'maximum number of tool-calling iterations reached' ELSE coalesce(answer, '') END AS a2 FROM qp)
SELECT id FROM v WHERE length({_IQ}) >= 5 AND length({_IA}) >= 5 AND NOT starts_with(lower({_IQ}), 'heartbeat') AND NOT starts_with(lower({_IQ}), 'system')
 AND NOT regexp_matches({_IQ}, {q(R.IMPORT_INJECTION_HEAD)}) AND NOT {prefixes_sql(_IQ, R.IMPORT_INJECTION_PREFIXES)}
 AND NOT contains(lower({_IQ}), {q(R.IMPORT_NOISE[0])}) AND NOT contains(lower({_IA}), {q(R.IMPORT_NOISE[0])}) AND {_IA} <> '(tool call only)'""")
def importable_pairs(t):
    p = stored_pairs(t)
    k, m = F.col("id") % 11, F.col("id") % 13
    qn = F.when(k == 1, F.concat(F.lit("heartbeat "), "question")).when(k == 2, F.concat(F.lit("[IMPORTANT: "), "question")).when(k == 3, "abc").otherwise(F.col("question"))
    an = F.when(m == 1, R.TOOL_ONLY_ANSWER).when(m == 2, "maximum number of tool-calling iterations reached").otherwise(F.coalesce("answer", F.lit("")))
    return p.withColumns({"q2": qn, "a2": an}).filter(C.is_importable_qa(F.col("q2"), F.col("a2"))).select("id")


@reg.query("P18", f"WITH {QA_SQL} SELECT id FROM (SELECT id, CASE WHEN id % 16 = 3 THEN NULL ELSE session_id END AS session_id FROM qp) WHERE session_id NOT LIKE '%.trajectory%'")
def inspection_sessions(t):
    p = stored_pairs(t).withColumn("session_id", F.when(F.col("id") % 16 != 3, F.col("session_id")))
    return p.filter(C.not_inspection_session(F.col("session_id"))).select("id")


SECRETS = {1: ("postgres://bob:pw@host/db ", ""), 2: ("Authorization: Bearer abc.def-1 ", ""), 3: ("api_key = 12345, token:xyz; ", ""), 4: ("PASSWORD:hunter2 ", "")}


@reg.query("P19", f"""WITH {planted_sql(SECRETS, 6)}, r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(c, {q(R.URL_USERINFO)}, '\\1***@', 'g'), {q(R.BEARER)}, 'bearer=<redacted>', 'g'), {q(R.SECRET_PAIR)}, '\\1=<redacted>', 'g') AS s FROM d)
SELECT doc_id, CASE WHEN length(s) > 240 THEN s[1:237] || '...' ELSE s END AS redacted FROM r""")
def redaction(t):
    return planted(t, SECRETS, 6).select("doc_id", C.redact(F.col("c")).alias("redacted"))


@reg.query("P19", "SELECT page_id, 'page' AS kind, string_split(url, '/')[-1] AS leaf, sha256(url)[1:12] AS hash12 FROM pages")
def path_labels(t):
    return t.pages.select("page_id", C.path_label(F.col("url"), "page").alias("l")).select("page_id", "l.kind", "l.leaf", "l.hash12")


TAG_LIST_SQL = """tg AS (SELECT doc_id, list_concat(list_concat(string_split(text, ' '), ['alpha beta gamma delta', '  padded  ', '中文标签超过八个字不要', '短标签', 'x' || chr(7) || 'y', ',edge!', 'a-tag-that-is-longer-than-thirty-characters']), [source, ' alpha beta gamma delta', source]) AS tags FROM documents)"""


def tag_lists(t):
    planted_tags = F.array(*[F.lit(x) for x in (
        "alpha beta gamma delta", "  padded  ", "中文标签超过八个字不要", "短标签", "x\x07y", ",edge!",
        "a-tag-that-is-longer-than-thirty-characters",
    )])
    return t.documents.select(
        "doc_id", F.concat(F.split("text", " "), planted_tags, F.array("source", F.lit(" alpha beta gamma delta"), "source")).alias("tags")
    )


_CJKLEN = "length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))"


@reg.query("P20", f"""WITH {TAG_LIST_SQL}, x AS (SELECT doc_id, unnest(tags) AS t0, generate_subscripts(tags, 1) AS i FROM tg),
s AS (SELECT doc_id, {strip_sql('t0')} AS t, min(i) AS i FROM x GROUP BY 1, 2),
k AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM s WHERE t <> '' AND length(t) <= 20 AND {_CJKLEN} <= 8
  AND NOT (len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) > 3 AND {_CJKLEN} = 0))
SELECT doc_id, string_agg(t, '|' ORDER BY rn) AS tags FROM k WHERE rn <= 12 GROUP BY doc_id""")
def keyword_hygiene(t):
    return tag_lists(t).select("doc_id", F.array_join(T.keyword_hygiene(F.col("tags")), "|").alias("tags"))


@reg.query("P21", f"""WITH {TAG_LIST_SQL}, x AS (SELECT doc_id, unnest(tags) AS t0, generate_subscripts(tags, 1) AS i FROM tg),
s AS (SELECT doc_id, i, trim(regexp_replace(t0, '[\\x00-\\x1f\\x7f]', '', 'g'), ' ,.;:!?-') AS t FROM x)
SELECT doc_id, string_agg(t, '|' ORDER BY i) AS tags FROM s WHERE t <> '' AND length(t) <= 30 GROUP BY doc_id""")
def tag_hygiene(t):
    return tag_lists(t).select("doc_id", F.array_join(T.tag_hygiene(F.col("tags")), "|").alias("tags"))


@reg.query("P22", f"""WITH {QA_SQL} SELECT 'qa_pairs' AS tab, id, md5(CASE WHEN coalesce(answer,'') <> '' THEN question || chr(10) || answer ELSE question END) AS h FROM qp
UNION ALL SELECT 'topics', doc_id, md5({strip_sql("source || '. ' || text[1:100] || ' ' || text[1:800] || ' ' || lang || ' ' || source")}[1:1000]) FROM documents
UNION ALL SELECT 'paragraphs', doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text[1:2000] ELSE source || '. ' || text[1:1500] END) FROM documents""")
def canonical_texts(t):
    a = stored_pairs(t).select(F.lit("qa_pairs").alias("tab"), "id", F.md5(index_state.canonical_text("qa_pairs")).alias("h"))
    d = t.documents.select(
        "doc_id", F.col("source").alias("title"), F.substring("text", 1, 100).alias("summary"), F.col("text").alias("body"),
        F.array("lang", "source").alias("keywords"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, "e1_seg_1_0").otherwise("v1").alias("version"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("E1/"), "source")).otherwise(F.col("source")).alias("section"),
    )
    b = d.select(F.lit("topics").alias("tab"), F.col("doc_id").alias("id"), F.md5(index_state.canonical_text("topics")).alias("h"))
    c = d.select(F.lit("paragraphs").alias("tab"), F.col("doc_id").alias("id"), F.md5(index_state.canonical_text("paragraphs")).alias("h"))
    return a.unionByName(b).unionByName(c)


TASKY = {1: ("run deleg_0a1b2c3d now project: alpha.x ", ""), 2: ("[cron:ab12cd34-1] ", ""), 3: ("job_id: ffee0011 ", ""), 4: ("scheduled cron job (job id 00aa11bb ", "")}
_TASK_SQL = "coalesce(" + ", ".join(
    f"CASE WHEN regexp_extract(c, {q(p)}, 1) <> '' THEN '{pre}' || regexp_extract(c, {q(p)}, 1) END"
    for p, pre in [(R.DELEGATION_ID, "deleg:"), *[(p, "cron:") for p in R.CRON_IDS]]
) + ")"


@reg.query("P23", f"WITH {planted_sql(TASKY, 7)} SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'task:T' || doc_id ELSE {_TASK_SQL} END AS task_id, nullif(regexp_extract(c, {q(R.PROJECT_REF)}, 1), '') AS project FROM d")
def task_identity(t):
    d = planted(t, TASKY, 7)
    own = F.when(F.col("doc_id") % 7 == 6, F.concat(F.lit("T"), "doc_id"))
    return d.select(
        "doc_id", sessions.derive_task_id(F.col("c"), own, F.lit(None).cast("string")).alias("task_id"),
        sessions.derive_project(F.col("c")).alias("project"),
    )


RECEIPT = {
    1: ("[ASYNC DELEGATION BATCH COMPLETE — deleg_aa11bb] Dispatched: 2026-01-02 03:04:05\n✓ TASK 1/2: fix it (status=completed, 3s)\n✗ TASK 2/2: test  it (status=timeout)\n", ""),
    2: ("[ASYNC DELEGATION BATCH COMPLETE - deleg_cc22dd]\n✔ TASK 1/1: ship (status=running)\n", ""),
    3: ("[ASYNC DELEGATION BATCH COMPLETE — deleg_ee33ff] nothing listed", ""),
}
_RP, _LINE = q(R.RECEIPT), q(R.TASK_LINE)
_FLAT = lambda x: strip_sql(f"regexp_replace({x}, '\\s+', ' ', 'g')")
_CLIP = lambda x: f"CASE WHEN length({_FLAT(x)}) <= 400 THEN {_FLAT(x)} ELSE {_FLAT(x)}[1:399] || '…' END"


@reg.query("P24 G5 I6", f"""WITH {planted_sql(RECEIPT, 11)}, r AS (SELECT doc_id, c, lower(regexp_extract(c, {_RP}, 1)) AS dg FROM d),
k AS (SELECT doc_id, c, 'deleg:' || regexp_replace(dg, '^deleg_', '') AS pre, 'conversation_stream:test:' || source || ':' || doc_id AS source_id,
   CASE WHEN regexp_extract(c, {q(R.DISPATCHED)}, 1) <> '' THEN regexp_extract(c, {q(R.DISPATCHED)}, 1) || 'T' || regexp_extract(c, {q(R.DISPATCHED)}, 2) ELSE 'now' END AS created_at,
   regexp_extract_all(c, {_LINE}, 0) AS lines FROM r JOIN documents USING (doc_id) WHERE dg <> ''),
u AS (SELECT *, unnest(lines) AS line FROM k),
l AS (SELECT *, CASE WHEN len(lines) > 1 THEN pre || ':' || regexp_extract(line, {_LINE}, 1) ELSE pre END AS task_id, regexp_extract(line, {_LINE}, 3) AS goal, regexp_extract(line, {_LINE}, 4) AS st FROM u),
e AS (SELECT task_id, 'created' AS event_type, {_CLIP('goal')} AS summary, source_id, created_at AS occurred_at FROM l
 UNION ALL SELECT task_id, CASE lower(st) WHEN 'completed' THEN 'completed' WHEN 'timeout' THEN 'failed' ELSE 'progress' END, {_CLIP("(goal || ' — status=' || st)")}, source_id, 'now' FROM l
 UNION ALL SELECT pre, 'progress', {_CLIP("string_split(c, ']')[-1]")}, source_id, 'now' FROM k WHERE len(lines) = 0)
SELECT *, 'te_' || sha256(task_id || '|' || event_type || '|' || source_id)[1:32] AS event_id FROM e""")
def task_event_rows(t):
    d = planted(t, RECEIPT, 11)
    items = d.select(
        F.lit("test").alias("host"), F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("event_id"),
        F.col("c").alias("content"), F.lit("now").alias("occurred_at"),
    )
    return sessions.task_events(items).drop("project")


@reg.query("P25", f"""WITH {QA_SQL}, b AS (SELECT doc_id, 'see [' || doc_id * 1000 || '] and [' || (doc_id * 1000 + 1) || '] or [12] x [' || doc_id || ']' AS body FROM documents),
ref AS (SELECT id, strftime(ts, '%Y-%m-%d') AS d FROM qp WHERE id >= 100)
SELECT doc_id, 'see [' || doc_id * 1000 || coalesce(' @' || r0.d, '') || '] and [' || (doc_id * 1000 + 1) || coalesce(' @' || r1.d, '') || '] or [12] x [' || doc_id || coalesce(' @' || r2.d, '') || ']' AS body
FROM b LEFT JOIN ref r0 ON r0.id = doc_id * 1000 AND doc_id * 1000 BETWEEN 100 AND 9999999 LEFT JOIN ref r1 ON r1.id = doc_id * 1000 + 1 AND doc_id * 1000 + 1 BETWEEN 100 AND 9999999 LEFT JOIN ref r2 ON r2.id = doc_id AND doc_id BETWEEN 100 AND 9999999""")
def qa_timestamp_refs(t):
    k = F.col("doc_id") * 1000
    b = t.documents.select(
        "doc_id", F.concat(F.lit("see ["), k, F.lit("] and ["), k + 1, F.lit("] or [12] x ["), "doc_id", F.lit("]")).alias("body")
    )
    return topics.attach_timestamps(b, stored_pairs(t).select(F.col("id").alias("qa_id"), "ts"), "doc_id", "body")


PREMISE = {1: ("<!-- premise: a/b.md, c/d.md -->", ""), 2: ("text <!-- premise:  x ,, y --> ", "<!-- premise: later -->"), 3: ("<!-- contradiction: z.md -->", "")}


@reg.query("P26", f"WITH {planted_sql(PREMISE, 6)}, e AS (SELECT doc_id, regexp_extract(c, '<!-- (?:premise|contradiction):\\s*([^>]+)\\s*-->', 1) AS raw FROM d) SELECT doc_id, array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: {strip_sql('x')}), lambda x: x <> ''), '|') AS ids FROM e")
def premise_ids(t):
    return planted(t, PREMISE, 6).select("doc_id", F.array_join(topics.premise_ids(F.col("c")), "|").alias("ids"))


@reg.query("P27", f"""WITH {MSG_SQL}, m AS (SELECT session_id, ord, role, CASE WHEN ord % 8 = 4 THEN '结论 ' || content ELSE content END AS content FROM msg),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS rn FROM m),
s AS (SELECT session_id, ord, CASE WHEN role = 'user' AND length(content) > 50 THEN '[User]: ' || content[1:200] WHEN role = 'assistant' AND contains(content, '结论') THEN '[Assistant]: ' || content[1:200] END AS snip FROM r WHERE rn <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS k FROM s WHERE snip IS NOT NULL)
SELECT session_id, string_agg(snip, chr(10) || chr(10) ORDER BY ord) AS snippets FROM k WHERE k <= 5 GROUP BY session_id""")
def high_signal_snippets(t):
    m = messages(t).withColumn("content", F.when(F.col("ord") % 8 == 4, F.concat(F.lit("结论 "), "content")).otherwise(F.col("content")))
    return sessions.high_signal_snippets(m.select("session_id", "ord", "role", "content"))


@reg.query("P32", """WITH l AS (SELECT event_id, ts, date_trunc('second', ts) AS s, date_trunc('second', ts) + INTERVAL 1 HOUR AS e FROM events)
SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN s WHEN 1 THEN e WHEN 2 THEN ts ELSE s END, '%Y-%m-%d %H:%M:%S') AS started,
 strftime(CASE event_id % 4 WHEN 0 THEN e WHEN 1 THEN e WHEN 2 THEN ts ELSE s END, '%Y-%m-%d %H:%M:%S') AS ended FROM l""")
def note_event_times(t):
    sec = F.date_trunc("second", "ts")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("event_id") % 4
    link = F.struct(
        F.when(k == 2, "qa").when(k == 3, "source_event").otherwise("event_time").alias("kind"),
        F.when(k != 1, iso(sec)).alias("start"),
        F.when(k != 3, iso(sec + F.expr("INTERVAL 1 HOUR"))).alias("end"),
    )
    other = F.struct(F.lit("topics").alias("kind"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"))
    b = timefn.event_bounds(F.array(other, link), F.col("ts"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return t.events.select("event_id", b.alias("b")).select(
        "event_id", F.date_format("b.started", fmt).alias("started"), F.date_format("b.ended", fmt).alias("ended")
    )


NOTE = {
    1: ("## 关键决策\n- [用户] use spark 〔已实施〕\n- no marks\n* [建议] half\n## 进行中状态\n- doing 〔未完成 x〕\n- bare\n## Other\n- ignored\n", ""),
    2: ("## 进行中状态\n• one\n## 关键决策\n- [共同] x 〔计划中〕\n", ""),
}


@reg.query("P34", f"""WITH {planted_sql(NOTE, 5)}, x AS (SELECT doc_id, unnest(string_split(c, chr(10))) AS l0, generate_subscripts(string_split(c, chr(10)), 1) AS i FROM d),
y AS (SELECT doc_id, i, {strip_sql('l0')} AS l FROM x),
z AS (SELECT doc_id, l, last_value(CASE WHEN starts_with(l, '## ') THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS h FROM y),
b AS (SELECT doc_id, regexp_matches(l, '^[-*•]') AND coalesce(contains(h, '关键决策'), false) AS is_dec, regexp_matches(l, '^[-*•]') AND coalesce(contains(h, '进行中状态'), false) AS is_prg, regexp_matches(l, {q(R.ATTRIBUTION_MARK)}) AS has_at, regexp_matches(l, {q(R.STATUS_MARK)}) AS has_st FROM z)
SELECT doc_id, count(*) FILTER (WHERE is_dec) AS decisions, count(*) FILTER (WHERE is_dec AND NOT has_at) AS decisions_missing_attr, count(*) FILTER (WHERE is_dec AND NOT has_st) AS decisions_missing_status,
 count(*) FILTER (WHERE is_prg) AS progress, count(*) FILTER (WHERE is_prg AND NOT has_st) AS progress_missing_status FROM b GROUP BY doc_id""")
def note_marker_audit(t):
    return topics.audit_markers(planted(t, NOTE, 5), "doc_id", "c")


DIALOGUE = {1: ("Q: a\n", ""), 2: ("x\nAssistant: y ", ""), 3: ("FAQ: no ", ""), 4: ("x 用户: y", "")}


@reg.query("P35", f"WITH {planted_sql(DIALOGUE, 6)} SELECT doc_id, regexp_matches(c, {q(R.RAW_DIALOGUE)}) AS raw_dialogue FROM d")
def raw_dialogue_flags(t):
    return planted(t, DIALOGUE, 6).select("doc_id", C.has_raw_dialogue(F.col("c")).alias("raw_dialogue"))


@reg.query("F10", f"SELECT doc_id, {strip_sql("regexp_replace(text, '\\r?\\n', ' ', 'g')[1:120]")} AS preview FROM documents")
def previews(t):
    return t.documents.select("doc_id", C.preview(F.col("text"), 120).alias("preview"))
