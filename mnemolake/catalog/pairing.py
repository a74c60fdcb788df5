"""Registered queries: pairing, turns, deliveries, event kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.catalog.base import MSG_SQL, PAIR_SQL, Registry, messages, prefixes_sql, q, strip_sql
from mnemolake.functions import clean as C
from mnemolake.functions import ident as I
from mnemolake.operators import dedupe, pairing

reg = Registry()


@reg.query("A1 A2 W1 W2 I9 P1 P4 P5 P7 P8 P12", f"""WITH {PAIR_SQL}
SELECT session_id, turn_id, question, answer, q_event_id, occurred_at, 'qa_import/' || host || '/' || session_id || '/' || q_event_id AS source_id FROM qa""")
def qa_pairs(t):
    return pairing.qa_pairs(messages(t)).drop("host")


@reg.query("W1", f"WITH {PAIR_SQL} SELECT session_id, ord, role, CAST(turn_no AS BIGINT) AS turn_no FROM turned")
def turn_numbers(t):
    rows = pairing.collapse_repeats(pairing.pairable_rows(messages(t)))
    return pairing.turn_numbers(rows).select("session_id", "ord", "role", "turn_no")


@reg.query("W2", f"WITH {PAIR_SQL} SELECT session_id, ord, role FROM kept")
def repeat_collapse(t):
    return pairing.collapse_repeats(pairing.pairable_rows(messages(t))).select("session_id", "ord", "role")


@reg.query("A2", f"WITH {PAIR_SQL} SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, answer, nreal, ntool FROM answered WHERE nu > 0 AND na > 0 AND {strip_sql('answer')} <> ''")
def final_answers(t):
    turned = pairing.turn_numbers(pairing.collapse_repeats(pairing.pairable_rows(messages(t))))
    rows = turned.withColumns({
        "machine": C.is_machine_preamble(F.col("content")), "has_tools": pairing.has_tools(F.col("tool_calls")),
    })
    is_a = F.col("role") == "assistant"
    arr = F.array_sort(F.collect_list(F.when(is_a, F.struct("_ts", "ord", "content", "machine", "has_tools"))))
    g = rows.groupBy("session_id", "turn_no").agg(
        arr.alias("_a"), F.count_if(is_a & ~F.col("machine")).alias("nreal"),
        F.count_if(is_a & ~F.col("machine") & F.col("has_tools")).alias("ntool"),
        F.count_if(~is_a).alias("_u"),
    ).filter((F.col("_u") > 0) & (F.size("_a") > 0))
    return g.withColumn("answer", pairing.final_answer(F.col("_a"))).filter(C.strip(F.col("answer")) != "").drop("_a", "_u")


@reg.query("P12 P6", f"""WITH {MSG_SQL} SELECT session_id, count(*) AS skipped FROM msg
WHERE role IN ('user','assistant') AND lower(session_source) IN ({','.join(q(s) for s in R.MACHINE_SESSION_SOURCES)}) GROUP BY session_id""")
def machine_session_skips(t):
    return pairing.machine_session_skips(messages(t)).drop("host")


KIND_SQL = f"""CASE WHEN role IN ('tool','tool_call','tool_result','function') THEN 'NORMAL_TOOL'
  WHEN {prefixes_sql('head', R.TERMINAL_PREFIXES)} THEN 'TERMINAL'
  WHEN starts_with(head, {q(R.OOB_OPEN)}) THEN 'REAL_USER'
  WHEN {prefixes_sql('head', R.CONTINUATION_PREFIXES)} THEN 'CONTINUATION'
  WHEN {prefixes_sql('head', R.ASYNC_PREFIXES)} OR regexp_matches(head, {q(R.ASYNC_NUMBERED)}) THEN 'ASYNC_BOUNDARY'
  WHEN {prefixes_sql('head', R.NEW_ROOT_PREFIXES)} OR (lower(coalesce(session_source,'')) = 'cron' AND role = 'user') THEN 'NEW_ROOT'
  WHEN {prefixes_sql('head', R.CONTROL_PREFIXES)} THEN 'CONTROL'
  WHEN role = 'user' THEN 'REAL_USER' WHEN role = 'assistant' THEN 'NORMAL_ASSISTANT' ELSE 'CONTROL' END AS kind"""
# host rows: a boundary replaces some user rows
HOST_SQL = f"""{MSG_SQL},
host AS (SELECT * REPLACE (CASE WHEN (conv_id + turn) % 6 = 0 THEN '[ASYNC DELEGATION BATCH COMPLETE — deleg_00aa11] ' || text
   WHEN (conv_id + turn) % 10 = 5 THEN '[System: model switched] ' || text
   WHEN (conv_id + turn) % 23 = 0 THEN '[IMPORTANT: 12 background processes done] ' || text ELSE text END AS content)
  FROM (SELECT m.*, s.text FROM msg m JOIN src s USING (conv_id, turn, dup)) WHERE dup = 0),
kinds AS (SELECT * FROM (SELECT *, {KIND_SQL} FROM (SELECT *, ltrim(content) AS head FROM host)))"""


def host_rows(t):
    n = F.col("conv_id") + F.col("turn")
    m = messages(t).filter("dup = 0").join(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    text = F.col("text")
    return m.withColumn(
        "content",
        F.when(n % 6 == 0, F.concat(F.lit("[ASYNC DELEGATION BATCH COMPLETE — deleg_00aa11] "), text))
        .when(n % 10 == 5, F.concat(F.lit("[System: model switched] "), text))
        .when(n % 23 == 0, F.concat(F.lit("[IMPORTANT: 12 background processes done] "), text))
        .otherwise(text),
    ).withColumn("kind", C.host_event_kind(F.col("role"), F.col("content"), None, F.col("session_source")))


@reg.query("P9", f"WITH {HOST_SQL} SELECT kind, role, count(*) AS n FROM kinds GROUP BY kind, role")
def host_event_kinds(t):
    return host_rows(t).groupBy("kind", "role").agg(F.count("*").alias("n"))


@reg.query("A3 I7", f"""WITH {HOST_SQL},
g AS (SELECT *, sum(CASE WHEN kind IN ('ASYNC_BOUNDARY','NEW_ROOT','REAL_USER') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS grp FROM kinds)
SELECT session_id, trigger_event_id, trigger_kind, content, n_events,
  'delivery/test/' || session_id || '/' || replace(trigger_event_id, ':', '%3A') AS source_id FROM (
 SELECT session_id, grp, max(CASE WHEN kind IN ('ASYNC_BOUNDARY','NEW_ROOT') THEN eid END) AS trigger_event_id,
  max(CASE WHEN kind IN ('ASYNC_BOUNDARY','NEW_ROOT') THEN kind END) AS trigger_kind,
  string_agg(CASE WHEN kind = 'NORMAL_ASSISTANT' THEN content END, chr(10) ORDER BY ord) AS content,
  count(CASE WHEN kind = 'NORMAL_ASSISTANT' THEN 1 END) AS n_events
 FROM (SELECT *, conv_id || ':' || turn AS eid FROM g) WHERE grp > 0 GROUP BY session_id, grp)
WHERE trigger_event_id IS NOT NULL AND n_events > 0""")
def delivery_groups(t):
    rows = host_rows(t).withColumn("event_id", F.concat("conv_id", F.lit(":"), "turn"))
    return pairing.delivery_groups(rows).select(
        "session_id", "trigger_event_id", "trigger_kind", "content", F.size("event_ids").alias("n_events"), "source_id"
    )


@reg.query("W17", """WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT 's' || conv_id AS session_id, CAST((rn - 1) // 2 AS BIGINT) AS pair_no, arg_min(text, rn) AS first_text, arg_max(text, rn) AS second_text
FROM r GROUP BY conv_id, (rn - 1) // 2 HAVING count(*) = 2""")
def stride_pairs(t):
    m = t.conversations.select(
        F.lit("test").alias("host"), F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"),
        F.col("turn").alias("ord"), F.col("text").alias("content"),
    )
    return pairing.stride_pairs(m).drop("host")


@reg.query("S15", """WITH e AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'prompt' ELSE 'completion' END AS kind,
   CASE WHEN (conv_id + turn) % 7 = 1 THEN '' ELSE text END AS content FROM conversations),
l AS (SELECT *, lag(kind) OVER w AS pk, lag(content) OVER w AS pc FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT *, CASE WHEN pk = 'prompt' THEN pc END AS u FROM l WHERE kind = 'completion'),
k AS (SELECT * FROM d WHERE content <> '' OR (u IS NOT NULL AND u <> ''))
SELECT 's' || conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, u AS user_text,
 CASE WHEN u IS NOT NULL AND content = '' THEN '(tool call only)' ELSE content END AS assistant_text FROM k""")
def trajectory_turns(t):
    n = F.col("conv_id") + F.col("turn")
    e = t.conversations.select(
        F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"), F.col("turn").alias("ord"),
        F.when(n % 3 == 0, "prompt").otherwise("completion").alias("kind"),
        F.when(n % 7 == 1, "").otherwise(F.col("text")).alias("content"),
    )
    return pairing.trajectory_turns(e)


@reg.query("I10 I1", f"""WITH {MSG_SQL}, n AS (SELECT *, sum(CASE WHEN event_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY host, session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k FROM msg)
SELECT session_id, ord, coalesce(event_id, 'derived:' || host || ':' || session_id || ':' || CAST(k AS BIGINT)) AS event_id,
 CASE WHEN event_id IS NULL THEN 'derived' ELSE 'native' END AS identity_kind FROM n""")
def assigned_event_ids(t):
    return dedupe.assign_event_ids(messages(t)).select("session_id", "ord", "event_id", "identity_kind")
