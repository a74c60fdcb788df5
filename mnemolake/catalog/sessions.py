"""Registered queries: session signals, gap blocks, tasks, cursors, triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.catalog.base import MSG_SQL, PAIR_SQL, QA_SQL, Registry, messages, preamble_sql, stored_pairs
from mnemolake.operators import lineage, ordered, pairing, sessions

reg = Registry()

SIGNAL_SQL = f"""{PAIR_SQL}, sig AS (SELECT host, session_id, count(*) AS raw_n, count(*) FILTER (WHERE role = 'user') AS user_n, count(*) FILTER (WHERE role = 'assistant') AS assistant_n,
 count(*) FILTER (WHERE role = 'tool') AS tool_n, count(*) FILTER (WHERE role IN ('user','assistant') AND {preamble_sql('content')}) AS machine_n FROM msg GROUP BY ALL),
sg AS (SELECT sig.*, coalesce(q.qa_n, 0) AS qa_n FROM sig LEFT JOIN (SELECT host, session_id, count(*) AS qa_n FROM qa GROUP BY ALL) q USING (host, session_id)),
tr AS (SELECT *, CASE WHEN user_n > 0 AND qa_n > 0 THEN 'human_question_with_answer' WHEN qa_n > 0 THEN 'no_human_question_but_qa_exists' WHEN assistant_n > 0 AND raw_n > machine_n THEN 'no_qa_but_substantive_assistant_output' WHEN raw_n > 0 THEN 'machine_only' ELSE 'empty' END AS reason FROM sg)"""


def _tiers(t):
    m = messages(t)
    return sessions.session_tier(sessions.session_signals(m, pairing.qa_pairs(m)))


@reg.query("A4 J6", f"WITH {SIGNAL_SQL} SELECT session_id, raw_n, user_n, assistant_n, tool_n, machine_n, qa_n, reason FROM tr")
def session_signals(t):
    return _tiers(t).drop("host", "tier")


@reg.query("A4", f"""WITH {SIGNAL_SQL} SELECT CASE reason WHEN 'human_question_with_answer' THEN 'keep' WHEN 'no_human_question_but_qa_exists' THEN 'downgrade' WHEN 'no_qa_but_substantive_assistant_output' THEN 'raw_only' ELSE 'exclude' END AS tier, reason, count(*) AS sessions FROM tr GROUP BY 1, 2""")
def session_tiers(t):
    return sessions.tier_counts(_tiers(t))


BLOCK_SQL = """l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) > {gap}::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block_no FROM l),
k AS (SELECT user_id, CAST(block_no AS BIGINT) AS block_no, min(ts) AS s, max(ts) AS e, count(*) AS n_rows FROM b GROUP BY 1, 2 HAVING count(*) >= 3)"""
GAP = 14400


@reg.query("W7", f"WITH {BLOCK_SQL.format(gap=GAP)} SELECT user_id, block_no, n_rows, epoch_us(s) AS started, epoch_us(e) AS ended FROM k")
def gap_blocks(t):
    b = sessions.gap_blocks(t.events, "user_id", "ts", "event_id", GAP)
    return b.select("user_id", "block_no", "n_rows", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"))


@reg.query("W7 T8", f"WITH {BLOCK_SQL.format(gap=GAP)} SELECT user_id, block_no, n_rows FROM k ORDER BY e DESC, user_id, block_no LIMIT 30")
def recent_blocks(t):
    b = sessions.gap_blocks(t.events, "user_id", "ts", "event_id", GAP)
    return sessions.most_recent_blocks(b, "user_id", 30).select("user_id", "block_no", "n_rows")


@reg.query("X7", f"""WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) >= {GAP}::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bn FROM l)
SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM b GROUP BY user_id, bn""")
def session_windows(t):
    w = t.events.groupBy("user_id", F.session_window("ts", f"{GAP} seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros("w.start").alias("started"), "n")


TASK_SQL = """te AS (SELECT user_id AS task_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'requirement' ELSE 'progress' END AS et, ts, event_id, props FROM events),
ts1 AS (SELECT *, CASE et WHEN 'created' THEN 'open' WHEN 'requirement' THEN 'open' WHEN 'progress' THEN 'running' WHEN 'completed' THEN 'claimed_done' ELSE 'failed' END AS status FROM te),
st AS (SELECT task_id, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS last_event, arg_min(CASE WHEN et IN ('created','requirement') THEN props END, CASE WHEN et IN ('created','requirement') THEN (ts, event_id) END) AS goal, count(*) AS n_events FROM ts1 GROUP BY task_id)"""


def _task_events(t):
    kind = (
        F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "requirement").otherwise("progress")
    )
    e = t.events.select(
        F.col("user_id").alias("task_id"), kind.alias("event_type"), F.col("props").alias("summary"), F.col("ts").alias("occurred_at"), "event_id"
    )
    return e.withColumn("status", sessions.status_of(F.col("event_type")))


@reg.query("W5", f"WITH {TASK_SQL} SELECT task_id, status, last_event, goal, n_events FROM st")
def task_state(t):
    return sessions.task_state(_task_events(t)).drop("last_at")


@reg.query("W5", f"WITH {TASK_SQL} SELECT task_id, status FROM st WHERE status NOT IN ('verified_done','claimed_done')")
def open_tasks(t):
    return sessions.open_tasks(sessions.task_state(_task_events(t))).select("task_id", "status")


LIVE_SQL = f"{QA_SQL}, lv AS (SELECT session_id, count(*) AS unobs_count, CAST(sum(length(question) + length(coalesce(answer, ''))) AS BIGINT) AS unobs_chars, max(ts) AS last_ts FROM qp WHERE id > 20000 AND answer IS NOT NULL AND session_id NOT LIKE '%.trajectory%' GROUP BY session_id)"


@reg.query("A14", f"WITH {LIVE_SQL} SELECT session_id, unobs_count, unobs_chars, epoch_us(last_ts) AS last_ts FROM lv")
def unobserved_backlog(t):
    b = sessions.unobserved(stored_pairs(t), 20000)
    return b.select("session_id", "unobs_count", "unobs_chars", F.unix_micros("last_qa_ts").alias("last_ts"))


@reg.query("X5 A14", f"""WITH {LIVE_SQL}, x AS (SELECT sum(unobs_chars) AS c, sum(unobs_count) AS n, max(last_ts) AS l, max(CASE WHEN session_id NOT IN ('s25','s26') THEN unobs_chars END) AS nw, count(*) FILTER (WHERE session_id NOT IN ('s25','s26')) AS ns FROM lv)
SELECT CAST(c AS BIGINT) AS unobs_chars, CAST(n AS BIGINT) AS unobs_count, ns AS new_sessions, CASE WHEN c >= 50000 THEN 'token' WHEN n >= 100 THEN 'count' WHEN nw >= 1000 THEN 'new_session' WHEN epoch(TIMESTAMP '2024-06-01') - epoch(l) >= 4 * 3600 AND n > 0 THEN 'pause' END AS reason FROM x""")
def trigger_decision(t):
    backlog = sessions.unobserved(stored_pairs(t), 20000)
    known = backlog.filter(F.col("session_id").isin("s25", "s26")).select("session_id")
    now, last = F.lit("2024-06-01 00:00:00").cast("timestamp"), F.lit("2024-05-31 00:00:00").cast("timestamp")
    return sessions.trigger_decision(backlog, known, now, last, new_session_at=1000).drop("last_qa_ts", "trigger")


@reg.query("T10 X6", f"WITH {QA_SQL} SELECT id, question FROM qp WHERE id > 15000 ORDER BY id LIMIT 25")
def tail_after_cursor(t):
    return sessions.after_cursor(stored_pairs(t), 15000, 25).select("id", "question")


@reg.query("X6", f"WITH {QA_SQL}, b AS (SELECT id FROM qp WHERE id > 15000 ORDER BY id LIMIT 25) SELECT min(id) AS range_lo, max(id) AS range_hi, count(*) AS n FROM b")
def batch_range_bounds(t):
    return sessions.batch_bounds(sessions.after_cursor(stored_pairs(t), 15000, 25))


@reg.query("W9", """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN NULL ELSE length(text) % 2 END AS topic FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m)
SELECT conv_id AS session_id, count(topic) = 2 AND count(DISTINCT topic) = 1 AS stable FROM r WHERE rn <= 2 GROUP BY conv_id""")
def stable_matches(t):
    m = t.conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 7 != 0, F.length("text") % 2).alias("topic")
    )
    return sessions.stable_match(m).select("session_id", "stable")


@reg.query("W16", """WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) % 2 END AS block FROM conversations)
SELECT conv_id AS session_id, turn AS seq, block IS DISTINCT FROM lag(block) OVER (PARTITION BY conv_id ORDER BY turn) AS inject FROM b""")
def changed_blocks(t):
    b = t.conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 != 4, F.length("text") % 2).alias("block")
    )
    return sessions.changed_blocks(b).drop("block")


@reg.query("X10", """WITH r AS (SELECT event_id, round(value, 2) AS cost, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE event_id > 99),
b AS (SELECT CAST((rn - 1) // 50 AS BIGINT) AS batch_no, min(event_id) AS first_id, max(event_id) AS last_id, sum(cost) AS cost FROM r GROUP BY 1),
s AS (SELECT *, sum(cost) OVER (ORDER BY batch_no ROWS UNBOUNDED PRECEDING) - cost AS before FROM b)
SELECT batch_no, first_id, last_id, round(cost, 4) AS cost, round(before, 4) AS spent_before, round(before, 6) < 20000 AS runs FROM s""")
def bounded_rebuild(t):
    r = t.events.select(F.col("event_id").alias("id"), F.round("value", 2).alias("cost"))
    return sessions.bounded_rebuild(r, 50, 20000, cursor=99).withColumns({
        "cost": F.round("cost", 4), "spent_before": F.round("spent_before", 4)
    })


@reg.query("J34", """WITH m AS (SELECT conv_id * 1000 + turn AS id, 's' || conv_id AS session_id, md5(text) AS h FROM conversations),
r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 's' || doc_id END AS ref FROM documents)
SELECT ref, id, session_id, h FROM r JOIN m ON ref = CAST(id AS VARCHAR) UNION ALL
SELECT ref, max(id), session_id, arg_max(h, id) FROM r JOIN m ON ref = session_id GROUP BY ref, session_id""")
def message_context(t):
    m = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), F.col("text").alias("content")
    )
    r = t.documents.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("s"), "doc_id")).alias("ref"))
    return lineage.resolve_context(r, m).select("ref", "id", "session_id", F.md5("content").alias("h"))
