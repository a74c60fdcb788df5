"""Registered queries: live streams over the given conversations, run until all input is used.

The conversations are written as event files in three parts, the earlier turns first, and read
as a stream; results are compared with the batch rule in SQL, so they must not depend on how
the files fall into micro-batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.catalog.base import EPOCH, Registry
from mnemolake.session import ensure_checkpoint_dir
from mnemolake.streaming import steps, triggers, turns

reg = Registry()

#: Files of one micro-batch.
FILES = 16


def _folder(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _stream(t, parts: list[DataFrame], folder: str) -> DataFrame:
    """A stream over ``parts``, which become visible one after the other."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
    return t.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")


def _finish(writer, folder: str) -> None:
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


KIND_SQL = "CASE WHEN turn % 11 = 7 THEN 'ASYNC_BOUNDARY' WHEN role = 'user' THEN 'REAL_USER' WHEN role = 'assistant' THEN 'NORMAL_ASSISTANT' ELSE 'NORMAL_TOOL' END"
BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def _events(t) -> DataFrame:
    turn = F.col("turn")
    kind = F.when(turn % 11 == 7, "ASYNC_BOUNDARY").when(F.col("role") == "user", "REAL_USER").when(
        F.col("role") == "assistant", "NORMAL_ASSISTANT"
    ).otherwise("NORMAL_TOOL")
    return t.conversations.select(
        F.lit("h").alias("host"), F.concat(F.lit("s"), "conv_id").alias("session_id"), turn.alias("ord"),
        F.concat_ws(":", "conv_id", "turn").alias("event_id"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("content"),
        F.lit(False).alias("machine"), (turn % 5 == 3).alias("has_tools"), F.timestamp_seconds(F.lit(EPOCH) + turn * 60).alias("ts"),
        F.lit(None).cast("string").alias("host_turn_id"),
    )


@reg.query("X1 X4 X9", f"""WITH e AS (SELECT conv_id, turn, {KIND_SQL} AS kind, coalesce(text, '') AS text, turn % 5 = 3 AS tools FROM conversations),
g AS (SELECT *, sum(CASE WHEN kind IN ('REAL_USER', 'ASYNC_BOUNDARY') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM e),
o AS (SELECT conv_id, g, kind, turn AS opener, trim(text, {BLANK}) AS question FROM g WHERE kind IN ('REAL_USER', 'ASYNC_BOUNDARY')),
a AS (SELECT conv_id, g, count(*) AS n, count(*) FILTER (WHERE tools) AS nt, string_agg(trim(text, {BLANK}), chr(10) || chr(10) ORDER BY turn) AS joined, string_agg(text, chr(10) ORDER BY turn) AS parts,
  arg_max(trim(text, {BLANK}), turn) AS last, arg_max(trim(text, {BLANK}), turn) FILTER (WHERE NOT tools) AS plain FROM g WHERE kind = 'NORMAL_ASSISTANT' AND trim(text, {BLANK}) <> '' GROUP BY 1, 2)
SELECT 's' || conv_id AS session_id, CASE WHEN n IS NULL THEN 'incomplete' ELSE 'qa' END AS output, conv_id || ':' || opener AS q_event_id, md5(question) AS question,
 md5(CASE WHEN n IS NULL THEN '' WHEN nt = 0 THEN joined ELSE coalesce(plain, last) END) AS answer FROM o LEFT JOIN a USING (conv_id, g) WHERE kind = 'REAL_USER'
UNION ALL SELECT 's' || conv_id, 'delivery', conv_id || ':' || opener, md5(''), md5(parts) FROM o JOIN a USING (conv_id, g) WHERE kind = 'ASYNC_BOUNDARY'
UNION ALL SELECT 's' || conv_id, 'held', '', md5(''), md5(text) FROM g WHERE g = 0 AND kind = 'NORMAL_ASSISTANT' AND trim(text, {BLANK}) <> ''""")
def live_pairs(t):
    """Every turn, delivery and held answer of a stream; turns that stay open are flushed by the idle timer."""
    folder = _folder(t, "turns")
    e = _events(t)
    # one event far behind the others moves the watermark past every idle timer
    end = e.agg((F.max("ts") + F.expr("interval 9 days")).alias("ts")).filter("ts is not null").select(
        F.lit("end").alias("host"), F.lit("end").alias("session_id"), F.lit(0).cast("long").alias("ord"), F.lit("end").alias("event_id"),
        F.lit("CONTROL").alias("kind"), F.lit("").alias("content"), F.lit(False).alias("machine"), F.lit(False).alias("has_tools"), "ts",
        F.lit(None).cast("string").alias("host_turn_id"),
    )
    stream = _stream(t, [e.filter("ord < 6"), e.filter("ord >= 6"), end], folder)
    out = turns.live_turns(stream, "1 day", idle_ms=86_400_000)
    _finish(out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), folder)
    got = t.spark.read.schema(out.schema).parquet(f"{folder}/out").filter("host <> 'end'")
    return got.select("session_id", "output", "q_event_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@reg.query("X2", f"""WITH e AS (SELECT conv_id, CASE WHEN turn % 9 = 4 THEN ' ' ELSE conv_id || ':' || turn END AS event_id, turn + 1000000 * k AS ord, text FROM conversations, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 2 OR turn % 3 = 0),
b AS (SELECT *, trim(event_id) = '' OR trim(coalesce(text, ''), {BLANK}) = '' AS bad FROM e)
SELECT conv_id AS conv, event_id, ord, CASE WHEN bad THEN 'rejected' WHEN row_number() OVER (PARTITION BY conv_id, event_id, bad ORDER BY ord) = 1 THEN 'accepted' ELSE 'duplicate' END AS receipt FROM b""")
def event_receipts(t):
    """One receipt for every event of a stream that delivers all events twice and a third of them three times."""
    folder = _folder(t, "receipts")
    turn = F.col("turn")
    e = t.conversations.select(
        F.lit("h").alias("host"), F.col("conv_id").cast("string").alias("session_id"), turn.alias("ord"),
        F.when(turn % 9 == 4, " ").otherwise(F.concat_ws(":", "conv_id", "turn")).alias("event_id"), F.col("text").alias("content"),
    )
    later = lambda k, rows: rows.withColumn("ord", F.col("ord") + 1_000_000 * k)
    stream = _stream(t, [e, later(1, e), later(2, e.filter("ord % 3 = 0"))], folder)
    _finish(stream.writeStream.foreachBatch(steps.receipt_step(f"{folder}/out")), folder)
    got = t.spark.read.schema("session_id string, event_id string, ord long, receipt string").parquet(f"{folder}/out")
    return got.select(F.col("session_id").cast("long").alias("conv"), "event_id", "ord", "receipt")


CHARS_AT, COUNT_AT, DEBOUNCE_MINUTES, IDLE_MINUTES = 2500, 5, 3, 240


@reg.query("X5", f"""WITH RECURSIVE p AS (SELECT 'h' || (conv_id % 97) AS host, turn + 1 AS m, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY m) AS k, lead(m) OVER (PARTITION BY host ORDER BY m) AS nx FROM p),
r AS (SELECT host, k, m, nx, n, chars, -1000000 AS free, CAST(NULL AS BIGINT) AS fired FROM w WHERE k = 1
 UNION ALL SELECT s.host, w.k, w.m, w.nx, w.n + CASE WHEN s.due IS NULL THEN s.n ELSE 0 END, w.chars + CASE WHEN s.due IS NULL THEN s.chars ELSE 0 END,
  coalesce(s.due + {DEBOUNCE_MINUTES}, s.free), s.due FROM (
   SELECT *, CASE WHEN (nx IS NULL OR d < nx) THEN d END AS due FROM (SELECT *, CASE WHEN chars >= {CHARS_AT} OR n >= {COUNT_AT} THEN greatest(m, free) ELSE greatest(m + {IDLE_MINUTES}, free) END AS d FROM r)) s JOIN w ON w.host = s.host AND w.k = s.k + 1),
f AS (SELECT *, CASE WHEN chars >= {CHARS_AT} THEN 'token' WHEN n >= {COUNT_AT} THEN 'count' ELSE 'pause' END AS reason, CASE WHEN chars >= {CHARS_AT} OR n >= {COUNT_AT} THEN greatest(m, free) ELSE greatest(m + {IDLE_MINUTES}, free) END AS d FROM r)
SELECT host, CAST(({EPOCH} + d * 60) * 1000 AS BIGINT) AS fired_ms, reason, CAST(n AS BIGINT) AS n, CAST(chars AS BIGINT) AS chars FROM f WHERE nx IS NULL OR d < nx""")
def live_trigger_firings(t):
    """Every firing of 97 backlogs by size, count or idleness; turn ``i`` of a conversation comes in minute ``i``."""
    folder = _folder(t, "triggers")
    rows = t.conversations.select(
        F.concat(F.lit("h"), (F.col("conv_id") % 97).cast("string")).alias("host"), F.col("conv_id").cast("string").alias("session_id"), "turn",
        F.timestamp_seconds(F.lit(EPOCH) + F.col("turn") * 60).alias("ts"), F.lit("").alias("question"), F.col("text").alias("answer"),
    )
    # one row far behind the others moves the watermark past every idle timer
    end = rows.agg((F.max("ts") + F.expr("interval 9 days")).alias("ts")).filter("ts is not null").select(
        F.lit("end").alias("host"), F.lit("end").alias("session_id"), "ts", F.lit("").alias("question"), F.lit("").alias("answer"),
    )
    stream = _stream(t, [rows.filter("turn < 6").drop("turn"), rows.filter("turn >= 6").drop("turn"), end], folder)
    out = triggers.live_triggers(
        stream, "1 day", chars_at=CHARS_AT, count_at=COUNT_AT, new_session_at=1 << 60, idle_hours=IDLE_MINUTES / 60, debounce_minutes=DEBOUNCE_MINUTES
    )
    _finish(out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), folder)
    got = t.spark.read.schema(triggers.OUTPUT).parquet(f"{folder}/out").filter("host <> 'end'")
    return got.drop("sessions")
