"""Registered queries: readers over exports that are written from the given tables first.

Each query writes the conversations in one export shape to the shared checkpoint
folder and reads them back through the reader, so that what is compared with SQL went
through the file format.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.catalog.base import Registry
from mnemolake.session import ensure_checkpoint_dir
from mnemolake.sources import readers

reg = Registry()

TALK_SQL = "role IN ('user', 'assistant')"
IDS = "conv_id::VARCHAR || ':' || turn::VARCHAR"


def _folder(t, shape: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/export-{shape}-{uuid.uuid4().hex}"


def _rows(t) -> DataFrame:
    """Conversations with text ids for sessions and events."""
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("sid"), "turn", "role", "text",
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("eid"),
    )


def _shown(table: DataFrame, *extra) -> DataFrame:
    return readers.kept(table).select("session_id", "event_id", "role", "content", *extra)


@reg.query("S1", f"SELECT conv_id::VARCHAR AS session_id, {IDS} AS event_id, role, trim(text) AS content FROM conversations WHERE {TALK_SQL} AND trim(text) <> ''")
def session_tree_import(t):
    rows = _rows(t)
    head = rows.select("sid").distinct().select(
        "sid", F.lit(-1).cast("long").alias("turn"), F.to_json(F.struct(F.lit("session").alias("type"), F.col("sid").alias("id"), F.lit(3).alias("version"))).alias("value")
    )
    body = rows.select("sid", "turn", F.to_json(F.struct(
        F.lit("message").alias("type"), F.col("eid").alias("id"), F.struct("role", F.col("text").alias("content")).alias("message")
    )).alias("value"))
    path = _folder(t, "tree")
    both = head.unionByName(body).repartition("sid").sortWithinPartitions("sid", "turn")
    both.select("value", F.col("sid").alias("session")).write.partitionBy("session").text(path)
    return _shown(readers.session_tree(t.spark, f"{path}/*"))


@reg.query("S3 J5", f"SELECT conv_id::VARCHAR AS session_id, role, text AS content, 'source' || (conv_id % 3)::VARCHAR AS session_source, conv_id * 1000 + turn AS ord FROM conversations WHERE {TALK_SQL} AND trim(text) <> ''")
def message_table_import(t):
    messages = _rows(t).filter(F.col("role").isin("user", "assistant")).select(
        F.col("sid").alias("Conversation_Id"), F.col("role").alias("Speaker"), F.col("text").alias("body"), (F.col("sid").cast("long") * 1000 + F.col("turn")).alias("id")
    )
    sessions = t.conversations.select(F.col("conv_id").alias("id"), F.concat(F.lit("source"), F.col("conv_id") % 3).alias("source")).distinct()
    return readers.kept(readers.message_table(messages, sessions)).select("session_id", "role", "content", "session_source", "ord")


@reg.query("S4", f"SELECT conv_id::VARCHAR AS session_id, {IDS} AS event_id, role, trim(text) AS content FROM conversations WHERE trim(text) <> ''")
def json_lines_import(t):
    path = _folder(t, "lines")
    _rows(t).select(F.to_json(F.struct(F.col("eid").alias("id"), "role", F.col("text").alias("content"), F.col("sid").alias("session_id")))).write.text(path)
    return _shown(readers.json_lines(t.spark, path))


@reg.query("S5", f"SELECT conv_id::VARCHAR AS session_id, role, trim(text) AS content FROM conversations WHERE {TALK_SQL} AND trim(text) <> ''")
def normalized_import(t):
    path = _folder(t, "normalized")
    rows = _rows(t).filter(F.col("role").isin("user", "assistant"))
    rows.select(F.to_json(F.struct(F.col("sid").alias("session_id"), F.col("text").alias("content"), "role"))).write.text(path)
    return readers.kept(readers.normalized_jsonl(t.spark, path)).select("session_id", "role", "content")


@reg.query("S7", f"SELECT conv_id::VARCHAR AS session_id, {IDS} AS event_id, role, trim(text) AS content FROM conversations WHERE {TALK_SQL} AND trim(text) <> ''")
def checkpoint_import(t):
    path = _folder(t, "checkpoint")
    rows = _rows(t).filter(F.col("role").isin("user", "assistant"))
    rows.select(F.to_json(F.struct(
        F.lit("message").alias("type"), F.col("sid").alias("sessionId"), F.col("eid").alias("id"), F.struct("role", F.col("text").alias("content")).alias("message")
    ))).write.text(path)
    return _shown(readers.checkpoint_messages(t.spark, path))


@reg.query("S8", f"SELECT conv_id::VARCHAR AS session_id, {IDS} AS event_id, text AS content, turn AS ord FROM conversations WHERE trim(text) <> ''")
def peer_csv_import(t):
    path = _folder(t, "csv")
    rows = _rows(t).select(
        F.col("eid").alias("id"), F.col("sid").alias("session_name"), F.lit("user").alias("peer_name"), F.col("text").alias("content"), F.col("turn").alias("seq_in_session")
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.kept(readers.peer_csv(t.spark, path)).select("session_id", "event_id", "content", "ord")


def _flat(text):
    """A text on one line, as line-based formats need it."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


FLAT_SQL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _write_by_session(t, shape: str, parts: list[tuple[int, DataFrame]]) -> str:
    """One file per session from (place, rows of sid, turn, value); places order head, body and foot."""
    path = _folder(t, shape)
    both = None
    for place, df in parts:
        own = df.select("sid", F.lit(place).alias("place"), "turn", "value")
        both = own if both is None else both.unionByName(own)
    ordered = both.repartition("sid").sortWithinPartitions("sid", "place", "turn")
    ordered.select("value", F.col("sid").alias("session")).write.partitionBy("session").text(path)
    return f"{path}/*"


def _once(rows: DataFrame, value) -> DataFrame:
    return rows.select("sid").distinct().select("sid", F.lit(0).cast("long").alias("turn"), value.alias("value"))


@reg.query("S2", f"SELECT conv_id::VARCHAR AS session_id, {IDS} AS event_id, role, trim(text) AS content FROM conversations WHERE {TALK_SQL} AND trim(text) <> ''")
def event_log_import(t):
    rows = _rows(t).filter(F.col("role").isin("user", "assistant"))
    head = _once(rows, F.to_json(F.struct(F.lit("session").alias("type"), F.col("sid").alias("id"), F.lit(4).alias("version"))))
    user = F.to_json(F.struct(
        F.lit("user/message").alias("type"), F.lit(1767225600000).alias("time"),
        F.struct(F.col("eid").alias("id"), F.struct(F.lit("user").alias("kind")).alias("source"), F.col("text").alias("content")).alias("data"),
    ))
    bot = F.to_json(F.struct(
        F.lit("assistant/message").alias("type"), F.lit(1767225600000).alias("time"),
        F.struct(F.struct(F.col("eid").alias("id"), F.col("text").alias("content")).alias("message")).alias("data"),
    ))
    body = rows.select("sid", "turn", F.when(F.col("role") == "user", user).otherwise(bot).alias("value"))
    return _shown(readers.event_log(t.spark, _write_by_session(t, "events", [(0, head), (1, body)])))


@reg.query("S6", f"SELECT conv_id::VARCHAR AS session_id, role, {FLAT_SQL} AS content FROM conversations WHERE {TALK_SQL} AND {FLAT_SQL} <> ''")
def trajectory_import(t):
    rows = _rows(t).filter(F.col("role").isin("user", "assistant"))
    head = _once(rows, F.to_json(F.struct(F.lit("session.started").alias("type"), F.struct(F.col("sid").alias("sessionKey")).alias("data"))))
    stamped = F.concat(F.lit("[Wed 2026-04-22 01:59 GMT+8] "), _flat(F.col("text")))
    user = F.to_json(F.struct(F.lit("prompt.submitted").alias("type"), F.struct(stamped.alias("prompt")).alias("data")))
    bot = F.to_json(F.struct(F.lit("model.completed").alias("type"), F.struct(F.array(_flat(F.col("text"))).alias("assistantTexts")).alias("data")))
    body = rows.select("sid", "turn", F.when(F.col("role") == "user", user).otherwise(bot).alias("value"))
    found = readers.trajectory(t.spark, _write_by_session(t, "trajectory", [(0, head), (1, body)]))
    return readers.kept(found).select("session_id", "role", "content")


@reg.query("S9", f"SELECT conv_id::VARCHAR AS session_id, {IDS} AS event_id, text AS content FROM conversations WHERE trim(text) <> ''")
def copy_dump_import(t):
    rows = _rows(t)
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    head = _once(rows, F.lit("COPY public.messages (id, content, peer_name, session_name, created_at) FROM stdin;"))
    body = rows.select("sid", "turn", F.concat_ws("\t", "eid", escaped, F.lit("owner"), "sid", F.lit("2026-01-01 00:00:00")).alias("value"))
    foot = _once(rows, F.lit("\\."))
    path = _write_by_session(t, "dump", [(0, head), (1, body), (2, foot)])
    return readers.kept(readers.copy_dump(t.spark, path)).select("session_id", "event_id", "content")


@reg.query("S10", f"SELECT role, {FLAT_SQL} AS content, count(*) AS n FROM conversations WHERE {TALK_SQL} AND {FLAT_SQL} <> '' GROUP BY 1, 2")
def chat_markdown_import(t):
    rows = _rows(t).filter(F.col("role").isin("user", "assistant"))
    head = _once(rows, F.lit("### 09:30"))
    date = _once(rows, F.lit("## 2026-01-05"))
    mark = F.when(F.col("role") == "user", "- \U0001f464 ").otherwise("- \U0001f916 ")
    body = rows.select("sid", "turn", F.concat(mark, _flat(F.col("text"))).alias("value"))
    found = readers.kept(readers.chat_markdown(t.spark, _write_by_session(t, "chat", [(0, date), (1, head), (2, body)])))
    return found.groupBy("role", "content").agg(F.count("*").alias("n"))


@reg.query("S20", "SELECT conv_id, turn, role, length(text) AS n_chars, (SELECT count(*) FROM conversations) AS results_rows FROM conversations")
def evaluation_files(t):
    from mnemolake.sources import sinks

    folder = _folder(t, "evaluation")
    results = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    latency = t.conversations.select("conv_id", F.col("turn").alias("ms"))
    sinks.write_evaluation(results, latency, folder, {"k": 1})
    rows = t.spark.read.json(f"{folder}/manifest").first()["results_rows"]  # the manifest is one row
    back = t.spark.read.schema("conv_id long, turn long, role string, n_chars long").json(f"{folder}/results")
    return back.withColumn("results_rows", F.lit(rows).cast("long"))


MARKER_NOW = "2024-06-01 00:00:00"


@reg.query("S16 A17", """SELECT item_id::VARCHAR AS job, CASE k WHEN 0 THEN 'recovered' WHEN 1 THEN 'poisoned' WHEN 2 THEN 'retryable' WHEN 3 THEN 'retry_due' WHEN 4 THEN 'pending' ELSE 'malformed' END AS status,
 CASE k WHEN 5 THEN 'json_error' WHEN 6 THEN 'not_object' WHEN 7 THEN 'missing_job_id' WHEN 8 THEN 'missing_pending' WHEN 9 THEN 'oversize' END AS malformed_reason,
 CASE WHEN k < 5 THEN 'q' || item_id::VARCHAR END AS question_id, CASE WHEN k < 4 THEN text END AS error_class, CASE WHEN k < 4 THEN 'v2' ELSE 'v1_legacy' END AS generation
FROM (SELECT *, item_id % 10 AS k FROM benchmark)""")
def failure_marker_scan(t):
    """One marker file per benchmark item, in ten kinds: five sound ones, four malformed, one too large to open."""
    b = t.benchmark.withColumn("k", F.col("item_id") % 10)
    job = F.col("item_id").cast("string")
    status = F.element_at(F.array(*[F.lit(x) for x in ("recovered", "poisoned", "failed", "failed")]), (F.col("k") + 1).cast("int"))
    retry = F.unix_timestamp(F.lit(MARKER_NOW)) + F.when(F.col("k") == 2, 60).otherwise(-60)
    sound = F.to_json(F.struct(
        job.alias("job_id"), F.struct(F.concat(F.lit("q"), job).alias("q_msg_id")).alias("pending"),
        F.when(F.col("k") < 4, status).alias("embedding_status"), F.when(F.col("k") == 4, 0).otherwise(2).alias("embedding_attempts"),
        F.when(F.col("k").isin(2, 3), retry).alias("embedding_next_retry_at"), F.when(F.col("k") < 4, F.col("text")).alias("error_class"),
    ))
    doc = (
        F.when(F.col("k") < 5, sound).when(F.col("k") == 5, F.lit("{bad")).when(F.col("k") == 6, F.lit("[1]")).when(F.col("k") == 7, F.lit('{"pending": {}}'))
        .when(F.col("k") == 8, F.to_json(F.struct(F.lit("j").alias("job_id")))).otherwise(F.repeat(F.lit("x"), 1 << 21))
    )
    path = _folder(t, "markers")
    b.select(doc.alias("value"), job.alias("job")).write.partitionBy("job").text(path)
    found = readers.failure_markers(t.spark, f"{path}/job=*/*.txt", F.lit(MARKER_NOW).cast("timestamp"))
    name = F.regexp_extract("artifact", "job=([^/]+)/", 1)
    return found.select(
        name.alias("job"), "status", "malformed_reason", F.when(F.col("malformed_reason").isNull(), F.col("question_id")).alias("question_id"), "error_class", "generation"
    )


def _with_suffix(t, folder: str, suffix: str) -> None:
    """Give the written files of ``folder`` another ending; only names change, on whatever store holds them."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    for status in store.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith("part-"):
            store.rename(status.getPath(), path(f"{folder}/{name.rsplit('.', 1)[0]}{suffix}"))


SHAPE_SQL = "CASE conv_id % 5 WHEN 0 THEN 'normalized_jsonl' WHEN 1 THEN 'message_events' WHEN 2 THEN 'chat_md' WHEN 3 THEN 'peer_csv' ELSE 'unknown' END"


@reg.query("S14", f"SELECT {SHAPE_SQL} AS shape, count(*) AS n_lines FROM conversations GROUP BY 1")
def shape_census(t):
    """Lines per detected shape over files of five shapes in one folder; header lines of tables do not count."""
    one_line = F.translate(F.coalesce("text", F.lit("")), "\r\n\u0085\u2028\u2029", "     ")
    rows = _rows(t).withColumns({"text": one_line, "k": F.col("sid").cast("long") % 5})
    shapes = (
        (0, ".jsonl", F.to_json(F.struct(F.col("sid").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("ts")))),
        (1, ".ndjson", F.to_json(F.struct(F.lit("message").alias("type"), F.col("eid").alias("id"), F.struct("role", F.col("text").alias("content")).alias("message")))),
        (2, ".md", F.concat(F.when(F.col("role") == "user", "- \U0001f464 ").otherwise("- \U0001f916 "), "text")),
        (4, ".log", F.col("text")),
    )
    path = _folder(t, "shapes")
    for k, suffix, value in shapes:
        rows.filter(F.col("k") == k).select(value.alias("value")).write.text(f"{path}/k{k}")
        _with_suffix(t, f"{path}/k{k}", suffix)
    rows.filter("k = 3").select("sid", F.col("role").alias("peer_name"), "text").write.option("header", True).csv(f"{path}/k3")
    found = readers.detect_shapes(t.spark, f"{path}/*/part-*")
    heads = F.when(F.col("shape") == "peer_csv", 1).otherwise(0)
    return found.groupBy("shape").agg(F.sum(F.col("n_lines") - heads).alias("n_lines"))
