"""Readers: every export shape becomes one table of items.

Item columns: host, session_id, ord, event_id, identity_kind, role, content,
occurred_at, session_source, tool_calls, artifact, skip_reason. Skipped rows stay
in the table with their reason, so counting them is a group-by; ``kept`` drops
them. Line order inside a file comes from the split offset and the read order,
and line numbers are dense per file even when a file is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.functions import clean as C
from mnemolake.functions import ident as I
from mnemolake.functions import timefn
from mnemolake.operators import ordered
from mnemolake.sources import markdown

BLOCKS = "array<struct<type:string,text:string>>"
ITEM_COLUMNS = (
    "host", "session_id", "ord", "event_id", "identity_kind", "role", "content", "occurred_at",
    "session_source", "tool_calls", "artifact", "skip_reason",
)

# fixed values: logical column -> accepted names, first present wins
MESSAGE_COLUMNS = {
    "role": ("role", "speaker", "from"),
    "content": ("content", "text", "message", "body"),
    "timestamp": ("timestamp", "created_at", "ts", "created"),
    "session_id": ("session_id", "conversation_id", "conv_id", "thread_id"),
    "id": ("id", "rowid", "message_id"),
    "tool_calls": ("tool_calls", "tool_call", "toolcall_json"),
    "tool_results": ("tool_results", "tool_result"),
    "display_kind": ("display_kind",),
    "message_uid": ("message_uid", "uid"),
}
ENVELOPE_KEYS = ("messages", "records", "items", "data")
COPY_COLUMNS = (
    "id", "public_id", "content", "metadata", "created_at", "peer_name", "workspace_name",
    "session_name", "token_count", "internal_metadata", "seq_in_session",
)
CHECKPOINT_SUFFIX = r"(?i)\.checkpoint\.[0-9a-f]{8}-?[0-9a-f-]*$"
STAMPED_LINE = r"\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) \d{4}-\d{2}-\d{2} \d{2}:\d{2} GMT[+-]\d+\] ([^\n]+)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, line_no from 1, value) of text files, compressed ones included."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("artifact"), F.col("_metadata.file_block_start").alias("_slice"),
        F.monotonically_increasing_id().alias("_pos"), "value",
    )
    hot = ordered.is_hot(raw, ["artifact"])
    return ordered.row_number(raw, ["artifact"], "_slice", ["_slice", "_pos"], "line_no", hot).drop("_slice", "_pos")


def stem(artifact: Column) -> Column:
    return F.regexp_replace(F.substring_index(artifact, "/", -1), r"\.[^.]*$", "")


def items(df: DataFrame, **cols: Column) -> DataFrame:
    """Project to the item columns; the ones not given are null."""
    defaults = {c: F.lit(None).cast("string") for c in ITEM_COLUMNS}
    return df.select(*[cols.get(c, defaults[c]).alias(c) for c in ITEM_COLUMNS])


def kept(table: DataFrame) -> DataFrame:
    return table.filter(F.col("skip_reason").isNull()).drop("skip_reason")


def skips(table: DataFrame) -> DataFrame:
    """Dropped rows per reason."""
    return table.filter(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("n"))


def _identity(native: Column) -> Column:
    return F.when(C.strip(F.coalesce(native, F.lit(""))) != "", "native").otherwise("derived")


def _blocks_or_text(line: Column, path: str, kinds=("text",), sep="\n\n", trim_each=True) -> Column:
    """Text of a field that is a string or a list of typed blocks."""
    raw = F.get_json_object(line, f"$.{path}")
    is_list = F.get_json_object(line, f"$.{path}[0]").isNotNull() | (raw == "[]")
    return F.when(is_list, C.join_text_blocks(F.from_json(raw, BLOCKS), kinds, sep, trim_each)).otherwise(C.strip(raw))


def _with_header(rows: DataFrame, versions: tuple[int, ...]) -> DataFrame:
    """Attach the file's session header (first ``type=session`` line) to the lines after it."""
    j = lambda p: F.get_json_object("value", f"$.{p}")
    x = rows.filter(C.strip(F.col("value")) != "").withColumn("type", j("type"))
    head = x.filter("type = 'session'").groupBy("artifact").agg(
        F.min_by(F.struct(j("id").alias("sid"), j("version").alias("ver"), j("cwd").alias("cwd")), F.col("line_no")).alias("h"),
        F.min("line_no").alias("_hl"),
    )
    return x.join(head, "artifact").filter((F.col("line_no") > F.col("_hl")) & (F.coalesce("h.sid", F.lit("")) != "")).withColumn(
        "_bad_version", F.coalesce(~F.col("h.ver").cast("int").isin(*versions), F.lit(False))
    )


def session_tree(spark: SparkSession, path: str, host: str = "tree") -> DataFrame:
    """Session JSONL whose first line is a header; message entries of users and assistants."""
    x = _with_header(lines(spark, path), (1, 2, 3))
    j = lambda p: F.get_json_object("value", f"$.{p}")
    x = x.withColumns({"role": j("message.role"), "text": _blocks_or_text(F.col("value"), "message.content"), "eid": j("id")})
    reason = (
        F.when(F.col("_bad_version"), "skipped_version")
        .when(F.col("type").isNull(), "malformed")
        .when((F.col("type") != "message") | j("message").isNull(), "skipped_entries")
        .when(F.col("role") == "custom", "skipped_injected")
        .when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "skipped_roles")
        .when(F.coalesce("text", F.lit("")) == "", "skipped_empty")
    )
    return items(
        x, host=F.lit(host), session_id=F.col("h.sid"), ord=F.col("line_no"), event_id=F.col("eid"), identity_kind=_identity(F.col("eid")),
        role=F.col("role"), content=F.col("text"), occurred_at=timefn.to_iso(j("timestamp")), artifact=F.col("artifact"), skip_reason=reason,
    )


def event_log(spark: SparkSession, path: str, host: str = "events") -> DataFrame:
    """Compressed event JSONL; real user messages and assistant messages that were not cut off."""
    x = _with_header(lines(spark, path), (3, 4))
    j = lambda p: F.get_json_object("value", f"$.{p}")
    is_user = F.col("type") == "user/message"
    is_bot = F.col("type") == "assistant/message"
    x = x.withColumns({
        "text": F.when(is_user, _blocks_or_text(F.col("value"), "data.content")).when(is_bot, _blocks_or_text(F.col("value"), "data.message.content")),
        "eid": F.when(is_user, j("data.id")).when(is_bot, j("data.message.id")),
    })
    reason = (
        F.when(F.col("_bad_version"), "skipped_version")
        .when(F.col("type").isNull(), "malformed")
        .when(~(is_user | is_bot), "skipped_entries")
        .when(is_user & (F.coalesce(j("data.source.kind"), F.lit("")) != "user"), "skipped_injected")
        .when(is_bot & (F.coalesce(j("data.interrupted"), F.lit("")) == "true"), "skipped_interrupted")
        .when(F.coalesce("text", F.lit("")) == "", "skipped_empty")
    )
    return items(
        x, host=F.lit(host), session_id=F.col("h.sid"), ord=F.col("line_no"), event_id=F.col("eid"), identity_kind=_identity(F.col("eid")),
        role=F.when(is_user, "user").when(is_bot, "assistant"), content=F.col("text"), occurred_at=timefn.to_iso(j("time")),
        artifact=F.col("artifact"), skip_reason=reason,
    )


def map_columns(columns, candidates=MESSAGE_COLUMNS) -> dict[str, str]:
    """S3: logical name -> the first accepted column that is present, any case."""
    present = {c.lower(): c for c in columns}
    return {k: next(present[o] for o in opts if o in present) for k, opts in candidates.items() if any(o in present for o in opts)}


def message_table(messages: DataFrame, sessions: DataFrame | None = None, host: str = "table", artifact: str = "table") -> DataFrame:
    """A message table of unknown column names, with session metadata when there is some."""
    m = map_columns(messages.columns)
    col = lambda k: F.col(m[k]).cast("string") if k in m else F.lit(None).cast("string")
    x = messages.select(
        F.coalesce(col("role"), F.lit("assistant")).alias("role"), col("content").alias("content"), col("timestamp").alias("ts"),
        F.coalesce(F.when(col("session_id") != "", col("session_id")), F.lit(f"ungrouped:{artifact}")).alias("session_id"), col("id").alias("raw_id"),
        col("tool_calls").alias("tool_calls"), col("display_kind").alias("display_kind"), col("message_uid").alias("uid"),
        F.monotonically_increasing_id().alias("_row"),  # the place in the table, where ids are no numbers
    )
    if sessions is not None:
        meta = sessions.groupBy(F.col("id").cast("string").alias("session_id")).agg(F.max("source").alias("session_source"))
        x = x.join(meta, "session_id", "left")
    else:
        x = x.withColumn("session_source", F.lit(None).cast("string"))
    x = x.withColumn("occurred_at", timefn.to_iso(F.col("ts")))
    eid = I.uid_or_hash_event_id(F.col("uid"), F.col("session_id"), F.col("role"), F.col("occurred_at"), F.col("content"))
    return items(
        x, host=F.lit(host), session_id=F.col("session_id"), ord=F.coalesce(F.col("raw_id").try_cast("bigint"), F.col("_row")),
        event_id=eid, identity_kind=F.when(C.none_if_blank(F.col("uid")).isNotNull(), "native").otherwise("content-hash"),
        role=F.col("role"), content=F.col("content"), occurred_at=F.col("occurred_at"), session_source=F.col("session_source"),
        tool_calls=F.col("tool_calls"), artifact=F.lit(artifact),
        skip_reason=C.import_skip_reason(F.col("role"), F.col("content"), F.col("display_kind")),
    )


def _from_object(x: DataFrame, host: str) -> DataFrame:
    """Items from rows (artifact, line_no, value) whose value is one JSON object."""
    j = lambda *names: F.coalesce(*[F.when(F.get_json_object("value", f"$.{n}") != "", F.get_json_object("value", f"$.{n}")) for n in names])
    file_name = F.substring_index("artifact", "/", -1)
    text = j("content", "text", "message", "body")
    is_object = F.from_json("value", "map<string,string>").isNotNull()
    eid = j("id")
    return items(
        x, host=F.lit(host), session_id=F.coalesce(j("session_id", "conversation_id", "conv_id", "thread_id"), F.concat(F.lit("ungrouped:"), file_name)),
        ord=F.col("line_no"), event_id=eid, identity_kind=_identity(eid), role=F.coalesce(j("role", "speaker", "from"), F.lit("assistant")),
        content=text, occurred_at=timefn.to_iso(j("timestamp", "created_at", "ts", "created")), tool_calls=j("tool_calls", "tool_call"),
        artifact=F.col("artifact"),
        skip_reason=F.when(~is_object, "malformed").when(C.strip(F.coalesce(text, F.lit(""))) == "", "skipped_empty"),
    )


def json_lines(spark: SparkSession, path: str, host: str = "export") -> DataFrame:
    """One object per line; bad lines are counted, not fatal."""
    return _from_object(lines(spark, path).filter(C.strip(F.col("value")) != ""), host)


def json_document(spark: SparkSession, path: str, host: str = "export") -> DataFrame:
    """One JSON document per file: a list, an envelope holding a list, or one object."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("artifact"), C.strip(F.col("value")).alias("doc"))
    inner = F.coalesce(*[F.when(F.get_json_object("doc", f"$.{k}").startswith("["), F.get_json_object("doc", f"$.{k}")) for k in ENVELOPE_KEYS])
    listed = F.when(F.col("doc").startswith("["), F.col("doc")).when(inner.isNotNull(), inner)
    values = F.when(listed.isNotNull(), F.from_json(listed, "array<string>")).otherwise(F.array("doc"))
    x = doc.select("artifact", F.posexplode(values).alias("pos", "value")).withColumn("line_no", (F.col("pos") + 1).cast("long"))
    return _from_object(x, host)


def peer_role(peer: Column) -> Column:
    """Who a named peer is: fixed names and prefixes."""
    p = F.lower(C.strip(F.coalesce(peer, F.lit(""))))
    return (
        F.when(p.isin("owner", "user", "human", "test-peer") | p.startswith("ou_") | p.startswith("fire"), "user")
        .when(p.startswith("agent") | p.startswith("assistant") | p.startswith("bot"), "assistant")
        .otherwise("other")
    )


def normalized_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Normalised rows; an ``other`` role is repaired from the peer name."""
    x = lines(spark, path).filter(C.strip(F.col("value")) != "")
    j = lambda p: F.get_json_object("value", f"$.{p}")
    role = F.coalesce(C.none_if_blank(C.strip(j("role"))), F.lit("other"))
    x = x.withColumn("role", F.when((role == "other") & (F.coalesce(j("peer"), F.lit("")) != ""), peer_role(j("peer"))).otherwise(role))
    reason = F.when(j("session_id").isNull() | j("content").isNull(), "malformed").otherwise(C.noise_reason(F.col("role"), j("content")))
    return items(
        x, host=F.coalesce(C.none_if_blank(j("host")), C.none_if_blank(j("source")), F.lit("legacy")), session_id=j("session_id"), ord=F.col("line_no"),
        event_id=j("event_id"), identity_kind=_identity(j("event_id")), role=F.col("role"), content=j("content"),
        occurred_at=timefn.iso_utc(timefn.parse_ts(F.coalesce(j("ts"), j("timestamp")))), artifact=F.col("artifact"), skip_reason=reason,
    )


def trajectory(spark: SparkSession, path: str, host: str = "trajectory") -> DataFrame:
    """Event stream; the session key is carried forward, a cron session ends its file,
    stamped user lines come out of the prompt, assistant texts are exploded.
    """
    x = lines(spark, path).filter(C.strip(F.col("value")) != "")
    j = lambda p: F.get_json_object("value", f"$.{p}")
    kind = F.coalesce(j("type"), j("event"))
    key = F.when(kind == "session.started", F.coalesce(j("data.sessionKey"), j("data.sessionId"), F.lit("")))
    x = x.withColumns({"kind": kind, "_key": key, "_slice": ordered.slice_of("line_no")})
    stop = x.filter(F.col("_key").contains(":cron:")).groupBy("artifact").agg(F.min("line_no").alias("_stop"))
    x = ordered.carry_forward(x, ["artifact"], "_slice", ["line_no"], F.col("_key"), "_sess", ordered.is_hot(x, ["artifact"]))
    x = x.join(stop, "artifact", "left").filter(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
    x = x.withColumn("session_id", F.coalesce(C.none_if_blank(F.col("_sess")), stem(F.col("artifact")))).withColumn(
        "ts", timefn.parse_ts(F.coalesce(j("ts"), j("timestamp"), j("data.ts")))
    )
    prompt = F.coalesce(j("data.prompt"), j("data.text"), F.lit(""))
    said = F.regexp_extract_all(prompt, F.lit(STAMPED_LINE), 1)
    users = x.filter("kind = 'prompt.submitted'").select("artifact", "line_no", "session_id", "ts", F.posexplode(said).alias("idx", "content")).withColumn("role", F.lit("user"))
    texts = j("data.assistantTexts")
    replies = F.when(texts.startswith("["), F.from_json(texts, "array<string>")).otherwise(F.array(texts))
    bots = x.filter("kind = 'model.completed'").select("artifact", "line_no", "session_id", "ts", F.posexplode(replies).alias("idx", "content")).withColumn("role", F.lit("assistant"))
    both = users.withColumn("_i", F.lit(0)).unionByName(bots.withColumn("_i", F.col("idx"))).withColumn("content", C.strip(F.coalesce("content", F.lit(""))))
    return items(
        both, host=F.lit(host), session_id=F.col("session_id"), ord=F.col("line_no") * 1000 + F.col("idx"),
        event_id=I.snapshot_event_id(F.col("session_id"), F.col("ts"), F.col("content"), F.col("_i")), identity_kind=F.lit("content-hash"),
        role=F.col("role"), content=F.col("content"), occurred_at=timefn.iso_utc(F.col("ts")), artifact=F.col("artifact"),
        skip_reason=C.noise_reason(F.col("role"), F.col("content")),
    )


def checkpoint_messages(spark: SparkSession, path: str, host: str = "snapshots") -> DataFrame:
    """Message events of repeated backups; the checkpoint suffix is no part of the session."""
    x = lines(spark, path).filter(C.strip(F.col("value")) != "")
    j = lambda p: F.get_json_object("value", f"$.{p}")
    nested = j("message").isNotNull() & j("message").startswith("{")
    pick = lambda p: F.when(nested, j(f"message.{p}")).otherwise(j(p))
    text = F.when(nested, _blocks_or_text(F.col("value"), "message.content", ("text", "output_text"), "\n", False)).otherwise(
        _blocks_or_text(F.col("value"), "content", ("text", "output_text"), "\n", False)
    )
    x = x.withColumns({
        "type": j("type"), "role": F.lower(C.strip(F.coalesce(pick("role"), F.lit("")))), "text": C.strip(F.coalesce(text, F.lit(""))),
        "ts": timefn.parse_ts(F.coalesce(j("timestamp"), pick("timestamp"), j("ts"))),
        "session_id": F.regexp_replace(F.coalesce(j("sessionId"), pick("sessionId"), stem(F.col("artifact"))), CHECKPOINT_SUFFIX, ""),
    })
    x = x.withColumn(
        "reason",
        F.when(F.col("type").isNull(), "malformed").when(F.col("type") != "message", "skipped_entries")
        .when(F.col("text") == "", "empty").otherwise(C.noise_reason(F.col("role"), F.col("text"))),
    )
    # the position among the kept messages of a file is part of the derived id
    x = x.withColumn("_slice", ordered.slice_of("line_no"))
    x = ordered.running_sum(
        x, ["artifact"], "_slice", ["line_no"], F.when(F.col("reason").isNull(), 1).otherwise(0).cast("long"), "_idx", ordered.is_hot(x, ["artifact"])
    )
    native = F.coalesce(F.when(nested, j("message.id")), j("id"))
    return items(
        x, host=F.lit(host), session_id=F.col("session_id"), ord=F.col("line_no"),
        event_id=F.coalesce(native, I.snapshot_event_id(F.col("session_id"), F.col("ts"), F.col("text"), F.col("_idx"))),
        identity_kind=_identity(native), role=F.when(F.col("role") == "", "other").otherwise(F.col("role")), content=F.col("text"),
        occurred_at=timefn.iso_utc(F.col("ts")), artifact=F.col("artifact"), skip_reason=F.col("reason"),
    )


def peer_csv(spark: SparkSession, path: str, host: str = "peers") -> DataFrame:
    """CSV export with a peer name per row."""
    x = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    x = x.withColumn("_row", F.monotonically_increasing_id())
    have = lambda *names: F.coalesce(*[F.col(n) for n in names if n in x.columns], F.lit(None).cast("string"))
    role = peer_role(have("peer_name"))
    text = F.coalesce(have("content"), F.lit(""))
    return items(
        x, host=F.lit(host), session_id=F.coalesce(have("session_name"), have("session_id"), F.lit(host)),
        ord=F.coalesce(have("seq_in_session").try_cast("bigint"), F.col("_row")), event_id=have("id", "public_id"),
        identity_kind=_identity(have("id", "public_id")), role=role, content=text,
        occurred_at=timefn.iso_utc(timefn.parse_ts(have("created_at", "timestamp"))), artifact=F.lit(path), skip_reason=C.noise_reason(role, text),
    )


def copy_dump(spark: SparkSession, path: str, host: str = "peers") -> DataFrame:
    """The ``COPY public.messages … FROM stdin`` block of a text dump."""
    x = lines(spark, path)
    head = x.filter(F.col("value").startswith("COPY public.messages")).groupBy("artifact").agg(
        F.min("line_no").alias("_h"), F.min_by("value", "line_no").alias("_hv")
    )
    x = x.join(head, "artifact").filter(F.col("line_no") > F.col("_h"))
    end = x.filter(F.col("value") == "\\.").groupBy("artifact").agg(F.min("line_no").alias("_e"))
    x = x.join(end, "artifact", "left").filter(F.col("_e").isNull() | (F.col("line_no") < F.col("_e")))
    named = F.regexp_extract("_hv", r"\((.*?)\)\s+FROM stdin", 1)
    header = F.when(named != "", F.transform(F.split(named, ","), lambda c: F.btrim(c, F.lit(' "')))).otherwise(F.array(*[F.lit(c) for c in COPY_COLUMNS]))
    x = x.withColumns({"_c": header, "_p": F.split("value", "\t")}).filter(F.size("_p") >= F.size("_c"))
    x = x.withColumn("_r", F.map_from_arrays("_c", F.slice("_p", F.lit(1), F.size("_c"))))
    value = lambda k: F.when(F.try_element_at("_r", F.lit(k)) != "\\N", F.try_element_at("_r", F.lit(k)))
    text = F.coalesce(value("content"), F.lit(""))
    text = F.replace(F.replace(F.replace(text, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    role = peer_role(value("peer_name"))
    eid = F.coalesce(value("id"), value("public_id"))
    return items(
        x, host=F.lit(host), session_id=F.coalesce(value("session_name"), F.lit(host)), ord=F.col("line_no"), event_id=eid, identity_kind=_identity(eid),
        role=role, content=text, occurred_at=timefn.iso_utc(timefn.parse_ts(value("created_at"))), artifact=F.col("artifact"),
        skip_reason=C.noise_reason(role, text),
    )


def chat_markdown(spark: SparkSession, path: str, host: str = "chat_md") -> DataFrame:
    """User / assistant bullets under date and clock headings."""
    b = markdown.chat_bullets(lines(spark, path), ["artifact"]).withColumn("reason", C.noise_reason(F.col("role"), F.col("content")))
    b = b.withColumn("_slice", ordered.slice_of("line_no"))
    b = ordered.running_sum(
        b, ["artifact"], "_slice", ["line_no"], F.when(F.col("reason").isNull(), 1).otherwise(0).cast("long"), "_i", ordered.is_hot(b, ["artifact"])
    )
    name = stem(F.col("artifact"))
    return items(
        b, host=F.lit(host), session_id=name, ord=F.col("line_no"), event_id=F.concat(name, F.lit(":"), F.col("_i").cast("string")),
        identity_kind=F.lit("derived"), role=F.col("role"), content=C.strip_time_prefix(F.col("content")), occurred_at=F.col("occurred_at"),
        artifact=F.col("artifact"), skip_reason=F.col("reason"),
    )


def detect_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, shape, n_lines) from the name and the first line of each text file.

    Every line is read where it lies and only a few marks per file are shuffled; a dump's COPY line may stand anywhere. A file
    without any line has no row.
    """
    x = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("artifact"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).alias("_at"),
    )
    f = x.groupBy("artifact").agg(
        F.min_by("value", "_at").alias("first"), F.count("*").alias("n_lines"),
        F.max(F.col("value").startswith("COPY public.messages")).alias("_copy"),
        F.max(F.col("value").rlike(r"^- (?:👤|🧑|🤖|🦾)\s")).alias("_chat"),
    )
    name = F.lower(F.substring_index("artifact", "/", -1))
    j = lambda p: F.get_json_object("first", f"$.{p}")
    is_jsonl = name.rlike(r"\.(jsonl|ndjson)(\.gz|\.zst|\.zstd)?$")
    shape = (
        F.when(is_jsonl & F.col("first").contains("session.started"), "trajectory")
        .when(is_jsonl & j("session_id").isNotNull() & j("content").isNotNull() & j("role").isNotNull(), "normalized_jsonl")
        .when(is_jsonl & j("type").isin("message", "session", "model_change", "custom_message"), "message_events")
        .when(name.endswith(".csv") & F.col("first").contains("peer_name"), "peer_csv")
        .when(name.rlike(r"\.(sql|txt)$") & F.col("_copy"), "copy_dump")
        .when(name.endswith(".md") & F.col("_chat"), "chat_md")
        .otherwise("unknown")
    )
    return f.select("artifact", shape.alias("shape"), "n_lines")


def census(shapes: DataFrame, table: DataFrame) -> DataFrame:
    """Files, rows, oldest and newest stamp per shape."""
    stats = kept(table).groupBy("artifact").agg(F.count("*").alias("rows"), F.min("occurred_at").alias("oldest"), F.max("occurred_at").alias("newest"))
    return shapes.join(stats, "artifact", "left").groupBy("shape").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest")
    )


def failure_markers(spark: SparkSession, path: str, now: Column, recent_s: float = 86400, stale_s: float = 3600, max_bytes: int = 1 << 20) -> DataFrame:
    """Failure-marker JSON files of two generations; bad files stay, with the reason.

    The filter on the length reaches the scan, so a file above ``max_bytes`` is listed but never opened.
    """
    from mnemolake.operators import health

    files = spark.read.format("binaryFile").load(path)
    named = [F.col("path").alias("artifact"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length")]
    opened = files.filter(F.col("length") <= max_bytes).select(*named, F.decode("content", "UTF-8").alias("doc"))
    raw = opened.unionByName(files.filter(F.col("length") > max_bytes).select(*named, F.lit(None).cast("string").alias("doc")))
    j = lambda p: F.get_json_object("doc", f"$.{p}")
    parsed = F.from_json("doc", "map<string,string>")
    reason = (
        F.when(F.col("length") > max_bytes, "oversize")
        .when(parsed.isNull(), F.when(C.strip(F.col("doc")).rlike(r"^(\[|\"|-?\d|true|false|null)"), "not_object").otherwise("json_error"))
        .when(F.coalesce(j("job_id"), F.lit("")) == "", "missing_job_id")
        .when(~F.coalesce(j("pending").startswith("{"), F.lit(False)), "missing_pending")
    )
    now_s = now.cast("double")
    failed_at = F.coalesce(timefn.parse_ts(j("last_failure_at")).cast("double"), F.col("mtime"))
    status = health.marker_status(
        j("embedding_status"), j("embedding_attempts").try_cast("int"), now_s - F.col("mtime"), j("embedding_next_retry_at").try_cast("double"), now_s, recent_s, stale_s
    )
    return raw.withColumn("malformed_reason", reason).select(
        "artifact", j("job_id").alias("job_id"), j("session_id").alias("session_id"), j("pending.q_msg_id").alias("question_id"),
        F.when(F.col("malformed_reason").isNotNull(), "malformed").otherwise(status).alias("status"), "malformed_reason",
        j("error_class").alias("error_class"), F.coalesce(j("error_fingerprint"), j("embedding_error_fingerprint")).alias("error_fingerprint"),
        j("embedding_attempts").try_cast("int").alias("attempts"), (failed_at >= now_s - recent_s).alias("is_recent"),
        F.when(j("error_class").isNotNull(), "v2").otherwise("v1_legacy").alias("generation"),
    )
