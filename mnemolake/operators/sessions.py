"""Session signals and tiers, gap blocks, task state, triggers and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.functions import clean as C
from mnemolake.functions import ident as I
from mnemolake.operators import ordered

INCOMPLETE_HOSTS = ("chat_md",)


def session_signals(messages: DataFrame, qa: DataFrame) -> DataFrame:
    """Per-session counts by role, machine rows by rule P4, QA rows by the host in their id."""
    conv = F.col("role").isin("user", "assistant")
    raw = messages.groupBy("host", "session_id").agg(
        F.count("*").alias("raw_n"),
        F.count_if(F.col("role") == "user").alias("user_n"),
        F.count_if(F.col("role") == "assistant").alias("assistant_n"),
        F.count_if(F.col("role") == "tool").alias("tool_n"),
        F.count_if(conv & C.is_machine_preamble(F.col("content"))).alias("machine_n"),
    )
    pairs = qa.groupBy(F.get(F.split("source_id", "/"), 1).alias("host"), "session_id").agg(F.count("*").alias("qa_n"))
    return raw.join(pairs, ["host", "session_id"], "left").withColumn("qa_n", F.coalesce("qa_n", F.lit(0)))


def session_tier(signals: DataFrame) -> DataFrame:
    """A4: tier and reason, first rule that holds."""
    incomplete = F.coalesce(F.col("host").isin(*INCOMPLETE_HOSTS), F.lit(False))
    reason = (
        F.when(incomplete & (F.col("qa_n") == 0) & (F.col("user_n") == 0), "source_missing_user_side")
        .when((F.col("user_n") > 0) & (F.col("qa_n") > 0), "human_question_with_answer")
        .when(F.col("qa_n") > 0, "no_human_question_but_qa_exists")
        .when((F.col("assistant_n") > 0) & (F.col("raw_n") > F.col("machine_n")), "no_qa_but_substantive_assistant_output")
        .when(F.col("raw_n") > 0, "machine_only")
        .otherwise("empty")
    )
    tier = (
        F.when(F.col("reason").isin("source_missing_user_side", "no_qa_but_substantive_assistant_output"), "raw_only")
        .when(F.col("reason") == "human_question_with_answer", "keep")
        .when(F.col("reason") == "no_human_question_but_qa_exists", "downgrade")
        .otherwise("exclude")
    )
    return signals.withColumn("reason", reason).withColumn("tier", tier)


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier", "reason").agg(F.count("*").alias("sessions"))


def gap_blocks(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int = 300, min_rows: int = 3) -> DataFrame:
    """Blocks of a session cut where the pause is longer than the gap; small ones drop."""
    e = events.withColumn("_slice", F.date_trunc("day", ts))
    order = [ts, tie]
    hot = ordered.is_hot(events, [key])
    e = ordered.lag(e, [key], "_slice", order, F.col(ts), "_prev", hot)
    pause = F.unix_micros(ts) - F.unix_micros("_prev")
    cut = F.when(pause > gap_seconds * 1_000_000, 1).otherwise(0).cast("long")
    e = ordered.running_sum(e, [key], "_slice", order, cut, "block_no", hot)
    return (
        e.groupBy(key, "block_no")
        .agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_rows"))
        .filter(F.col("n_rows") >= min_rows)
    )


def most_recent_blocks(blocks: DataFrame, key: str, limit: int) -> DataFrame:
    return blocks.orderBy(F.desc("ended"), key, "block_no").limit(limit)


# --- tasks -------------------------------------------------------------------
def derive_task_id(text: Column, task_id: Column, delegation_id: Column) -> Column:
    """Identity from provenance, else from a delegation or cron id in the text."""
    body = F.coalesce(text, F.lit(""))
    own = C.strip(C.none_if_blank(task_id))
    deleg = C.strip(C.none_if_blank(delegation_id))

    def found(pattern: str, prefix: str) -> Column:
        hit = F.regexp_extract(body, pattern, 1)
        return F.when(hit != "", F.concat(F.lit(prefix), hit))

    return F.coalesce(
        F.when(own.startswith("task:"), own).otherwise(F.concat(F.lit("task:"), own)),
        F.concat(F.lit("deleg:"), F.regexp_replace(deleg, "^deleg_", "")),
        found(R.DELEGATION_ID, "deleg:"),
        *[found(p, "cron:") for p in R.CRON_IDS],
    )


def derive_project(text: Column, *declared: Column) -> Column:
    hit = F.regexp_extract(F.coalesce(text, F.lit("")), R.PROJECT_REF, 1)
    return F.coalesce(*[C.strip(C.none_if_blank(c)) for c in declared], F.when(hit != "", hit))


def task_events(items: DataFrame) -> DataFrame:
    """Task events from delegation receipts, two rows (created, outcome) per task line.

    ``items``: host, session_id, event_id, content, occurred_at.
    """
    text = F.coalesce("content", F.lit(""))
    r = items.withColumn("_deleg", F.lower(F.regexp_extract(text, R.RECEIPT, 1))).filter("_deleg <> ''")
    day, clock = F.regexp_extract(text, R.DISPATCHED, 1), F.regexp_extract(text, R.DISPATCHED, 2)
    r = r.withColumns({
        "_prefix": F.concat(F.lit("deleg:"), F.regexp_replace("_deleg", "^deleg_", "")),
        "created_at": F.when(day != "", F.concat(day, F.lit("T"), clock)).otherwise(F.col("occurred_at")),
        "project": derive_project(F.col("content")),
        "source_id": F.concat_ws(":", F.lit("conversation_stream"), "host", "session_id", F.coalesce("event_id", F.lit(""))),
        "_lines": F.regexp_extract_all(text, F.lit(R.TASK_LINE), 0),
    })
    outcome = F.create_map(*[x for k, v in R.TASK_OUTCOME.items() for x in (F.lit(k), F.lit(v))])
    lines = r.filter(F.size("_lines") > 0).select("*", F.explode("_lines").alias("_line"))
    part = lambda i: F.regexp_extract("_line", R.TASK_LINE, i)
    lines = lines.withColumns({
        "task_id": F.when(F.size("_lines") > 1, F.concat_ws(":", "_prefix", part(1))).otherwise(F.col("_prefix")),
        "goal": part(3), "reported": part(4),
    })
    created = lines.select(
        "task_id", F.lit("created").alias("event_type"), C.clip(F.col("goal"), 400).alias("summary"),
        "source_id", F.col("created_at").alias("occurred_at"), "project",
    )
    done = lines.select(
        "task_id", F.coalesce(outcome[F.lower("reported")], F.lit("progress")).alias("event_type"),
        C.clip(F.concat("goal", F.lit(" — status="), "reported"), 400).alias("summary"),
        "source_id", "occurred_at", "project",
    )
    bare = r.filter(F.size("_lines") == 0).select(
        F.col("_prefix").alias("task_id"), F.lit("progress").alias("event_type"),
        C.clip(F.substring_index("content", "]", -1), 400).alias("summary"), "source_id", "occurred_at", "project",
    )
    out = created.unionByName(done).unionByName(bare)
    return out.withColumn("event_id", I.task_event_id(F.col("task_id"), F.col("event_type"), F.col("source_id")))


def status_of(event_type: Column) -> Column:
    table = F.create_map(*[x for k, v in R.TASK_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return table[event_type]


def task_state(events: DataFrame) -> DataFrame:
    """Latest event per task (DISTINCT ON), with the goal from the first created/requirement event.

    ``events``: task_id, event_type, status, summary, occurred_at, event_id.
    """
    at = F.struct("occurred_at", "event_id")
    is_goal = F.col("event_type").isin("created", "requirement")
    return events.groupBy("task_id").agg(
        F.max_by("status", at).alias("status"),
        F.max_by("event_id", at).alias("last_event"),
        F.max("occurred_at").alias("last_at"),
        F.min_by("summary", F.when(is_goal, at)).alias("goal"),
        F.count("*").alias("n_events"),
    )


def open_tasks(state: DataFrame) -> DataFrame:
    return state.filter(~F.col("status").isin("verified_done", "claimed_done"))


# --- backlog, cursors, triggers ---------------------------------------------
def unobserved(qa: DataFrame, cursor: int) -> DataFrame:
    """Totals after a cursor. ``qa``: id, session_id, ts, question, answer."""
    chars = F.length(F.coalesce("question", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))
    live = qa.filter((F.col("id") > cursor) & F.col("answer").isNotNull() & C.not_inspection_session(F.col("session_id")))
    return live.groupBy("session_id").agg(
        F.count("*").alias("unobs_count"), F.sum(chars).alias("unobs_chars"), F.max("ts").alias("last_qa_ts")
    )


def trigger_decision(
    backlog: DataFrame, known_sessions: DataFrame, now: Column, last_update: Column,
    chars_at: int = 50_000, count_at: int = 100, new_session_at: int = 5_000, idle_hours: float = 4, debounce_minutes: float = 8,
) -> DataFrame:
    """X5 (batch twin): token, count, new session or pause, in this order, after the debounce."""
    b = backlog.join(known_sessions.select("session_id").withColumn("_known", F.lit(1)), "session_id", "left")
    total = b.agg(
        F.sum("unobs_chars").alias("unobs_chars"), F.sum("unobs_count").alias("unobs_count"),
        F.max("last_qa_ts").alias("last_qa_ts"),
        F.max(F.when(F.col("_known").isNull(), F.col("unobs_chars"))).alias("_new"),
        F.count_if(F.col("_known").isNull()).alias("new_sessions"),
    )
    ready = F.lit(True) if debounce_minutes <= 0 else F.coalesce(
        (F.unix_timestamp(now) - F.unix_timestamp(last_update)) / 60 >= debounce_minutes, F.lit(True)
    )
    idle = ((F.unix_timestamp(now) - F.unix_timestamp("last_qa_ts")) / 3600 >= idle_hours) & (F.col("unobs_count") > 0)
    reason = (
        F.when(~ready, F.lit(None))
        .when(F.col("unobs_chars") >= chars_at, "token")
        .when(F.col("unobs_count") >= count_at, "count")
        .when(F.col("_new") >= new_session_at, "new_session")
        .when(idle, "pause")
    )
    return total.withColumn("reason", reason).withColumn("trigger", F.col("reason").isNotNull()).drop("_new")


def after_cursor(rows: DataFrame, cursor: int, limit: int, order: str = "id") -> DataFrame:
    """The next rows after a cursor, in order."""
    return rows.filter(F.col(order) > cursor).orderBy(order).limit(limit)


def batch_bounds(batch: DataFrame) -> DataFrame:
    return batch.agg(F.min("id").alias("range_lo"), F.max("id").alias("range_hi"), F.count("*").alias("n"))


def high_signal_snippets(messages: DataFrame) -> DataFrame:
    """Of a session's last 20 messages the long user texts and marked answers, last five kept."""
    last = W.partitionBy("session_id").orderBy(F.desc("ord"))
    tail = messages.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= 20)
    marked = F.lit(False)
    for w in R.SIGNAL_WORDS:
        marked = marked | F.col("content").contains(w)
    snippet = F.when(
        (F.col("role") == "user") & (F.length("content") > 50), F.concat(F.lit("[User]: "), F.substring("content", 1, 200))
    ).when((F.col("role") == "assistant") & marked, F.concat(F.lit("[Assistant]: "), F.substring("content", 1, 200)))
    tail = tail.withColumn("snippet", snippet).filter("snippet is not null")
    tail = tail.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= 5)
    return tail.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "snippet"))), lambda s: s["snippet"]), "\n\n").alias("snippets")
    )


def stable_match(matches: DataFrame, confirm: int = 2) -> DataFrame:
    """The last ``confirm`` matches of a session name one topic."""
    w = W.partitionBy("session_id").orderBy(F.desc("seq"))
    tail = matches.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= confirm)
    return tail.groupBy("session_id").agg(
        ((F.count("topic") == confirm) & (F.countDistinct("topic") == 1)).alias("stable"), F.max_by("topic", "seq").alias("topic")
    )


def changed_blocks(blocks: DataFrame) -> DataFrame:
    """Inject a block only when it differs from the one before it in the session."""
    b = blocks.withColumn("_slice", ordered.slice_of("seq"))
    b = ordered.lag(b, ["session_id"], "_slice", ["seq"], F.col("block"), "_prev", ordered.is_hot(blocks, ["session_id"]))
    return b.withColumn("inject", ~F.col("block").eqNullSafe(F.col("_prev"))).drop("_prev", "_slice")


def bounded_rebuild(rows: DataFrame, batch_rows: int, budget: float, cursor: int = -1) -> DataFrame:
    """Ordered batches; a batch runs while the cost of the batches before it is under budget."""
    hot = ordered.is_hot(rows, [])
    r = rows.filter(F.col("id") > cursor).withColumn("_slice", F.floor(F.col("id") / ordered.SLICE_ROWS)).withColumn("_all", F.lit(0))
    r = ordered.row_number(r, ["_all"], "_slice", ["id"], "_rn", hot)
    batches = r.groupBy("_all", F.floor((F.col("_rn") - 1) / batch_rows).cast("long").alias("batch_no")).agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("cost").alias("cost")
    )
    batches = batches.withColumn("_slice", ordered.slice_of("batch_no"))
    batches = ordered.running_sum(batches, ["_all"], "_slice", ["batch_no"], F.col("cost"), "_spent", hot)
    return batches.withColumn("spent_before", F.col("_spent") - F.col("cost")).withColumn(
        "runs", F.round(F.col("spent_before"), 6) < budget
    ).select("batch_no", "first_id", "last_id", F.round("cost", 6).alias("cost"), F.round("spent_before", 6).alias("spent_before"), "runs")
