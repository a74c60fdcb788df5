"""Health metrics to diagnoses and repair rows, marker ledger, affinity, rebuild cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake import rules as R

MARKER_STATUSES = (
    "pending", "in_flight", "stale_in_flight", "pending_db", "stale_pending_db",
    "retryable", "retry_due", "recovered", "poisoned", "unresolved", "malformed",
)
# fixed values: repair action, issue codes it answers, risk, reversible, needs provider
REPAIRS = (
    ("REBUILD_EMBEDDING_FOR_QA_IDS", ("RECENT_EMBEDDING_FAILURE", "HISTORICAL_EMBEDDING_DEBT"), "medium", False, True),
    ("RETRY_PENDING_FAILURES", ("RECENT_FAILURE_MARKER", "POISONED_FAILURE_MARKER", "RETRY_EXHAUSTED", "STALE_PENDING_MARKER"), "medium", True, True),
    ("REBUILD_EXPLICIT_MEMORY_EMBEDDING", ("EXPLICIT_MEMORY_EMBEDDING_NULL",), "medium", False, True),
    ("REBUILD_LONG_QA_CHUNKS", ("LONG_QA_CHUNK_INCONSISTENT",), "medium", False, True),
)


def marker_status(raw: Column, attempts: Column, age_s: Column, next_retry: Column, now: Column, recent_s: float, stale_s: float) -> Column:
    """Status of a failure marker."""
    return (
        F.when(raw == "recovered", "recovered")
        .when(raw == "poisoned", "poisoned")
        .when((raw == "failed") & next_retry.isNotNull(), F.when(next_retry > now, "retryable").otherwise("retry_due"))
        .when(raw == "failed", F.when(age_s < recent_s, "retryable").otherwise("retry_due"))
        .when(raw == "in_flight", F.when(age_s > stale_s, "stale_in_flight").otherwise("in_flight"))
        .when(raw == "embedding_succeeded_pending_db", F.when(age_s > stale_s, "stale_pending_db").otherwise("pending_db"))
        .when(raw.isNull() & (attempts == 0), "pending")
        .otherwise("unresolved")
    )


def marker_ledger(markers: DataFrame) -> DataFrame:
    """Markers by status, every status listed, with the recent subset.

    ``markers``: status, is_recent, job_id.
    """
    spark = markers.sparkSession
    dim = spark.createDataFrame([(s,) for s in MARKER_STATUSES], "status string")
    got = markers.groupBy("status").agg(F.count("*").alias("n"), F.count_if("is_recent").alias("recent"))
    return dim.join(got, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("recent", F.lit(0)).alias("recent")
    )


def duplicate_markers(markers: DataFrame) -> DataFrame:
    return markers.groupBy("question_id").agg(F.count("*").alias("n")).filter("n > 1")


def failed_segments(segments: DataFrame, cursor: int | None) -> DataFrame:
    """``segments``: seg_no, seg (JSON text). Malformed ends always count as active."""
    field = lambda k: F.get_json_object("seg", f"$.{k}")
    number = lambda c: F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))
    end = F.coalesce(*[number(F.trim(field(k))) for k in ("qa_range_end", "source_end_id", "end_id")])
    s = segments.withColumn("end", F.when(end >= 0, end))
    active = F.lit(True) if cursor is None else (F.col("end").isNull() | (F.col("end") > cursor))
    return s.agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(F.col("end").isNull()).alias("malformed"),
        F.min_by(F.coalesce(field("error_class"), field("error")), "seg_no").alias("first_error"),
    )


def diagnose(metrics: DataFrame) -> DataFrame:
    """One row of counters to issue rows; the recent part of a debt is an incident, the rest is history."""
    m = F.col
    hist_null = F.greatest(m("embedding_null_total") - m("recent_embedding_null"), F.lit(0))
    hist_empty = F.greatest(m("empty_answer_total") - m("recent_empty_answer"), F.lit(0))
    chunk_bad = m("chunk_parents_missing") + m("chunk_null_vectors") + m("chunk_bad_offsets") + m("chunk_duplicate_keys")

    def issue(code: str, severity, n: Column, when: Column, repairable: bool) -> Column:
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(
            when & (n > 0),
            F.struct(F.lit(code).alias("code"), sev.alias("severity"), n.cast("long").alias("n"), F.lit(repairable).alias("repairable")),
        )

    yes = F.lit(True)
    issues = [
        issue("RECENT_EMBEDDING_FAILURE", "error", m("recent_embedding_null"), yes, True),
        issue("HISTORICAL_EMBEDDING_DEBT", "info", hist_null, yes, True),
        issue("EMPTY_ANSWER_RECENT", "warning", m("recent_empty_answer"), yes, False),
        issue("EMPTY_ANSWER_HISTORICAL_DEBT", "info", hist_empty, yes, False),
        issue("EXPLICIT_MEMORY_EMBEDDING_NULL", "warning", m("explicit_embedding_null"), yes, True),
        issue(
            "LONG_QA_CHUNK_INCONSISTENT",
            F.when((m("chunk_parents_missing") > 0) | (m("chunk_null_vectors") > 0), "error").otherwise("warning"),
            chunk_bad, yes, True,
        ),
        issue("RECENT_FAILURE_MARKER", "error", m("current_active"), yes, True),
        issue("RETRY_EXHAUSTED", "warning", m("current_retrying"), m("current_active") == 0, True),
        issue("POISONED_FAILURE_MARKER", "error", m("current_poisoned"), yes, True),
        issue("POISONED_FAILURE_MARKER", "info", m("total_poisoned"), m("current_poisoned") == 0, True),
        issue("MALFORMED_FAILURE_MARKER", "warning", m("malformed"), yes, False),
        issue("STALE_PENDING_MARKER", "warning", m("stale"), yes, True),
    ]
    rank = F.when(m("severity") == "error", 0).when(m("severity") == "warning", 1).otherwise(2)
    return metrics.select(F.explode(F.filter(F.array(*issues), lambda x: x.isNotNull())).alias("i")).select("i.*").withColumn(
        "severity_rank", rank
    )


def plan_repairs(issues: DataFrame) -> DataFrame:
    """Repairable issues grouped under the action that answers them."""
    spark = issues.sparkSession
    table = spark.createDataFrame(
        [(a, c, risk, rev, prov) for a, codes, risk, rev, prov in REPAIRS for c in codes],
        "action string, code string, risk string, reversible boolean, requires_provider boolean",
    )
    return issues.filter("repairable").join(table, "code").groupBy("action", "risk", "reversible", "requires_provider").agg(
        F.sum("n").alias("target_count"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes")
    )


def freshness(topics: DataFrame, qa: DataFrame, as_of: Column) -> DataFrame:
    """Newest topic, hours since, and pairs written after it."""
    newest = topics.agg(F.max("updated_at").alias("newest_topic"))
    # one row: the newest stamp, read once as a scalar
    last = newest.scalar()
    return qa.agg(
        F.count_if(F.col("created_at") > last).alias("backlog"), F.max("created_at").alias("newest_qa")
    ).withColumn("newest_topic", last).withColumn(
        "hours_since", F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("newest_topic")) / 3600)
    )


def affinity(cards: DataFrame) -> DataFrame:
    """Per user the four dimensions, total, level and span. ``cards``: user_id, category, tags, ts."""
    n = lambda *c: F.count_if(F.col("category").isin(*c))
    base = cards.groupBy("user_id").agg(
        F.count("*").alias("total_cards"),
        F.greatest(F.lit(1), F.floor((F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))) / 86400)).alias("span_days"),
        n("session_summary", "session_summaries").alias("sc"), n("lessons").alias("lessons"), n("decisions").alias("decisions"),
        n("projects").alias("projects"), n("creative").alias("creative"), n("memory").alias("memory"),
        n("evolution").alias("evolution"), n("rules").alias("rules"),
    )
    tags = (
        cards.select("user_id", F.explode("tags").alias("t")).withColumn("t", F.trim("t")).filter(F.length("t") > 2)
        .groupBy("user_id").agg(F.countDistinct("t").alias("tags_count"))
    )
    b = base.join(tags, "user_id", "left").withColumn("tags_count", F.coalesce("tags_count", F.lit(0)))
    cap = lambda c: F.least(F.lit(100), F.floor(F.round(c, 9)))
    ln = F.log1p
    b = b.withColumns({
        "companionship": cap(ln("span_days") * 15 + ln("sc") * 8),
        "progress": cap(ln(F.col("lessons") * 3 + F.col("decisions") * 5) * 6),
        "creation": cap(ln(F.col("projects") * 8 + F.col("creative") * 20) * 6),
        "understanding": cap(ln(F.col("memory") * 6 + F.col("evolution") * 15 + F.col("rules") * 3 + F.col("tags_count") * 0.3) * 6),
    })
    total = F.least(
        F.lit(1000), F.floor((F.col("companionship") + F.col("progress") + F.col("creation") + F.col("understanding")) * 2.5)
    )
    b = b.withColumn("score", total)
    level = F.lit(R.AFFINITY_LEVELS[-1][1])
    for limit, name in reversed(R.AFFINITY_LEVELS):
        level = F.when(F.col("score") <= limit, name).otherwise(level)
    miles = F.array(
        F.when(F.col("span_days") >= 30, "满月").when(F.col("span_days") >= 14, "半月"),
        F.when(F.col("sc") >= 100, "百次对话").when(F.col("sc") >= 50, "第50次对话").when(F.col("sc") >= 25, "第25次对话").when(F.col("sc") >= 10, "第十次对话"),
        F.when(F.col("projects") > 0, "有合作项目"), F.when(F.col("creative") > 0, "有创作成果"), F.when(F.col("evolution") > 5, "身份成形"),
    )
    return b.withColumn("level", level).withColumn("milestones", F.array_join(F.filter(miles, lambda x: x.isNotNull()), ","))


def rebuild_estimate(messages: DataFrame, tokens_per_qa: float, tokens_per_note: float, note_range: tuple[float, float], qa_per_note: int, price_in: float | None, price_out: float | None) -> DataFrame:
    """Token and cost estimate of a full rebuild; cost is null while a price is unknown."""
    base = messages.agg(F.count("*").alias("messages"))
    b = base.withColumn("qa", F.greatest(F.lit(1), F.floor(F.col("messages") / 2)))
    b = b.withColumn("notes", F.greatest(F.lit(1), F.ceil(F.col("qa") / qa_per_note)))
    whole = lambda c: F.floor(F.round(c, 6)).cast("long")
    b = b.withColumns({
        "est_input_tokens": whole(F.col("qa") * tokens_per_qa), "est_output_tokens": whole(F.col("notes") * tokens_per_note),
        "input_lo": whole(F.col("qa") * tokens_per_qa * 0.7), "input_hi": whole(F.col("qa") * tokens_per_qa * 1.3),
        "output_lo": whole(F.col("notes") * note_range[0]), "output_hi": whole(F.col("notes") * note_range[1]),
    })
    if price_in is None or price_out is None:
        return b.withColumn("est_cost", F.lit(None).cast("double"))
    return b.withColumn(
        "est_cost", F.round(F.col("est_input_tokens") / 1000 * price_in + F.col("est_output_tokens") / 1000 * price_out, 4)
    )


def usage_telemetry(qa: DataFrame, notes: DataFrame) -> DataFrame:
    """Average sizes, pairs per note, pairs per day."""
    q = qa.agg(
        F.round(F.avg(F.length("question")), 4).alias("avg_question_chars"),
        F.round(F.avg(F.length("answer")), 4).alias("avg_answer_chars"),
        F.count("*").alias("pairs"), F.countDistinct(F.to_date("created_at")).alias("days"),
    )
    n = notes.agg(F.count("*").alias("n")).scalar()
    return q.withColumn("notes", n).withColumn("pairs_per_note", F.round(F.col("pairs") / F.col("notes"), 4)).withColumn(
        "turns_per_day", F.round(F.col("pairs") / F.col("days"), 4)
    )


def import_totals(reports: DataFrame) -> DataFrame:
    """Totals over sources. ``reports``: source, imported, skipped, oldest, newest, ready."""
    return reports.groupBy("source").agg(
        F.sum("imported").alias("imported"), F.sum("skipped").alias("skipped"),
        F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.bool_or("ready").alias("ready"),
    )
