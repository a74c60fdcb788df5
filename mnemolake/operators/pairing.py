"""Message rows to question/answer pairs, and autonomous delivery groups.

Input columns: host, session_id, ord (parse order, dense per session), event_id,
role, content, occurred_at (ISO text or null), session_source, tool_calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.functions import clean as C
from mnemolake.functions import ident as I
from mnemolake.operators import ordered

KEYS = ["host", "session_id"]


def with_session_keys(messages: DataFrame) -> DataFrame:
    return messages.withColumns({
        "host": F.coalesce(C.strip(C.none_if_blank(F.col("host"))), F.lit("unknown")),
        "session_id": F.coalesce(C.strip(C.none_if_blank(F.col("session_id"))), F.lit("imported")),
    })


def pairable_rows(messages: DataFrame) -> DataFrame:
    """Rows that may form pairs, with delivery markers and shells removed from the text.

    The role is decided first; machine text on the user side drops, on the
    assistant side it stays as a boundary and is ignored by the answer rule.
    """
    m = with_session_keys(messages)
    m = m.withColumn("role", F.lower(C.strip(F.coalesce("role", F.lit("")))))
    m = m.filter(F.col("role").isin("user", "assistant"))
    m = m.filter(C.strip(F.coalesce("content", F.lit(""))) != "")
    m = m.filter(~C.is_machine_session(F.col("session_source")))
    m = m.withColumn("content", C.strip_host_markers(F.col("content")))
    is_user = F.col("role") == "user"
    m = m.withColumn("_pre", C.is_machine_preamble(F.col("content")))
    m = m.filter(~(is_user & (F.col("_pre") | C.is_machine_dump(F.col("content")))))
    m = m.withColumn("_shell", F.when(is_user, C.unwrap_injected(F.col("content"))))
    m = m.withColumn("content", F.coalesce("_shell.body", "content"))
    m = m.filter(
        F.col("_shell").isNull()
        | ((F.col("content") != "") & ~C.is_machine_preamble(F.col("content")))
    )
    m = m.filter(~C.is_compaction_glue(F.col("content")))
    return m.drop("_shell", "_pre")


def collapse_repeats(rows: DataFrame, hot: bool | None = None) -> DataFrame:
    """Of neighbours (parse order) with one role and one text, keep the first."""
    hot = ordered.is_hot(rows, KEYS) if hot is None else hot
    rows = rows.withColumn("_slice", ordered.slice_of("ord"))
    here = F.struct(F.col("role"), F.sha2(C.strip(F.col("content")), 256).alias("h"))
    rows = ordered.lag(rows, KEYS, "_slice", ["ord"], here, "_prev", hot)
    return rows.filter(F.col("_prev").isNull() | (F.col("_prev") != here)).drop("_prev", "_slice")


def time_slices(rows: DataFrame) -> DataFrame:
    """Slice key that follows (occurred_at, ord).

    Stamped rows slice by the minute of the stamp; rows without one sort by
    ``ord`` alone, so they slice by ordinal blocks.
    """
    rows = rows.withColumn("_ts", F.coalesce("occurred_at", F.lit("")))
    block = F.when(F.col("_ts") == "", ordered.slice_of("ord")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("_slice", F.struct(F.substring("_ts", 1, 16).alias("m"), block.alias("b")))


def turn_numbers(rows: DataFrame, hot: bool | None = None) -> DataFrame:
    """A user row after a non-user row opens a turn; rows before the first user drop.

    Order is ISO text with missing stamps first, then parse order.
    """
    hot = ordered.is_hot(rows, KEYS) if hot is None else hot
    rows = time_slices(rows)
    order = ["_ts", "ord"]
    rows = ordered.lag(rows, KEYS, "_slice", order, F.col("role"), "_prev_role", hot)
    opens = (F.col("role") == "user") & (F.coalesce("_prev_role", F.lit("")) != "user")
    rows = ordered.running_sum(
        rows, KEYS, "_slice", order, F.when(opens, 1).otherwise(0).cast("long"), "turn_no", hot
    )
    return rows.filter(F.col("turn_no") > 0).drop("_prev_role", "_slice")


def final_answer(assistant_rows: Column) -> Column:
    """A2 over an ordered array of ``struct(content, machine, has_tools)``.

    Machine rows are ignored. One row: itself. No tools anywhere: all rows
    joined. Otherwise the last row without tools, else the last row.
    """
    real = F.filter(assistant_rows, lambda r: ~r["machine"])
    plain = F.filter(real, lambda r: ~r["has_tools"])
    joined = F.array_join(F.transform(real, lambda r: C.strip(r["content"])), "\n\n")
    last_plain = F.get(plain, F.size(plain) - 1)["content"]
    last_real = F.get(real, F.size(real) - 1)["content"]
    return (
        F.when(F.size(real) == 0, "")
        .when(F.size(real) == F.size(plain), joined)
        .otherwise(C.strip(F.coalesce(last_plain, last_real)))
    )


def has_tools(tool_calls: Column) -> Column:
    t = F.coalesce(tool_calls, F.lit(""))
    return ~t.isin("", "[]", "null")


def pair_turns(turned: DataFrame) -> DataFrame:
    """A1: one row per turn that has a question and a substantive answer."""
    is_user = F.col("role") == "user"
    seq = F.struct("_ts", "ord")
    rows = turned.withColumns({
        "_machine": C.is_machine_preamble(F.col("content")),
        "_tools": has_tools(F.col("tool_calls")),
    })
    turns = rows.groupBy(*KEYS, "turn_no").agg(
        F.array_sort(
            F.collect_list(F.when(is_user, F.struct("_ts", "ord", C.strip(F.col("content")).alias("content"))))
        ).alias("_u"),
        F.array_sort(
            F.collect_list(
                F.when(
                    ~is_user,
                    F.struct(
                        "_ts", "ord", "content",
                        F.col("_machine").alias("machine"), F.col("_tools").alias("has_tools"),
                    ),
                )
            )
        ).alias("_a"),
        F.min_by(F.when(is_user, F.col("event_id")), F.when(is_user, seq)).alias("q_event"),
        F.min_by(F.when(is_user, F.col("occurred_at")), F.when(is_user, seq)).alias("occurred_at"),
    )
    turns = turns.withColumns({
        "question": F.array_join(F.transform("_u", lambda r: r["content"]), "\n\n"),
        "answer": final_answer(F.col("_a")),
        "n_user": F.size("_u"),
        "n_assistant": F.size("_a"),
    }).drop("_u", "_a")
    return turns.filter(
        (F.col("n_user") > 0)
        & (F.col("n_assistant") > 0)
        & (C.strip(F.col("answer")) != "")
        & ~C.is_machine_dump(F.col("question"))
    )


def qa_pairs(messages: DataFrame, prefix: str = "qa_import") -> DataFrame:
    """A1 with identities: pairs numbered per session over the pairs that are emitted."""
    # bound on every later step: rows per session of the input
    hot = ordered.is_hot(messages, KEYS)
    pairs = pair_turns(turn_numbers(collapse_repeats(pairable_rows(messages), hot), hot))
    pairs = pairs.withColumn("_slice", ordered.slice_of("turn_no"))
    pairs = ordered.row_number(pairs, KEYS, "_slice", ["turn_no"], "turn_id", hot).drop("_slice")
    derived = F.concat(
        F.lit("derived:"), "host", F.lit(":"), "session_id", F.lit(":turn-"), F.col("turn_id").cast("string")
    )
    q_event = F.coalesce(C.strip(C.none_if_blank(F.col("q_event"))), derived)
    return pairs.withColumn("q_event_id", q_event).select(
        *KEYS, "turn_id", "question", "answer", "q_event_id", "occurred_at",
        F.concat_ws("/", F.lit(prefix), "host", "session_id", "q_event_id").alias("source_id"),
    )


def machine_session_skips(messages: DataFrame) -> DataFrame:
    """Skipped conversational rows per program-created session."""
    m = with_session_keys(messages)
    role = F.lower(C.strip(F.coalesce("role", F.lit(""))))
    return (
        m.filter(role.isin("user", "assistant"))
        .filter(C.strip(F.coalesce("content", F.lit(""))) != "")
        .filter(C.is_machine_session(F.col("session_source")))
        .groupBy(*KEYS)
        .agg(F.count("*").alias("skipped"))
    )


def delivery_groups(rows: DataFrame) -> DataFrame:
    """A3: assistant rows after a machine boundary, up to a real user or the next boundary.

    Input adds ``kind`` (host event kind). Rows that are neither boundary nor
    user nor non-empty assistant text pass through without effect.
    """
    rows = with_session_keys(rows)
    opens = F.col("kind").isin(*R.BOUNDARY_KINDS)
    marks = opens | (F.col("kind") == "REAL_USER")
    hot = ordered.is_hot(rows, KEYS)
    rows = rows.withColumn("_slice", ordered.slice_of("ord"))
    rows = ordered.running_sum(
        rows, KEYS, "_slice", ["ord"], F.when(marks, 1).otherwise(0).cast("long"), "_grp", hot
    ).filter(F.col("_grp") > 0)
    member = (F.col("kind") == "NORMAL_ASSISTANT") & (C.strip(F.coalesce("content", F.lit(""))) != "")
    groups = rows.filter(marks | member).groupBy(*KEYS, "_grp").agg(
        F.max(F.when(opens, F.col("event_id"))).alias("trigger_event_id"),
        F.max(F.when(opens, F.col("kind"))).alias("trigger_kind"),
        F.array_sort(F.collect_list(F.when(member, F.struct("ord", "event_id", "content")))).alias("_m"),
        F.min("occurred_at").alias("started_at"),
    )
    return groups.filter(F.col("trigger_event_id").isNotNull() & (F.size("_m") > 0)).select(
        *KEYS,
        I.delivery_id(F.col("host"), F.col("session_id"), F.col("trigger_event_id")).alias("source_id"),
        "trigger_event_id",
        "trigger_kind",
        F.transform("_m", lambda r: r["event_id"]).alias("event_ids"),
        F.array_join(F.transform("_m", lambda r: r["content"]), "\n").alias("content"),
        "started_at",
    )


def stride_pairs(messages: DataFrame) -> DataFrame:
    """Neighbours (1,2), (3,4), … of a session form pairs; an odd last row drops."""
    m = messages.withColumn("_slice", ordered.slice_of("ord"))
    m = ordered.row_number(m, KEYS, "_slice", ["ord"], "_rn", ordered.is_hot(messages, KEYS))
    pair = F.floor((F.col("_rn") - 1) / 2).cast("long")
    return (
        m.withColumn("pair_no", pair)
        .groupBy(*KEYS, "pair_no")
        .agg(
            F.min_by("content", "_rn").alias("first_text"),
            F.max_by("content", "_rn").alias("second_text"),
            F.count("*").alias("_n"),
        )
        .filter(F.col("_n") == 2)
        .drop("_n")
    )


def trajectory_turns(events: DataFrame) -> DataFrame:
    """A prompt pairs with the completion after it; an orphan completion stands alone.

    Input: session_id, ord, kind in (prompt, completion), content. A later
    prompt replaces an unanswered one.
    """
    keys = ["session_id"]
    hot = ordered.is_hot(events, keys)
    e = events.withColumn("_slice", ordered.slice_of("ord"))
    e = ordered.lag(e, keys, "_slice", ["ord"], F.struct("kind", "content"), "_last", hot)
    done = e.filter(F.col("kind") == "completion")
    prompt = F.when(F.col("_last.kind") == "prompt", F.col("_last.content"))
    has_text = C.strip(F.coalesce("content", F.lit(""))) != ""
    done = done.withColumn("user_text", prompt)
    done = done.filter(
        (F.col("user_text").isNotNull() & ((C.strip(F.col("user_text")) != "") | has_text)) | has_text
    )
    done = ordered.row_number(done, keys, "_slice", ["ord"], "turn_no", hot)
    return done.select(
        "session_id", "turn_no", "user_text",
        F.when(F.col("user_text").isNotNull() & (F.coalesce("content", F.lit("")) == ""), R.TOOL_ONLY_ANSWER)
        .otherwise(F.col("content"))
        .alias("assistant_text"),
    )
