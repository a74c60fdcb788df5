"""Markdown shapes: heading sections, role-prefixed transcripts, chat bullets, note sections.

Inputs are line tables: key columns, ``line_no`` and ``value``. One document may
be very long, so line order is handled by the ordered scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.clean import strip
from mnemolake.operators import ordered

HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def slug(c):
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\s+", "-"), "[^a-z0-9._-]+", "")
    return F.when(s == "", "section").otherwise(s)


def heading_sections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per heading with the body up to the next heading, 1-based line bounds."""
    hot = ordered.is_hot(lines, keys)
    head = F.col("value").rlike(r"^#{1,6}\s+\S")
    x = lines.withColumn("_slice", ordered.slice_of("line_no")).withColumn("_h", head)
    x = ordered.running_sum(x, keys, "_slice", ["line_no"], F.when(F.col("_h"), 1).otherwise(0).cast("long"), "_sec", hot)
    g = x.filter(F.col("_sec") > 0).groupBy(*keys, "_sec").agg(
        F.max(F.when(F.col("_h"), F.regexp_extract("value", HEADING, 2))).alias("title"),
        (F.min("line_no") + 1).alias("line_start"), F.max("line_no").alias("line_end"),
        F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "value")))).alias("_b"),
    )
    return g.select(
        *keys, strip(F.col("title")).alias("title"), slug(F.col("title")).alias("slug"), "line_start", "line_end",
        F.array_join(F.transform("_b", lambda s: s["value"]), "\n").alias("body"),
    )


def role_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks opened by ``user:`` / ``assistant:``; tool-call lines are skipped."""
    hot = ordered.is_hot(lines, keys)
    bare = strip(F.col("value"))
    role = F.when(bare.startswith("user:"), "user").when(bare.startswith("assistant:"), "assistant")
    x = lines.withColumn("_role", role).withColumn("_slice", ordered.slice_of("line_no"))
    x = ordered.running_sum(
        x, keys, "_slice", ["line_no"], F.when(F.col("_role").isNotNull(), 1).otherwise(0).cast("long"), "_blk", hot
    ).filter(F.col("_blk") > 0)
    rest = F.when(
        F.col("_role").isNotNull(),
        F.when(strip(F.regexp_replace(bare, "^(user|assistant):", "")) != "", strip(F.regexp_replace(bare, "^(user|assistant):", ""))),
    ).when(~bare.startswith("tool_calls:"), F.col("value"))
    x = x.withColumn("_t", rest)
    g = x.groupBy(*keys, "_blk").agg(
        F.max("_role").alias("role"),
        F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("line_no", "_t")))).alias("_b"),
    ).filter(F.size("_b") > 0)
    return g.select(
        *keys, (F.col("_blk") - 1).alias("block_no"), "role",
        strip(F.array_join(F.transform("_b", lambda s: s["_t"]), "\n")).alias("content"),
    )


def note_sections(docs: DataFrame, keys: list[str], text_col: str, min_chars: int = 30, max_chars: int = 6000) -> DataFrame:
    """Parts of a note opened by ``## ``; parts under 30 characters drop, bodies are cut at 6000."""
    body = F.regexp_replace(F.concat(F.lit("\n"), text_col), r"^(?s:.*?)\n(?=##\s)", "")
    parts = F.split(body, r"\n(?=##\s)")
    ex = docs.filter(F.col(text_col).rlike(r"(?:^|\n)##\s")).select(*keys, F.posexplode(parts).alias("pos", "_p")).withColumn("_p", strip(F.col("_p")))
    return ex.filter(F.length("_p") >= min_chars).select(
        *keys, "pos", F.substring(strip(F.regexp_extract("_p", r"^##\s+([^\n]+)", 1)), 1, 100).alias("section"),
        F.substring("_p", 1, max_chars).alias("content"),
    )


def chat_bullets(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Date headings and clock headings carried onto user / assistant bullets."""
    hot = ordered.is_hot(lines, keys)
    v = strip(F.col("value"))
    x = lines.withColumn("_v", v).withColumn("_slice", ordered.slice_of("line_no"))
    pick = lambda p: F.when(F.col("_v").rlike(p), F.regexp_extract("_v", p, 1))
    day = F.coalesce(pick(r"^##\s+(\d{4}-\d{2}-\d{2})"), pick(r"^date:\s*(\d{4}-\d{2}-\d{2})"))
    x = ordered.carry_forward(x, keys, "_slice", ["line_no"], day, "_day", hot)
    x = ordered.carry_forward(x, keys, "_slice", ["line_no"], pick(r"^#{3,}\s*(\d{1,2}:\d{2})\b"), "_clock", hot)
    user, bot = r"^- (?:👤|🧑)\s+(.*)$", r"^- (?:🤖|🦾)\s+(.*)$"
    role = F.when(F.col("_v").rlike(user), "user").when(F.col("_v").rlike(bot), "assistant")
    x = x.withColumn("role", role).filter("role is not null")
    said = strip(F.when(F.col("role") == "user", F.regexp_extract("_v", user, 1)).otherwise(F.regexp_extract("_v", bot, 1)))
    inline = r"^\*\*(\d{1,2}:\d{2})\*\*:?\s*(.*)$"
    x = x.withColumn("_s", said)
    timed = F.col("_s").rlike(inline)
    clock = F.coalesce(F.when(timed, F.regexp_extract("_s", inline, 1)), F.col("_clock"), F.lit("00:00"))
    body = strip(F.when(timed, F.regexp_extract("_s", inline, 2)).otherwise(F.col("_s")))
    return x.select(
        *keys, "line_no", "role", body.alias("content"),
        F.when(F.col("_day").isNotNull(), F.concat("_day", F.lit("T"), F.lpad(clock, 5, "0"), F.lit(":00Z"))).alias("occurred_at"),
    )
