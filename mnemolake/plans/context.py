"""Context for a new session: latest valid note, pair tail, topics; recent record lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.operators import versions


def recent_records(records: DataFrame, id_col: str, as_of: Column, days: int = 14, limit: int = 20, max_chars: int = 60) -> DataFrame:
    """Records of the last days, newest id first, one clipped line each."""
    return (
        records.filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
        .orderBy(F.desc(id_col)).limit(limit)
        .select(id_col, F.concat(F.lit("- ["), "lang", F.lit("] "), F.substring("title", 1, max_chars)).alias("line"))
    )


def first_entries(entries: DataFrame, k: int, newest: bool = False) -> DataFrame:
    """The first (or newest) ``k`` entries of each topic by sequence."""
    order = F.desc("seq") if newest else F.col("seq")
    return entries.withColumn("rank", F.row_number().over(W.partitionBy("topic_id").orderBy(order))).filter(F.col("rank") <= k)


def snapshot_window(notes: DataFrame, started: Column, ended: Column, max_notes: int) -> DataFrame:
    """Notes whose event interval overlaps the window (created time when they have none),
    oldest first, joined; ``overflow`` says the cap cut something off.

    ``notes``: doc, note_id, ev_start, ev_end, created_at, content.
    """
    lo, hi = F.coalesce("ev_start", "created_at"), F.coalesce("ev_end", "created_at")
    n = notes.withColumns({"_lo": lo, "_hi": hi}).filter((F.col("_hi") >= started) & (F.col("_lo") <= ended))
    w = W.partitionBy("doc").orderBy(F.desc("_hi"), F.desc("note_id"))
    total = n.groupBy("doc").agg(F.count("*").alias("_n"))
    kept = n.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_notes)
    return (
        kept.groupBy("doc").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_hi", "note_id", "content"))), lambda s: s["content"]), "\n\n").alias("text"),
            F.count("*").alias("n_notes"),
        )
        .join(total, "doc").withColumn("overflow", F.col("_n") > F.col("n_notes")).drop("_n")
    )


def new_session_units(notes: DataFrame, invalidated: DataFrame, qa: DataFrame, topic_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Typed units per document store: newest valid note, the newest pairs after its
    range (uncovered count clamped to 5..10), top topics, keyword pairs. Parts may be missing.

    ``notes``: doc, note_id, content, hi. ``qa``: doc, qa_id. ``topic_hits`` and
    ``keyword_hits``: doc, ref, rank.
    """
    head = versions.note_head(notes, invalidated)
    bound = head.join(notes.select("doc", "note_id", "hi"), ["doc", "note_id"]).select("doc", "hi")
    after = qa.join(bound, "doc", "left").filter(F.col("hi").isNull() | (F.col("qa_id") > F.col("hi")))
    n = after.groupBy("doc").agg(F.least(F.lit(10), F.greatest(F.lit(5), F.count("*"))).alias("_take"))
    newest = qa.join(n, "doc", "left").withColumn(
        "rank", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("qa_id")))
    ).filter(F.col("rank") <= 10).filter(F.col("rank") <= F.coalesce("_take", F.lit(5)))
    unit = lambda d, kind, ref: d.select("doc", F.lit(kind).alias("unit"), F.col(ref).cast("string").alias("ref"), F.col("rank").cast("long").alias("rank"))
    return (
        unit(head.withColumn("rank", F.lit(1)), "note", "note_id")
        .unionByName(unit(newest, "tail", "qa_id"))
        .unionByName(unit(topic_hits, "topic", "ref"))
        .unionByName(unit(keyword_hits, "keyword", "ref"))
    )
