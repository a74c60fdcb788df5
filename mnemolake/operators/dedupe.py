"""Identity, idempotent inserts and exact deduplication.

First-row choices aggregate with ``min_by`` so that a large group of copies
combines map-side; no task sees all copies of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.clean import none_if_blank, strip
from mnemolake.operators import ordered


def assign_event_ids(messages: DataFrame) -> DataFrame:
    """Rows without a native id get the ordinal among such rows of their session."""
    native = strip(none_if_blank(F.col("event_id")))
    m = messages.withColumn("_native", native).withColumn("_slice", ordered.slice_of("ord"))
    missing = F.when(F.col("_native").isNull(), 1).otherwise(0).cast("long")
    m = ordered.running_sum(m, ["host", "session_id"], "_slice", ["ord"], missing, "_n", ordered.is_hot(messages, ["host", "session_id"]))
    derived = F.concat_ws(":", F.lit("derived"), "host", "session_id", F.col("_n").cast("string"))
    return m.withColumn("event_id", F.coalesce("_native", derived)).withColumn(
        "identity_kind", F.when(F.col("_native").isNull(), "derived").otherwise("native")
    ).drop("_native", "_slice", "_n")


ID_KEY = ["host", "session_id", "event_id"]


def content_key() -> list[Column]:
    return [F.col("host"), F.col("session_id"), F.col("role"), F.col("occurred_at"), F.md5("content")]


def new_raw_rows(batch: DataFrame, existing: DataFrame, order: str = "ord") -> DataFrame:
    """Reject a row whose id key or content key is taken; the first row in order wins.

    Two passes: id key first, then content key among the survivors. Rows with
    no timestamp never match by content (a null never equals another).
    """
    batch = batch.withColumn("_h", F.md5("content"))
    existing = existing.withColumn("_h", F.md5("content"))
    ckey = ["host", "session_id", "role", "occurred_at", "_h"]
    fresh = ordered.first_per_key(batch, ID_KEY, F.col(order))
    fresh = fresh.join(existing.select(*ID_KEY), ID_KEY, "left_anti")
    timed = ordered.first_per_key(fresh.filter(F.col("occurred_at").isNotNull()), ckey, F.col(order))
    timed = timed.join(existing.select(*ckey), ckey, "left_anti")
    untimed = fresh.filter(F.col("occurred_at").isNull())
    return timed.select(batch.columns).unionByName(untimed.select(batch.columns)).drop("_h")


def new_raw_rows_without_host(batch: DataFrame, existing: DataFrame, order: str = "ord") -> DataFrame:
    """(session, role, time) decides; rows with no time always insert."""
    key = ["session_id", "role", "occurred_at"]
    timed = ordered.first_per_key(batch.filter(F.col("occurred_at").isNotNull()), key, F.col(order))
    timed = timed.join(existing.select(*key), key, "left_anti")
    return timed.select(batch.columns).unionByName(batch.filter(F.col("occurred_at").isNull()))


def existing_ids(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """J3."""
    return ids.join(table.select(key), key, "left_semi")


def new_content(batch: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Exact (question, answer) repeats drop, inside the batch and against the store.

    Both columns join as they are; their hash only keeps the shuffle key short.
    """
    digest = F.sha2(F.concat_ws("\x00", "question", "answer"), 256)
    batch, existing = batch.withColumn("_h", digest), existing.withColumn("_h", digest)
    key = ["_h", "question", "answer"]
    first = ordered.first_per_key(batch, key, F.col(order))
    return first.join(existing.select(*key), key, "left_anti").select(*[c for c in batch.columns if c != "_h"])


def missing_by_key(batch: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    return batch.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")


def title_dedup(items: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Items marked ``kept`` when no smaller id has their title (blank titles all stay)."""
    key = [*scope, "title"]
    firsts = items.filter(F.coalesce("title", F.lit("")) != "").groupBy(*key).agg(F.min("id").alias("_first"))
    return (
        items.join(firsts, key, "left")
        .withColumn("kept", F.coalesce(F.col("id") == F.col("_first"), F.lit(True)))
        .drop("_first")
    )
