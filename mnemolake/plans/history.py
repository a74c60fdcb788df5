"""History import: items -> raw store -> pairs -> report, idempotent end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators import dedupe, pairing
from mnemolake.session import cut
from mnemolake.sources import readers, sinks


def import_items(table: DataFrame, raw_path: str, pairs_path: str) -> DataFrame:
    """Append new raw rows and their pairs; returns the report (what, n).

    Identities are assigned before anything is written, so a raw row and its pair
    agree on the event id, and a second run adds nothing. Pairs are derived from
    the kept rows and written only for questions whose raw row is in the store.
    """
    items = cut(dedupe.assign_event_ids(readers.kept(table)))
    before = sinks.read_or_empty(items.sparkSession, raw_path, items).count()
    committed = sinks.append_raw(items, raw_path)
    unique = items.dropDuplicates(["host", "session_id", "event_id"])
    pairs = pairing.qa_pairs(unique)
    stored = sinks.read_or_empty(items.sparkSession, pairs_path, pairs).count()
    sinks.append_pairs(pairs, pairs_path, committed)
    spark = items.sparkSession
    counts = spark.createDataFrame(
        [("raw_new", committed.count() - before), ("pairs_new", spark.read.parquet(pairs_path).count() - stored)], "what string, n long"
    )
    return counts.unionByName(readers.skips(table).select(F.col("skip_reason").alias("what"), "n"))
