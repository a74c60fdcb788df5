"""Micro-batch steps for ``foreachBatch``: receipts, upserts, triggers, cursors.

Each step writes under the batch id it is given, so a replayed batch overwrites
its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.clean import strip
from mnemolake.operators import dedupe, sessions
from mnemolake.sources.sinks import read_or_empty

KEY = ["host", "session_id", "event_id"]


def receipts(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Accepted, duplicate or rejected for every event of a batch."""
    bad = (strip(F.coalesce("event_id", F.lit(""))) == "") | (strip(F.coalesce("content", F.lit(""))) == "")
    first = batch.filter(~bad).groupBy(*KEY).agg(F.min("ord").alias("_first"))
    known = store.select(*KEY).distinct().withColumn("_known", F.lit(1))
    j = batch.join(first, KEY, "left").join(known, KEY, "left")
    return j.withColumn(
        "receipt",
        F.when(bad, "rejected").when(F.col("_known").isNotNull() | (F.col("ord") != F.col("_first")), "duplicate").otherwise("accepted"),
    ).drop("_first", "_known")


def receipt_step(path: str):
    """A ``foreachBatch`` function that writes the receipts of every batch, judged against the batches before it.

    ``path`` holds one folder of receipts per batch; a replayed batch sees the earlier ones only and overwrites its own.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        given = batch.select(*KEY, "ord", "content")
        like = given.select(*KEY, "ord").withColumns({"receipt": F.lit(""), "b": F.lit(0)})
        earlier = read_or_empty(batch.sparkSession, path, like).filter((F.col("b") < batch_id) & (F.col("receipt") == "accepted"))
        receipts(given, earlier).drop("content").write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    return step


def latest_pairs(outputs: DataFrame) -> DataFrame:
    """Fold the processor's rows into one row per pair: the pair, then its late texts in order."""
    qa = outputs.filter(F.col("output") == "qa")
    late = outputs.filter(F.col("output") == "late").groupBy(F.col("source_id").alias("_sid")).agg(
        F.array_sort(F.collect_set(F.struct(F.get("event_ids", F.lit(0)).alias("e"), F.col("answer").alias("a")))).alias("_l")
    )
    j = qa.join(late, F.col("source_id") == F.col("_sid"), "left")
    extra = F.array_join(F.transform("_l", lambda s: s["a"]), "\n")
    return j.select(
        "host", "session_id", "source_id", "q_event_id", "question",
        F.when(F.col("_l").isNotNull(), F.concat_ws("\n", "answer", extra)).otherwise(F.col("answer")).alias("answer"),
    )


def trigger_step(folder: str, known_sessions: DataFrame, now, **thresholds):
    """A ``foreachBatch`` function that adds each batch to the backlog and writes the decision.

    The batch is reduced to one row per session before it meets the stored
    backlog. Version ``n`` of the backlog follows from version ``n - 1``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        add = sessions.unobserved(batch, -1)
        before = read_or_empty(spark, f"{folder}/backlog/v={batch_id - 1}", add)
        total = add.unionByName(before).groupBy("session_id").agg(
            F.sum("unobs_count").alias("unobs_count"), F.sum("unobs_chars").alias("unobs_chars"), F.max("last_qa_ts").alias("last_qa_ts")
        )
        total.write.mode("overwrite").parquet(f"{folder}/backlog/v={batch_id}")
        stored = spark.read.parquet(f"{folder}/backlog/v={batch_id}")
        decision = sessions.trigger_decision(stored, known_sessions, now, F.lit(None).cast("timestamp"), **thresholds)
        decision.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/decisions/batch={batch_id}")

    return step


def raw_step(path: str):
    """A ``foreachBatch`` function that appends new raw rows, one folder per batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = read_or_empty(spark, path, batch.withColumn("b", F.lit(0)))
        earlier = stored.filter(F.col("b") < batch_id).select(*batch.columns)
        dedupe.new_raw_rows(batch, earlier).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    return step

