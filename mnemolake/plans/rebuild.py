"""Bounded rebuild: ordered batches under a cost budget, resumable from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators import sessions
from mnemolake.session import cut
from mnemolake.sources.sinks import read_or_empty


def run(rows: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, batch_rows: int, budget: float) -> DataFrame:
    """Process the batches that fit the budget after the largest id already written.

    ``rows``: id, cost and whatever ``process`` needs. A batch runs while the cost
    of the batches before it is under the budget, so the last one may overshoot.
    Output is partitioned by batch; an interrupted run leaves whole batches or
    none. Returns the batch table with its ``runs`` flag.
    """
    spark = rows.sparkSession
    done = read_or_empty(spark, f"{out}/cursor", rows.select(F.col("id").alias("last_id"))).agg(F.max("last_id").alias("m")).first()["m"]
    cursor = -1 if done is None else done
    batches = cut(sessions.bounded_rebuild(rows, batch_rows, budget, cursor))
    go = batches.filter("runs")
    end = go.agg(F.max("last_id").alias("m")).first()["m"]
    if end is None:
        return batches
    todo = rows.filter((F.col("id") > cursor) & (F.col("id") <= end))
    process(todo).write.mode("append").parquet(f"{out}/data")
    go.agg(F.max("last_id").alias("last_id")).write.mode("append").parquet(f"{out}/cursor")
    return batches
