"""Idempotent writes: raw rows, pairs, memories, evaluation outputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions import ident as I
from mnemolake.functions.clean import strip
from mnemolake.functions.frames import side_by_side
from mnemolake.operators import dedupe

KIND_TAGS = {"curated": "user-curated", "legacy": "legacy-derived"}
KIND_CATEGORY = {"curated": "user_curated", "legacy": "legacy_derived"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    if _exists(spark, path):
        return spark.read.schema(like.schema).parquet(path)
    return spark.createDataFrame([], like.schema)


def append_raw(batch: DataFrame, path: str) -> DataFrame:
    """Append the rows that are new under both identity keys; returns the committed ids.

    Derived rows must be restricted to sessions whose raw rows are in the
    returned set, which is read back from storage after the write.
    """
    spark = batch.sparkSession
    existing = read_or_empty(spark, path, batch)
    new = dedupe.new_raw_rows(batch, existing)
    new.write.mode("append").partitionBy("host").parquet(path)
    return spark.read.schema(batch.schema).parquet(path).select("host", "session_id", "event_id")


def append_pairs(pairs: DataFrame, path: str, committed: DataFrame | None = None) -> None:
    """Pairs once per ``source_id``; only those whose question row is committed."""
    if committed is not None:
        key = committed.select("host", "session_id", F.col("event_id").alias("q_event_id"))
        pairs = pairs.join(key, ["host", "session_id", "q_event_id"], "left_semi")
    existing = read_or_empty(pairs.sparkSession, path, pairs)
    dedupe.missing_by_key(pairs, existing, ["source_id"]).write.mode("append").parquet(path)


def _pick(kind: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[kind]


def memory_rows(items: DataFrame, imported_at: Column) -> DataFrame:
    """Curated and legacy items as memories: ordered distinct tags with the kind tag,
    a provenance envelope with defaults, and the content id. Equal content collapses
    to the first item.
    """
    text = strip(F.coalesce("text", F.lit("")))
    m = items.filter(F.col("kind").isin("curated", "legacy")).withColumn("content", text).filter("content <> ''")
    defaults = F.map_filter(
        F.create_map(
            F.lit("kind"), F.col("kind"), F.lit("source_system"), F.col("source_system"),
            F.lit("source_ref"), F.col("source_ref"), F.lit("imported_at"), imported_at,
            F.lit("original_text_sha256"), F.when(F.col("kind") == "legacy", F.sha2("content", 256)),
            F.lit("kind_marker"), F.when(F.col("kind") == "curated", F.lit("user-curated")),
        ),
        lambda k, v: v.isNotNull(),
    )
    own = F.coalesce("provenance", F.create_map().cast("map<string,string>"))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k))
    m = m.withColumns({
        "category": F.coalesce("category", _pick(F.col("kind"), KIND_CATEGORY)),
        "title": F.coalesce("title", F.substring(F.coalesce("source_ref", F.lit("imported")), 1, 200)),
        "tags": F.array_distinct(
            F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(_pick(F.col("kind"), KIND_TAGS)))
        ),
        "provenance": F.map_concat(own, missing),
    })
    m = m.withColumn("memory_id", I.memory_id(F.col("category"), F.col("title"), F.col("content"), F.col("tags")))
    from mnemolake.operators import ordered

    return ordered.first_per_key(m, ["memory_id"], F.col("ord"))


def append_memories(items: DataFrame, imported_at: Column, path: str) -> None:
    rows = memory_rows(items, imported_at)
    existing = read_or_empty(items.sparkSession, path, rows)
    dedupe.missing_by_key(rows, existing, ["memory_id"]).write.mode("append").parquet(path)


def replace_version(sections: DataFrame, path: str) -> None:
    """Rewrite only the versions present in ``sections``."""
    sections.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def write_evaluation(results: DataFrame, latency: DataFrame, folder: str, settings: dict) -> DataFrame:
    """Results as JSON lines, latencies as CSV, and a one-row manifest of content hashes.

    The hash of a table is the hash of its sorted-free sum of row hashes, so it
    does not depend on file layout.
    """
    results.write.mode("overwrite").json(f"{folder}/results")
    latency.write.mode("overwrite").option("header", True).csv(f"{folder}/latency")
    digest = lambda d: d.agg(
        F.sha2(F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")).cast("string"), 256).alias("h"), F.count("*").alias("n")
    )
    a, b = digest(results), digest(latency)
    manifest = side_by_side(
        a.select(F.col("h").alias("results_sha"), F.col("n").alias("results_rows")),
        b.select(F.col("h").alias("latency_sha"), F.col("n").alias("latency_rows")),
    ).withColumn("settings", F.lit(json.dumps(settings, sort_keys=True)))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest
