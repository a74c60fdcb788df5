"""State of the embedding index: canonical texts, worklists, ledgers, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.clean import strip


def canonical_text(table: str) -> Column:
    """The exact text whose vector a row of ``table`` must carry."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    if table == "qa_pairs":
        return F.when(e("answer") != "", F.concat(e("question"), F.lit("\n"), e("answer"))).otherwise(e("question"))
    if table == "topics":
        whole = F.concat(
            e("title"), F.lit(". "), e("summary"), F.lit(" "), F.substring(e("body"), 1, 800), F.lit(" "),
            F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "),
        )
        return F.substring(strip(whole), 1, 1000)
    if table == "conversation_stream":
        return F.substring(e("content"), 1, 2000)
    if table == "observation_notes":
        return e("content")
    if table == "paragraphs":
        segment = e("version").startswith("e1_seg_") & e("section").startswith("E1/")
        return F.when(segment, F.substring(e("content"), 1, 2000)).otherwise(
            F.concat(e("section"), F.lit(". "), F.substring(e("content"), 1, 1500))
        )
    raise KeyError(table)


def unexplained_nulls(rows: DataFrame, failures: DataFrame, table: str, id_expr: Column, vec_col: str = "vec") -> DataFrame:
    """Rows without a vector that no unresolved failure explains."""
    f = failures.filter((F.col("entity_table") == table) & F.col("resolved_at").isNull()).select("entity_id").distinct()
    missing = rows.filter(F.col(vec_col).isNull()).withColumn("entity_id", id_expr.cast("string"))
    return missing.join(f, "entity_id", "left_anti")


def backfill_worklist(
    rows: DataFrame, failures: DataFrame, table: str, id_col: str, text: Column, limit: int,
    max_chars: int | None = None, include_permanent: bool = False, vec_col: str = "vec",
) -> DataFrame:
    """Rows worth embedding now: no vector, some text, no unresolved permanent failure, in size."""
    w = rows.filter(F.col(vec_col).isNull()).withColumn("_x", F.coalesce(text, F.lit(""))).filter(F.trim("_x") != "")
    if max_chars is not None:
        w = w.filter(F.length("_x") <= max_chars)
    if not include_permanent:
        dead = failures.filter(
            (F.col("entity_table") == table) & ~F.col("retryable") & F.col("resolved_at").isNull()
        ).select(F.col("entity_id").alias("_e")).distinct()
        w = w.withColumn("_e", F.col(id_col).cast("string")).join(dead, "_e", "left_anti").drop("_e")
    return w.orderBy(id_col).limit(limit).drop("_x")


def orphan_chunks(chunks: DataFrame, parents: DataFrame, parent: str, parent_id: str) -> DataFrame:
    """J25."""
    return chunks.join(parents.select(F.col(parent_id).alias(parent)), parent, "left_anti")


def chunk_integrity(chunks: DataFrame, parents: DataFrame, parent: str, parent_id: str) -> DataFrame:
    """One row of counts that must all but the first two be zero."""
    per_key = chunks.groupBy(parent, "chunk_index").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("vec").isNull()).alias("_null"),
        F.count_if((F.col("source_start") < 0) | (F.col("source_end") <= F.col("source_start"))).alias("_bad"),
    )
    per_parent = per_key.groupBy(parent).agg(
        F.sum("_n").alias("_n"), F.sum("_null").alias("_null"), F.sum("_bad").alias("_bad"), F.count_if(F.col("_n") > 1).alias("_dup")
    )
    known = parents.select(F.col(parent_id).alias(parent)).distinct().withColumn("_known", F.lit(1))
    return per_parent.join(known, parent, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("child_rows"),
        F.count("*").alias("distinct_parents"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("null_vectors"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_offsets"),
        F.coalesce(F.sum("_dup"), F.lit(0)).alias("duplicate_keys"),
        F.count_if(F.col("_known").isNull()).alias("parents_missing"),
    )


def null_debt(rows: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Vector and answer debt of a pair table, recent window and total."""
    recent = F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")
    null_vec = F.col("vec").isNull()
    empty = strip(F.coalesce("answer", F.lit(""))) == ""
    return rows.agg(
        F.count_if(recent).alias("recent_qa"),
        F.count_if(recent & ~null_vec).alias("recent_with_vector"),
        F.count_if(recent & null_vec).alias("recent_embedding_null"),
        F.count_if(recent & empty).alias("recent_empty_answer"),
        F.count_if(null_vec).alias("embedding_null_total"),
        F.min(F.when(null_vec, F.col("created_at"))).alias("oldest_null"),
        F.max(F.when(null_vec, F.col("created_at"))).alias("newest_null"),
        F.count_if(empty).alias("empty_answer_total"),
        F.max("created_at").alias("last_write"),
    )


def failure_ledger(events: DataFrame) -> DataFrame:
    """Failure and success events folded to one row per (entity, phase).

    ``events``: entity_table, entity_id, phase, at, outcome (failed, resolved,
    entity_resolved), error_class, retryable, attempts. Attempts add up, the
    first failure stays, the newest failure gives class and flag. A row is
    resolved by a later success of its phase or of its whole entity, unless it
    failed again after that.
    """
    key = ["entity_table", "entity_id"]
    failed = events.filter(F.col("outcome") == "failed").groupBy(*key, "phase").agg(
        F.sum("attempts").alias("attempts"),
        F.min("at").alias("first_failed_at"),
        F.max("at").alias("last_failed_at"),
        F.max_by(F.struct("error_class", "retryable"), "at").alias("_last"),
    )
    by_phase = events.filter(F.col("outcome") == "resolved").groupBy(*key, "phase").agg(F.max("at").alias("_p"))
    by_entity = events.filter(F.col("outcome") == "entity_resolved").groupBy(*key).agg(F.max("at").alias("_e"))
    j = failed.join(by_phase, [*key, "phase"], "left").join(by_entity, key, "left")
    later = F.greatest("_p", "_e")
    return j.select(
        *key, "phase", "attempts", "first_failed_at", "last_failed_at",
        F.col("_last.error_class").alias("error_class"), F.col("_last.retryable").alias("retryable"),
        F.when(later > F.col("last_failed_at"), later).alias("resolved_at"),
    )


def failure_summary(ledger: DataFrame) -> DataFrame:
    """A15."""
    return ledger.filter(F.col("resolved_at").isNull()).groupBy("entity_table", "error_class", "retryable").agg(
        F.count("*").alias("n"), F.sum("attempts").alias("attempts")
    )


def fingerprints(rows: DataFrame, current: str) -> DataFrame:
    """Rows per model fingerprint, and whether they belong to the current one."""
    return rows.groupBy(F.coalesce("embed_model", F.lit("")).alias("embed_model")).agg(F.count("*").alias("n")).withColumn(
        "dirty", F.col("embed_model") != current
    )


def duplicate_sections(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("version", "section").agg(F.count("*").alias("n")).filter("n > 1")


def complete_parents(planned: DataFrame, embedded: DataFrame) -> DataFrame:
    """Parents whose every planned chunk has a vector.

    ``planned``: (parent, chunk_index). ``embedded``: (parent, chunk_index, vec).
    """
    j = planned.join(embedded.filter(F.col("vec").isNotNull()).select("parent", "chunk_index", F.lit(1).alias("_ok")), ["parent", "chunk_index"], "left")
    return j.groupBy("parent").agg(F.count("*").alias("planned"), F.count("_ok").alias("embedded")).withColumn(
        "complete", F.col("planned") == F.col("embedded")
    )


def stale_chunks(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored chunk indexes the current plan no longer has."""
    return stored.select("parent", "chunk_index").join(planned.select("parent", "chunk_index"), ["parent", "chunk_index"], "left_anti")
