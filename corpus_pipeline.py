"""Corpus pipeline: language ID, line dedup, near-duplicate join, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the
shared checkpoint folder and reads again as the next stage's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import langid, linechunks, packing, secrets, shingles
from mnemolake.llm.tables import ready, table
from mnemolake.session import cut, ensure_checkpoint_dir

#: Documents below this mean probability of their best language are of no language that was learned; short clean ones score 0.35 and more.
LEAST_LANG_SCORE = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` in the columns of ``docs``, with n_chars following the text where it changed."""
    if "n_chars" not in docs.columns:
        return changed.select(*docs.columns)
    size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return changed.withColumn("n_chars", F.when(F.col("_changed"), size).otherwise(F.col("n_chars"))).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; those without letters or of no clear language go.

    Without any label there is nothing to judge by, and all documents stay. With more than four languages the threshold
    falls with the share that an even guess would get.
    """
    ready(spark)
    labelled = docs.select("doc_id", "text", "lang").filter(~langid.held_out())
    model = langid.learn(labelled)
    if model is None:
        return docs
    found = langid.identify(docs, model, tuple(docs.columns))
    least = min(LEAST_LANG_SCORE, 4 * LEAST_LANG_SCORE / len(model.labels))
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)
    return found.filter(kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated content-defined chunks of lines and, by an exact pass, every other run of two or more lines that stands earlier, in another document or the same one; documents of which no letter is left go."""
    ready(spark)
    out = linechunks.remove_chunks_and_passages(docs, count_col="_removed").withColumn("_changed", F.col("_removed") > 0)
    return _with_text(docs, out.filter(~F.col("_changed") | (F.trim("text") != "")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id.

    Rows are told apart by their place in the table, so different texts under one id are different documents, and of
    equal rows, also under a null id, one stays. Documents without words form no group.
    """
    ready(spark)
    row = "_row"
    while row in docs.columns:
        row += "_"
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    found = shingles.jaccard_components(placed.select(F.col(row).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    groups = found.filter("n_shingles > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias("_in"))
    # most documents are the only one of their group: only members of larger groups are looked up
    grouped = groups.groupBy("_in").agg(F.count("*").alias("_n")).filter("_n > 1")
    members = cut(groups.join(grouped.select("_in"), "_in"))
    named = members.join(placed.select(row, F.col("doc_id").alias("_id")), row)
    first = named.groupBy("_in").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col(row)))[row].alias(row))
    later = members.select(row).join(first.select(row), row, "left_anti")
    return placed.join(later, row, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays."""
    ready(spark)
    out = secrets.redact(docs.withColumn("_before", F.col("text")))
    return _with_text(docs, out.withColumn("_changed", ~F.col("text").eqNullSafe(F.col("_before"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every kept document's tokens into sequences of at most 4096."""
    ready(spark)
    return packing.pack_documents(docs, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The language model and the tokenizer have no SQL form; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None
