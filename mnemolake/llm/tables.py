"""Table access, key-safe helpers and sizing shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.session import ensure_checkpoint_dir, prepare


#: Rows of a batch that a Python function receives, so that batches of long texts stay small.
BATCH_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """Session options of these operators, and the shared folder for cuts."""
    prepare(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read through Spark whatever store the folder is in."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total bytes of a text column: one number, from a scan of that column only."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` units ``total`` units make."""
    return max(least, math.ceil(total / each))


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


_in_use: dict[str, dict] = {}


def keep_only(name: str, held: dict) -> None:
    """Empty the tables that other operators keep in this worker when ``name`` starts to use its own, so that a pipeline's stages do not add up."""
    if name not in _in_use:
        for other in _in_use.values():
            other.clear()
        _in_use.clear()
        _in_use[name] = held
