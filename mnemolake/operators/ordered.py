"""Ordered scans per key: running sum and maximum, lag, carry-forward, row number.

When the largest key is small enough for one task (checked by a count of the
keys), a scan is a plain window and neighbouring scans share one shuffle. When
one key may hold a large share of all rows, a scan runs in three steps instead:
a local window inside ``(key, slice)``, one summary row per slice, and a window
over the summaries of a key. Then only summaries of a key meet in one task.

``slice_col`` must follow the order: every row of a lower slice sorts before
every row of a higher one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.session import cut

SLICE_ROWS = 65_536
PLAIN_WINDOW_ROWS = 1_000_000


def slice_of(order_col: str, rows: int | None = None) -> Column:
    """Slice number for a dense per-key ordinal."""
    return F.floor(F.col(order_col) / F.lit(rows or SLICE_ROWS)).cast("long")


def is_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether some key holds more rows than one task should sort. Reads the keys only."""
    top = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (top or 0) > PLAIN_WINDOW_ROWS


def _plain(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def _cumulative(keys, order):
    return _plain(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)


def _before(keys, slice_col):
    return W.partitionBy(*keys).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], value: Column, out: str, hot: bool
) -> DataFrame:
    """Inclusive running sum of ``value`` per key."""
    if not hot:
        return df.withColumn(out, F.sum(value).over(_cumulative(keys, order)))
    df = cut(df.withColumn("_scan_v", value))
    totals = df.groupBy(*keys, slice_col).agg(F.sum("_scan_v").alias("_tot"))
    carry = totals.select(
        *keys, slice_col, F.coalesce(F.sum("_tot").over(_before(keys, slice_col)), F.lit(0)).alias("_scan_carry")
    )
    return (
        df.withColumn("_scan_loc", F.sum("_scan_v").over(_cumulative([*keys, slice_col], order)))
        .join(carry, [*keys, slice_col])
        .withColumn(out, F.col("_scan_loc") + F.col("_scan_carry"))
        .drop("_scan_v", "_scan_loc", "_scan_carry")
    )


def running_max(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], value: Column, out: str, hot: bool
) -> DataFrame:
    """Inclusive running maximum of ``value`` per key (nulls ignored)."""
    if not hot:
        return df.withColumn(out, F.max(value).over(_cumulative(keys, order)))
    df = cut(df.withColumn("_scan_v", value))
    tops = df.groupBy(*keys, slice_col).agg(F.max("_scan_v").alias("_top"))
    carry = tops.select(*keys, slice_col, F.max("_top").over(_before(keys, slice_col)).alias("_scan_carry"))
    return (
        df.withColumn("_scan_loc", F.max("_scan_v").over(_cumulative([*keys, slice_col], order)))
        .join(carry, [*keys, slice_col])
        .withColumn(out, F.greatest("_scan_loc", "_scan_carry"))
        .drop("_scan_v", "_scan_loc", "_scan_carry")
    )


def row_number(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], out: str, hot: bool
) -> DataFrame:
    if not hot:
        return df.withColumn(out, F.row_number().over(_plain(keys, order)).cast("long"))
    return running_sum(df, keys, slice_col, order, F.lit(1).cast("long"), out, hot)


def lag(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], value: Column, out: str, hot: bool
) -> DataFrame:
    """Value of the previous row of the key (null at the first row)."""
    if not hot:
        return df.withColumn(out, F.lag(value).over(_plain(keys, order)))
    df = cut(df.withColumn("_scan_v", F.struct(value.alias("x"))))
    ends = df.groupBy(*keys, slice_col).agg(F.max_by("_scan_v", F.struct(*order)).alias("_end"))
    carry = ends.select(*keys, slice_col, F.lag("_end").over(_plain(keys, [slice_col])).alias("_scan_before"))
    return (
        df.withColumn("_scan_loc", F.lag("_scan_v").over(_plain([*keys, slice_col], order)))
        .join(carry, [*keys, slice_col])
        .withColumn(out, F.coalesce("_scan_loc", "_scan_before").getField("x"))
        .drop("_scan_v", "_scan_loc", "_scan_before")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], value: Column, out: str, hot: bool
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of the key."""
    if not hot:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(_cumulative(keys, order)))
    df = cut(df.withColumn("_scan_v", value))
    ends = df.groupBy(*keys, slice_col).agg(
        F.max_by("_scan_v", F.when(F.col("_scan_v").isNotNull(), F.struct(*order))).alias("_end")
    )
    carry = ends.select(
        *keys, slice_col, F.last("_end", ignorenulls=True).over(_before(keys, slice_col)).alias("_scan_prior")
    )
    return (
        df.withColumn("_scan_loc", F.last("_scan_v", ignorenulls=True).over(_cumulative([*keys, slice_col], order)))
        .join(carry, [*keys, slice_col])
        .withColumn(out, F.coalesce("_scan_loc", "_scan_prior"))
        .drop("_scan_v", "_scan_loc", "_scan_prior")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the smallest by ``order``; copies combine map-side."""
    cols = df.columns
    return (
        df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.min_by(F.struct(*cols), order).alias("_row"))
        .select("_row.*")
    )
