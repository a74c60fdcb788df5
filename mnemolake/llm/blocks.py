"""Searches of a query set against all rows, in pairs of bounded blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 2048


def finite_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) as long and doubles; rows with a null id, a null vector, or null or non-finite components take no part."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col(id_col).isNotNull() & (F.size(vec) > 0) & good).select(
        F.col(id_col).cast("long").alias("id"), vec.alias("vec")
    )


def usual_dims(vectors: DataFrame) -> int:
    """The most frequent vector length (the smaller of equals); rows of another length cannot be compared with it. 0: no row."""
    found = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dims)


def is_query(id_col: str = "id") -> Column:
    return F.col(id_col) % 20 == 0


def best(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
