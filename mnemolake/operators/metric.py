"""Metric balls: rows dealt to their nearest pivot, windows by the radius, and bounds inside a cell.

A bounded number of rows serve as pivots. Every row lives in the cell of its nearest pivot; a cell is known by its pivot, its
covering radius and its row count. A row within ``r`` of some row of another cell is never farther from
that cell's pivot than the covering radius and ``r``, nor farther than ``r`` behind the plane
between the two pivots, so it visits only the cells where both hold. Inside a cell rows are sorted along the
cell's main direction; a row is a place t on it and the norm s of what is left, and
|x - y|^2 >= (t_x - t_y)^2 + (s_x - s_y)^2 excludes whole tiles before any product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.session import cut

#: Rows that a cell holds on average, while there are no more cells than ``MOST_CELLS`` (whose pivots every task knows).
CELL_ROWS = 32
MOST_CELLS = 1024
#: Rows that pivots are picked from.
DRAWN_ROWS = 8192
#: Rows of a cell, or visitors of one, that a task takes at once.
BLOCK_ROWS = 2048
TILE = 128
#: Rows that a task measures against all pivots at once.
PART_ROWS = 512
#: Relative rounding of a distance that comes from scalar products.
ROUNDING = 1e-6


def as_matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dims)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows of x, rows of y)."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0.0))


@dataclass
class Cells:
    """Pivots with their covering radii and row counts."""

    pivots: np.ndarray
    radii: np.ndarray
    counts: np.ndarray

    @property
    def dims(self) -> int:
        return self.pivots.shape[1]

    def __len__(self) -> int:
        return len(self.pivots)

    def blocks(self) -> np.ndarray:
        """Blocks of each cell's own rows."""
        return np.maximum(1, -(-self.counts // BLOCK_ROWS))

    def least(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """(rows, cells): no row of the cell is nearer to x than this; ``home`` is the cell of x."""
        far = distances(x, self.pivots)
        size = np.sqrt((x * x).sum(axis=1)).max(initial=0.0) + np.sqrt((self.pivots * self.pivots).sum(axis=1)).max(initial=0.0)
        ball = far - self.radii[None, :]
        between = distances(self.pivots, self.pivots)[home]
        own = far[np.arange(len(x)), home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (far * far - (own * own)[:, None]) / (2.0 * between), 0.0)
        # a plane between near pivots multiplies the rounding of the squares
        with np.errstate(divide="ignore"):
            plane -= np.where(between > 0, 1e-14 * size * size / between, 0.0)
        return np.maximum(np.maximum(ball, plane), 0.0) - ROUNDING * size


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PART_ROWS`` rows, so that a task's tables of rows and pivots stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def block_of(id_col: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(id_col), blocks).cast("int")


def spread(drawn: np.ndarray, count: int) -> np.ndarray:
    """Pivots among the drawn rows: half as they come, so that crowded regions have many, half the farthest from all before, so that none is far from all."""
    count = min(count, len(drawn))
    picks = list(range((count + 1) // 2))
    nearest = distances(drawn, drawn[picks]).min(axis=1)
    while len(picks) < count:
        nearest[picks] = -1.0
        far = int(nearest.argmax())
        picks.append(far)
        nearest = np.minimum(nearest, distances(drawn, drawn[far : far + 1])[:, 0])
    return drawn[picks]


def deal(rows: DataFrame, cell_rows: int | None = None) -> tuple[DataFrame, Cells | None]:
    """``rows(id, vec, ...)``, different vectors of one length, with cell, block and apart (distance to the pivot); no cells without rows."""
    n = rows.count()
    count = min(MOST_CELLS, max(1, n // (cell_rows or CELL_ROWS)))
    # a fixed pseudo-random choice of bounded size
    drawn = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(max(count, DRAWN_ROWS)).select("vec").collect()
    if not drawn:
        return rows, None
    pivots = spread(np.array([r["vec"] for r in drawn], np.float64), count)
    dims, names = pivots.shape[1], rows.columns
    at = names.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            far = distances(as_matrix(batch.column(at), dims), pivots)
            cell = far.argmin(axis=1)
            columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "cell", "apart"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = cut(rows.mapInArrow(run, f"{fields}, cell int, apart double"))
    radii, counts = np.zeros(count), np.zeros(count, np.int64)
    for r in dealt.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():  # a row per cell
        radii[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    cells = Cells(pivots, radii, counts)
    return dealt.withColumn("block", block_of("id", per_cell(cells.blocks(), F.col("cell")))), cells


def per_cell(values: np.ndarray, cell: Column) -> Column:
    """The value of a cell, for whole numbers of which most are equal."""
    values = values.astype(int)
    usual = int(np.bincount(values).argmax()) if len(values) else 0
    odd = [x for i in np.flatnonzero(values != usual).tolist() for x in (F.lit(i), F.lit(int(values[i])))]
    return F.coalesce(F.try_element_at(F.create_map(*odd), cell), F.lit(usual)) if odd else F.lit(usual)


def visits(dealt: DataFrame, cells: Cells, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``dealt`` with ``to``, the cells that a row visits; ``wanted(least, home)`` says for (rows, cells) whether it must."""
    names = dealt.columns
    vec, home = names.index("vec"), names.index("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            own = batch.column(home).to_numpy()
            go = wanted(cells.least(as_matrix(batch.column(vec), cells.dims), own), own)
            offsets = np.concatenate([[0], np.cumsum(go.sum(axis=1))]).astype(np.int32)
            to = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(go)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, to], names=[*names, "to"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, f"{fields}, to array<int>")


def _places(x: np.ndarray, middle: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = x - middle
    t = gap @ axis
    return t, np.sqrt(np.maximum((gap * gap).sum(axis=1) - t * t, 0.0))


def _main_axis(x: np.ndarray) -> np.ndarray:
    gap = x - x.mean(axis=0)
    axis = gap[int((gap * gap).sum(axis=1).argmax())]
    for _ in range(3):
        axis = gap.T @ (gap @ axis)
        size = math.sqrt(float(axis @ axis))
        if size <= 0:
            return np.eye(1, x.shape[1])[0]
        axis = axis / size
    return axis


def close_tiles(a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index tiles (of a, of b) that hold all pairs within ``radius``."""
    if not len(a) or not len(b):
        return
    axis, middle = _main_axis(a), a.mean(axis=0)
    sides = []
    for x in (a, b):
        t, s = _places(x, middle, axis)
        order = np.argsort(t, kind="stable")
        tiles = [order[i : i + TILE] for i in range(0, len(order), TILE)]
        sides.append((tiles, np.array([(t[k].min(), t[k].max(), s[k].min(), s[k].max()) for k in tiles])))
    (left, lo), (right, hi) = sides
    size = np.abs(lo).max() + np.abs(hi).max()
    for k, (t0, t1, s0, s1) in zip(left, lo):
        along = np.maximum(0.0, np.maximum(hi[:, 0] - t1, t0 - hi[:, 1]))
        aside = np.maximum(0.0, np.maximum(hi[:, 2] - s1, s0 - hi[:, 3]))
        for j in np.flatnonzero(np.hypot(along, aside) <= radius + ROUNDING * size).tolist():
            yield k, right[j]
