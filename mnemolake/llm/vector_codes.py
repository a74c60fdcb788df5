"""Vector code compression: product codebooks whose nearest entries are found with LAESA pivots.

Components become integers floor(scale * x), vectors are cut into equal parts, and every part
position has its own codebook. Its pivots are some of the first entries, fixed for all rounds. The distance of each part to each
pivot of its position is computed once and stored with the row in the checkpoint folder. A round then needs
new distances only between pivots and entries: |d(part, pivot) - d(entry, pivot)| is a lower bound
of d(part, entry), so entries are tried in the order of their largest bound, and as soon as that bound
exceeds the best exact distance the rest cannot be nearer. Exact distances are those of integers.

Tasks add up parts per entry themselves; a round shuffles at most one row per task, position and entry, and the driver holds
codebooks only (positions x entries x width numbers). No row moves until the errors of equal labels are
summed; labels with a large share of all rows are joined by a broadcast of at most ``HOT_SHARE`` rows.

Defined cases: rows with a null or empty vector, or with null or non-finite components, drop, as do vectors of another
length than the most frequent one (the smaller of equals); a length that the parts do not divide is filled up with zeros; repeated rows count
each, and among rows of one id the order of the vectors decides who starts a codebook; a null id is carried and comes last; fewer rows than entries give
smaller codebooks; integers of any size are exact, and an error that no long can hold is null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.blocks import matrix
from mnemolake.llm.tables import table
from mnemolake.session import cut

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
#: Parts whose bounds are worked on at once.
SLAB = 4096
#: Sums of wide integers travel in pieces of so many bits.
LIMB_BITS = 30
#: A label above one such share of all rows is joined apart, so there are fewer of them than this.
HOT_SHARE = 4096


@dataclass
class Layout:
    """How vectors of one length are cut, and whether their integers need more than 64 bits somewhere."""

    dims: int
    parts: int
    scale: int
    wide: bool
    limbs: int

    @property
    def width(self) -> int:
        return -(-self.dims // self.parts)

    def integers(self, vecs: np.ndarray) -> np.ndarray:
        """(rows, parts, width) of floor(scale * x): 64-bit where all sums of squares fit, else Python integers."""
        if self.wide:
            whole = np.array([[_floor(x, self.scale) for x in row] for row in vecs.tolist()], dtype=object).reshape(vecs.shape)
        else:
            whole = np.floor(vecs * self.scale).astype(np.int64)
        out = np.zeros((len(vecs), self.parts * self.width), whole.dtype)
        if self.wide:
            out[:] = 0
        out[:, : self.dims] = whole
        return out.reshape(len(vecs), self.parts, self.width)


@dataclass
class Codebooks:
    """Entries and pivots per part position."""

    layout: Layout
    entries: list[np.ndarray]
    pivots: list[np.ndarray]

    def sha256(self) -> str:
        numbers = (str(int(x)) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def _floor(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale


def usable_rows(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, vec, label) of the rows whose vector has finite components only."""
    vec = F.col(vec_col)
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return rows.filter(vec.isNotNull() & (F.size(vec) > 0) & good).select(F.col(id_col).alias("vec_id"), vec.alias("vec"), label.alias("label"))


def layout_of(rows: DataFrame, parts: int = PARTS, scale: int = SCALE) -> Layout | None:
    """Cut of the most frequent vector length; None without rows."""
    size = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    found = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(size).alias("top")).orderBy(F.desc("n"), "d").first()
    if found is None:
        return None
    top = int(found["top"]) * scale + scale
    wide = found["d"] * (2 * top) ** 2 >= 2**62 or found["n"] * top >= 2**62
    return Layout(found["d"], parts, scale, wide, -(-(top.bit_length() + 1) // LIMB_BITS) if wide else 1)


def _double(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def _doubles(x: np.ndarray) -> np.ndarray:
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([_double(v) for v in x.ravel().tolist()], np.float64).reshape(x.shape)


def root_distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows, points) in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = _doubles(parts)[:, None, :] - _doubles(points)[None, :, :]
        return np.sqrt((gap * gap).sum(axis=2))


def pick_pivots(book: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: each next pivot has the largest sum of distances to those before."""
    picks = [0]
    total = np.zeros(len(book))
    while len(picks) < min(count, len(book)):
        total = np.nan_to_num(total + root_distances(book, book[picks[-1:]])[:, 0], nan=0.0, posinf=1e300)
        order = np.argsort(-total, kind="stable")
        picks.append(next(int(i) for i in order if int(i) not in picks))
    return book[picks]


def nearest(parts: np.ndarray, stored: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties to the lower index) and squared distance per part, and how many exact distances were computed.

    ``stored``: the parts' distances to the pivots, rounded to 32 bits.
    """
    n = len(parts)
    of_entries = root_distances(book, pivots)
    at, best = np.zeros(n, np.int64), np.zeros(n, parts.dtype)
    evaluated = 0
    for a in range(0, n, SLAB):
        own, far = parts[a : a + SLAB], stored[a : a + SLAB].astype(np.float64)
        low = np.zeros((len(own), len(book)))
        with np.errstate(invalid="ignore", over="ignore"):
            for p in range(len(pivots)):
                x, e = far[:, p, None], of_entries[None, :, p]
                # the margin covers the rounding of both distances
                np.maximum(low, np.abs(x - e) - 1e-6 * (x + e), out=low)
        low[~np.isfinite(low)] = 0.0
        order = np.argsort(low, axis=1)
        low = np.take_along_axis(low, order, axis=1)
        entry = order[:, 0].copy()
        gap = own - book[entry]
        found = (gap * gap).sum(axis=1)
        evaluated += len(own)
        open_ = np.arange(len(own))
        for step in range(1, len(book)):
            reach = np.sqrt(_doubles(found[open_])) * (1 + 1e-12)
            open_ = open_[low[open_, step] <= reach]
            if not len(open_):
                break
            tried = order[open_, step]
            gap = own[open_] - book[tried]
            d = (gap * gap).sum(axis=1)
            evaluated += len(open_)
            better = (d < found[open_]) | ((d == found[open_]) & (tried < entry[open_]))
            hit = open_[better.astype(bool)]
            found[hit], entry[hit] = d[better.astype(bool)], tried[better.astype(bool)]
        at[a : a + SLAB], best[a : a + SLAB] = entry, found
    return at, best, evaluated


def _vectors(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return matrix(batch.column(batch.schema.get_field_index(name)), dims)


def with_pivot_distances(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` and the distances of their parts to the pivots of their positions, once for all rounds."""
    layout, pivots = books.layout, books.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = layout.integers(_vectors(batch, "vec", layout.dims))
            far = np.stack([root_distances(parts[:, p], pivots[p]) for p in range(layout.parts)], axis=1)
            with np.errstate(over="ignore"):
                flat = far.astype(np.float32).reshape(-1)
            each = layout.parts * far.shape[2]
            stored = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, each, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, stored], names=["vec_id", "vec", "label", "stored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, stored array<float>")


def _assignments(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers (rows, parts, width), nearest entries and squared distances (rows, parts)."""
    layout = books.layout
    parts = layout.integers(_vectors(batch, "vec", layout.dims))
    n_pivots = len(books.pivots[0])
    stored = _vectors(batch, "stored", layout.parts * n_pivots).reshape(len(parts), layout.parts, n_pivots)
    found = [nearest(parts[:, p], stored[:, p], books.entries[p], books.pivots[p])[:2] for p in range(layout.parts)]
    return parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _limbs(value: int, count: int) -> list[int]:
    """A signed integer in ``count`` pieces, low ones first; sums of pieces are pieces of the sum."""
    mask = (1 << LIMB_BITS) - 1
    return [(value >> (LIMB_BITS * i)) & mask for i in range(count - 1)] + [value >> (LIMB_BITS * (count - 1))]


def entry_sums(stored: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, n and the sums of the parts assigned to the entry, one row per part and used entry."""
    layout = books.layout
    width, limbs, n_entries = layout.width, layout.limbs, len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((layout.parts, n_entries), np.int64)
        sums = np.zeros((layout.parts, n_entries, width), object if layout.wide else np.int64)
        for batch in batches:
            parts, entries, _ = _assignments(batch, books)
            for p in range(layout.parts):
                at = entries[:, p]
                counts[p] += np.bincount(at, minlength=n_entries)
                np.add.at(sums[p], at, parts[:, p])
        used = np.argwhere(counts)
        pieces = [[v for x in sums[p, e] for v in _limbs(int(x), limbs)] for p, e in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0], pa.int64()), pa.array(used[:, 1], pa.int64()), pa.array(counts[counts > 0], pa.int64()), pa.array(pieces, pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    local = stored.mapInArrow(run, "part long, entry long, n long, sums array<long>")
    return local.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width * limbs)])


def _moved(books: Codebooks, sums: DataFrame) -> list[np.ndarray]:
    """Entries after a round: componentwise floor of the mean; unused entries stay."""
    layout, moved = books.layout, [book.copy() for book in books.entries]
    # one row per part position and entry, whatever the table holds
    for r in sums.collect():
        for d in range(layout.width):
            total = sum(r[f"s{d * layout.limbs + i}"] << (LIMB_BITS * i) for i in range(layout.limbs))
            moved[r["part"]][r["entry"], d] = total // r["n"]
    return moved


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks | None]:
    """The rows (vec_id, vec, label) with stored pivot distances, and codebooks after ``rounds`` rounds; no codebooks without rows."""
    layout = layout_of(rows, parts, scale)
    if layout is None:
        return rows, None
    rows = rows.filter(F.size("vec") == layout.dims)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vec").select("vec").limit(entries).collect()
    start = layout.integers(np.array([r["vec"] for r in first], np.float64))
    books = Codebooks(layout, [start[:, p].copy() for p in range(parts)], [pick_pivots(start[:, p], pivots) for p in range(parts)])
    stored = cut(with_pivot_distances(rows, books))
    for _ in range(rounds):
        books = Codebooks(layout, _moved(books, entry_sums(stored, books)), books.pivots)
    return stored, books


def encode(stored: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, entries, apart = _assignments(batch, books)
            codes = ["".join(f"{e:02x}" for e in row) for row in entries.tolist()]
            errors = [e if e < 2**63 else None for e in map(int, apart.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    id_type, label_type = (stored.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return stored.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def with_label_error(coded: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """``coded`` with label_error, the error summed over rows of an equal label (nulls together); null where no long holds it."""
    coded = cut(coded)
    most = coded.count() // hot_share
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    totals = cut(totals)
    # at most hot_share labels have more rows than that
    hot = F.broadcast(totals.filter(F.col("_n") > most).withColumn("_hot", F.lit(True)).drop("_n"))
    marked = coded.join(hot, coded["label"].eqNullSafe(hot["_label"]), "left").drop("_label")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot", "label_error")
    rare = totals.filter(F.col("_n") <= most).drop("_n")
    rest = cold.join(rare, cold["label"].eqNullSafe(rare["_label"]))
    columns = [*coded.columns, "label_error"]
    return marked.filter("_hot").select(*columns).unionByName(rest.select(*columns))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector under codebooks of 64 entries for 16 parts, learned in two rounds."""
    stored, books = learn(usable_rows(table(spark, sf_dir, "embeddings")))
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    found = with_label_error(encode(stored, books))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """Entries c{i} from entries c{i-1}: assignments, then floored means; unused entries stay."""
    return f"""a{i} AS (SELECT p.part, p.vec_id, min(((p.x[1] - c.x[1])**2 + (p.x[2] - c.x[2])**2 + (p.x[3] - c.x[3])**2 + (p.x[4] - c.x[4])**2)::BIGINT * 64 + c.entry) AS best
  FROM p JOIN c{i - 1} c USING (part) GROUP BY ALL),
s{i} AS (SELECT part, best % 64 AS entry, count(*) AS n, sum(p.x[1]) AS s1, sum(p.x[2]) AS s2, sum(p.x[3]) AS s3, sum(p.x[4]) AS s4 FROM a{i} JOIN p USING (part, vec_id) GROUP BY ALL),
c{i} AS (SELECT c.part, c.entry, CASE WHEN n IS NULL THEN c.x ELSE [floor(s1 / n)::BIGINT, floor(s2 / n)::BIGINT, floor(s3 / n)::BIGINT, floor(s4 / n)::BIGINT] END AS x FROM c{i - 1} c LEFT JOIN s{i} USING (part, entry))"""


# the table's vectors have one length, 64, moderate components and ids of their own
ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, part, e[4 * part + 1 : 4 * part + 4] AS x FROM v, (SELECT unnest(range(16)) AS part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, entry, x FROM f JOIN p USING (vec_id)),
{_round_sql(1)},
{_round_sql(2)},
a3 AS (SELECT p.part, p.vec_id, min(((p.x[1] - c.x[1])**2 + (p.x[2] - c.x[2])**2 + (p.x[3] - c.x[3])**2 + (p.x[4] - c.x[4])**2)::BIGINT * 64 + c.entry) AS best
  FROM p JOIN c2 c USING (part) GROUP BY ALL),
r AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a3 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h
"""
