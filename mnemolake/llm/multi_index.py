"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: principal directions of a bounded sample, turned by a rotation that is
learned to lose least in the signs (alternating signs and orthogonal Procrustes). So that
the largest inner product is the smallest angle for vectors of any length, a
coordinate that evens out lengths is appended first.

Codes are split into substrings, each with an index of its own (bucket offsets into a permutation).
Two codes within Hamming radius r agree within r // m bits in one of m substrings (within
one bit less from substring r % m + 1 on), so probing all buckets that near to the query's substrings
retrieves every code within the radius. Retrieved rows are ranked by exact inner products of the original vectors.

Rows and queries are dealt into blocks of bounded size and each pair of blocks is one task group, so
neither side is ever collected and no bucket of the index can be hot. The radius is a parameter; without it,
the exact neighbours of a few sample queries, found by one pass over all rows, set it so
that ``keep`` of them lie within it. A query that retrieves fewer than k rows in all blocks together is
asked again of all rows in a second, exact pass. Every row is indexed.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; ties go to the smaller id; rows with a query's own id are no candidates;
repeated rows count each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.blocks import QUERIES_PER_BLOCK, ROWS_PER_BLOCK, best, finite_vectors, is_query, matrix, usual_dims
from mnemolake.llm.tables import parts_for, table
from mnemolake.session import cut

SAMPLE_ROWS = 8192
SAMPLE_QUERIES = 64
KEEP = 0.98


@dataclass
class Coder:
    """Projection of length-evened vectors to bits."""

    longest: float
    turn: np.ndarray

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        even = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.longest**2 - (vectors**2).sum(axis=1)))
        bits = np.hstack([vectors, even[:, None]]) @ self.turn > 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def learn_coder(sample: np.ndarray, longest: float, n_bits: int = 64, rounds: int = 30, seed: int = 2) -> Coder:
    """Principal directions and the rotation that brings their projections nearest to signs."""
    even = np.sqrt(np.maximum(0, longest**2 - (sample**2).sum(axis=1)))
    x = np.hstack([sample, even[:, None]])
    n_bits = min(n_bits, sample.shape[1])
    _, directions = np.linalg.eigh(x.T @ x)
    v = directions[:, ::-1][:, :n_bits]
    z = x @ v
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_bits, n_bits)))
    for _ in range(rounds):
        signs = np.sign(z @ turn)
        left, _, right = np.linalg.svd(z.T @ signs)
        turn = left @ right
    return Coder(longest, v @ turn)


class MultiIndex:
    """Substring indexes over the codes of one block."""

    def __init__(self, codes: np.ndarray, n_bits: int):
        self.codes, self.n_bits = codes, n_bits
        m = max(1, round(n_bits / max(4, np.log2(max(2, len(codes))))))
        edges = np.linspace(0, n_bits, m + 1).round().astype(int)
        self.parts = []
        for low, high in zip(edges[:-1], edges[1:]):
            width = int(high - low)
            value = ((codes >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))])
            near = np.argsort(np.bitwise_count(np.arange(1 << width)), kind="stable")
            sizes = np.searchsorted(np.bitwise_count(near), np.arange(width + 1), side="right")
            self.parts.append((np.uint64(low), np.uint64((1 << width) - 1), np.argsort(value, kind="stable"), offsets, near, sizes))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows of all codes within the Hamming radius."""
        share, extra = divmod(radius, len(self.parts))
        seen = np.zeros(len(self.codes), bool)
        for i, (low, mask, rows, offsets, near, sizes) in enumerate(self.parts):
            most = share if i <= extra else share - 1
            if most < 0:
                continue
            probe = near[: sizes[min(most, len(sizes) - 1)]] ^ int((code >> low) & mask)
            start, count = offsets[probe], offsets[probe + 1] - offsets[probe]
            held = count > 0
            start, count = start[held], count[held]
            at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            seen[rows[at]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors get equal scores."""
    return (vectors * query).sum(axis=1)


def _hits(query_id: int, ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    if len(ids) > 4 * k:
        # ties at the border stay in
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= border], scores[scores >= border]
    order = np.lexsort((ids, -scores))[:k]
    return [(query_id, i, s) for i, s in zip(ids[order].tolist(), scores[order].tolist())]


def _result(rows: list[tuple]) -> dict[str, pa.Array]:
    q, v, s = zip(*rows) if rows else ((), (), ())
    return {"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())}


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, radius: int | None = None, keep: float = KEEP
) -> DataFrame:
    """The k rows of ``vectors(id, vec)`` with the largest inner products for each row of ``queries(id, vec)``, as found: query_id, rank, vec_id, score."""
    dims = usual_dims(vectors)
    own = lambda df: df.filter((F.size("vec") == dims) & F.exists("vec", lambda x: x != 0))
    rows, asked = own(vectors), own(queries)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    stats = rows.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    n_queries = asked.count()
    if not stats["n"] or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def sample(df: DataFrame, most: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        share = min(1 << 30, (1 << 30) * 2 * most // n)
        got = df.filter(F.pmod(F.xxhash64(F.lit(2), "id", "vec"), F.lit(1 << 30)) < share).limit(most).collect()
        got = got or df.limit(most).collect()
        return np.array([r["id"] for r in got], np.int64), np.array([r["vec"] for r in got], np.float64).reshape(len(got), dims)

    coder = learn_coder(sample(rows, SAMPLE_ROWS, stats["n"])[1], stats["longest"])
    if radius is None:
        radius = _calibrated(rows, coder, *sample(asked, SAMPLE_QUERIES, n_queries), k, keep)
    probed = cut(_block_hits(rows, stats["n"], asked, n_queries, k, dims, coder, radius))
    short = cut(short_of(probed, asked, k))
    n_short = short.count()
    if not n_short:
        return best(probed, k)
    whole = _block_hits(rows, stats["n"], short, n_short, k, dims)
    served = probed.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
    return best(served.unionByName(whole), k)


def short_of(hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows of ``asked(id, vec)`` for which all blocks together hold fewer than k of ``hits(query_id, vec_id, score)``."""
    # repeated query rows get hits each
    need = asked.groupBy("id").agg((F.count("*") * k).alias("need"))
    held = hits.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("held"))
    served = need.join(held, "id").filter("held >= need").select("id")
    return asked.join(served, "id", "left_anti")


def _block_hits(
    rows: DataFrame, n_rows: int, asked: DataFrame, n_asked: int, k: int, dims: int, coder: Coder | None = None, radius: int = 0
) -> DataFrame:
    """At most k hits of every query in every block of rows, probed within the radius or, without a coder, compared with all rows."""
    n_row, n_query = parts_for(n_rows, ROWS_PER_BLOCK), parts_for(n_asked, QUERIES_PER_BLOCK)
    salt = F.xxhash64("id", "vec", F.monotonically_increasing_id())
    blocks = lambda df, n, m, key: df.withColumn("b", F.pmod(salt, F.lit(n))).select(
        "id", "vec", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), key)).alias("cell")
    )
    left = blocks(rows, n_row, n_query, lambda q: F.col("b") * n_query + q)
    right = blocks(asked, n_query, n_row, lambda r: r.cast("long") * n_query + F.col("b"))

    def search(key: tuple, block: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if block.num_rows and queries.num_rows:
            ids, x = block.column("id").to_numpy(), matrix(block.column("vec"), dims)
            q = matrix(queries.column("vec"), dims)
            index = MultiIndex(coder.codes(x), coder.turn.shape[1]) if coder else None
            codes = coder.codes(q, query=True) if coder else [None] * len(q)
            for query_id, vec, code in zip(queries.column("id").to_pylist(), q, codes):
                at = index.within(code, radius) if index else np.arange(len(ids))
                at = at[ids[at] != query_id]
                found += _hits(query_id, ids[at], exact_scores(x[at], vec), k)
        return pa.table(_result(found))

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, "query_id long, vec_id long, score double")


def _calibrated(rows: DataFrame, coder: Coder, ids: np.ndarray, queries: np.ndarray, k: int, keep: float) -> int:
    """Radius that holds ``keep`` of the exact k nearest of the sample queries; one pass over all rows."""
    dims, codes = queries.shape[1], coder.codes(queries, query=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
            far = coder.codes(x)
            scores = queries @ x.T
            out = []
            for q in range(len(ids)):
                s = np.where(own == ids[q], -np.inf, scores[q])
                top = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                out += [(int(q), float(v), int(d)) for v, d in zip(s[top], np.bitwise_count(far[top] ^ codes[q]))]
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.float64()), pa.array(c, pa.int32())], names=["q", "score", "far"])

    hits = rows.select("id", "vec").mapInArrow(scan, "q int, score double, far int").filter(F.col("score") > float("-inf"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "far")
    near = hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("far").collect()
    far = sorted(r["far"] for r in near)
    return far[min(len(far) - 1, int(np.ceil(keep * len(far))) - 1)] if far else 0


def op2_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, among all vectors."""
    vectors = finite_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.filter(is_query()))
