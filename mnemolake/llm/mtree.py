"""Exact top-k inner products by best-first search in M-trees.

Components become integers floor(scale * x). The inner product is no metric, so
every row gets one more coordinate that makes all rows equally long, and every query a zero there: then
distance squared = |query|^2 + longest^2 - 2 * score, and the nearest rows are the highest scores.

Root level, across the cluster: rows go to the nearest of a bounded number of pivots (drawn from
a sample, which only shapes the tree); a pivot with many rows is split by a hash. Each
part is an M-tree with a covering radius. A query starts with a bound from the exact
scores of the sample and is sent only to the parts that the triangle inequality leaves open.

Inside a part: paged nodes with covering radii and distances to their parent. Best first, a node is opened
while its lower bound can beat the k-th score; entries whose stored parent distance already excludes them
cost no distance computation. Scores are exact integers (products of doubles, of 64-bit or of Python integers, by the largest component); bounds get
a margin against rounding, so results are exact. Scores that may not fit a long are decimals; the query gives null for one that no long holds.

Parts and query blocks have bounded sizes whatever the data (equal rows split evenly).
Defined cases: vectors that are null, of another length than most, hold null or non-finite components, or
a component beyond 2**57 after scaling take no part (no decimal holds their products); zero vectors do;
ties go to the smaller id; rows with a query's own id are no candidates; repeated rows count each;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.blocks import QUERIES_PER_BLOCK, ROWS_PER_BLOCK, best, finite_vectors, is_query, matrix, usual_dims
from mnemolake.llm.tables import parts_for, table

SCALE = 64
LARGEST = 2**57
#: Share of the squared lengths that rounding may add to a squared distance.
SLACK = 1e-13
PAGE = 512
FANOUT = 16
MOST_PIVOTS = 256
SAMPLE_ROWS = 4096


def _even(x: np.ndarray, longest2: float) -> np.ndarray:
    """The coordinate that makes rows equally long."""
    return np.sqrt(np.maximum(0.0, longest2 - (x * x).sum(axis=1)))


def _distances(x: np.ndarray, even: np.ndarray, center: np.ndarray, center_even: float) -> np.ndarray:
    d = x - center
    return np.sqrt((d * d).sum(axis=1) + (even - center_even) ** 2)


def _reach(score: int, lengths: float) -> float:
    """The distance at which a score lies; ``lengths`` is |query|^2 + longest^2."""
    return float(np.sqrt(max(0.0, lengths - 2.0 * float(score)) + SLACK * lengths))


def _products(x: np.ndarray, y: np.ndarray, size: float) -> np.ndarray:
    """Exact inner products of integer rows held as doubles; ``size`` bounds them and their partial sums."""
    if size < 2**53:
        return x @ y
    if size < 2**62:
        return x.astype(np.int64) @ y.astype(np.int64)
    return x.astype(np.int64).astype(object) @ y.astype(np.int64).astype(object)


def _best_first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class Node:
    """A page: either rows (``at`` is the place of the first, they lie together) or routing entries; each entry has its distance to the page's own center."""

    __slots__ = ("at", "apart", "centers", "evens", "radii", "children")

    def __init__(self) -> None:
        self.at = self.apart = self.centers = self.evens = self.radii = self.children = None


class MTree:
    """M-tree over integer rows ``x`` (held as doubles) with ids; ``size`` bounds the inner products with queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest2: float, page: int = PAGE, fanout: int = FANOUT, size: float | None = None):
        self.ids, self.x, self.longest2 = ids, x, longest2
        self.even = _even(x, longest2)
        self.page, self.fanout = page, fanout
        self.size = float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] if size is None else size
        self.computed = 0
        middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.center, self.center_even = middle, float(self.even.mean()) if len(x) else 0.0
        self._pages: list[np.ndarray] = []
        self._placed = 0
        self.root, self.radius = self._build(np.arange(len(x)), self.center, self.center_even)
        # rows of a page lie together, so that a page is read as a slice
        order = np.concatenate(self._pages)
        self.ids, self.x, self.even = ids[order], np.ascontiguousarray(x[order]), self.even[order]

    def _build(self, at: np.ndarray, center: np.ndarray, even: float) -> tuple[Node, float]:
        node = Node()
        apart = _distances(self.x[at], self.even[at], center, even)
        radius = float(apart.max(initial=0.0))
        if len(at) <= self.page:
            order = np.argsort(apart, kind="stable")
            node.at, node.apart = self._placed, apart[order]
            self._pages.append(at[order])
            self._placed += len(at)
            return node, radius
        wide = min(self.fanout, -(-len(at) // self.page))
        picks = at[np.linspace(0, len(at) - 1, wide).astype(int)]
        centers, evens = self.x[picks], self.even[picks]
        far = np.stack([_distances(self.x[at], self.even[at], c, e) for c, e in zip(centers, evens)])
        nearest = far.argmin(axis=0)
        if np.bincount(nearest, minlength=wide).max() > 0.9 * len(at):
            nearest = np.arange(len(at)) % wide
        parts = [(i, at[nearest == i]) for i in range(wide) if (nearest == i).any()]
        kept = [i for i, _ in parts]
        built = [self._build(own, centers[i], float(evens[i])) for i, own in parts]
        node.centers, node.evens = centers[kept], evens[kept]
        node.radii = np.array([r for _, r in built])
        node.children = [n for n, _ in built]
        node.apart = _distances(node.centers, node.evens, center, even)
        return node, radius

    def scores(self, begin: int, end: int, query: np.ndarray) -> np.ndarray:
        self.computed += end - begin
        return _products(self.x[begin:end], query, self.size)

    def top(self, query_id: int, query: np.ndarray, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows (those below ``bound`` may be missing), best first."""
        lengths = float((query * query).sum()) + self.longest2
        whole = object if self.size >= 2**62 else np.int64
        ids, scores = np.zeros(0, np.int64), np.zeros(0, whole)
        least = -(10**38) if whole is object else -(2**63)
        least = least if bound is None else bound
        limit = np.inf if bound is None else _reach(bound, lengths)
        margin = 1e-9 * (1 + np.sqrt(lengths))
        first = float(_distances(query[None], np.zeros(1), self.center, self.center_even)[0])
        tick = count()
        heap = [(max(0.0, first - self.radius), next(tick), self.root, first)]
        while heap:
            low, _, node, here = heapq.heappop(heap)
            if low > limit + margin:
                break
            # the stored distance to the parent excludes entries before their own distance is computed
            if node.children is None:
                a, b = np.searchsorted(node.apart, [here - limit - margin, here + limit + margin])
                if a == b:
                    continue
                found = self.scores(node.at + a, node.at + b, query)
                good = np.flatnonzero(found >= least)
                if not len(good):
                    continue
                at = good + (node.at + a)
                keep = self.ids[at] != query_id
                ids, scores = np.concatenate([ids, self.ids[at[keep]]]), np.concatenate([scores, found[good[keep]].astype(whole)])
                order = _best_first(ids, scores, k)
                ids, scores = ids[order], scores[order]
                if len(scores) == k and scores[-1] > least:
                    least = int(scores[-1])
                    limit = min(limit, _reach(least, lengths))
            else:
                open_ = np.flatnonzero(np.abs(node.apart - here) - node.radii <= limit + margin)
                far = _distances(node.centers[open_], node.evens[open_], query, 0.0)
                self.computed += len(open_)
                for i, d in zip(open_.tolist(), far.tolist()):
                    lower = max(0.0, d - node.radii[i])
                    if lower <= limit + margin:
                        heapq.heappush(heap, (lower, next(tick), node.children[i], d))
        return ids, scores


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, vec) with floor(scale * x), as doubles that hold integers exactly."""
    # from 2**53 on doubles are integers
    floor = lambda x: F.when(F.abs(x) < 2**53, F.floor(x).cast("double")).otherwise(x)
    whole = vectors.withColumn("vec", F.transform("vec", lambda x: floor(x * scale)))
    return whole.filter(F.forall("vec", lambda x: F.abs(x) <= LARGEST))


def top_scores(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k rows of ``vectors(id, vec)`` with the highest inner products for each row of ``queries(id, vec)``: query_id, rank, vec_id, score."""
    dims = usual_dims(vectors)
    rows, asked = (df.filter(F.size("vec") == dims) for df in (vectors, queries))
    length2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    most = F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("most")
    stats, asked_stats = rows.agg(F.count("*").alias("n"), F.max(length2).alias("longest2"), most).first(), asked.agg(F.count("*").alias("n"), most).first()
    n_queries = asked_stats["n"]
    if not stats["n"] or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, longest2 = stats["n"], stats["longest2"]
    size = float(dims * stats["most"] * asked_stats["most"])
    score_type, score_name = (pa.decimal128(38, 0), "decimal(38,0)") if size >= 2**62 else (pa.int64(), "long")
    share = min(1 << 30, (1 << 30) * 2 * SAMPLE_ROWS // n)
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(4), "id", "vec"), F.lit(1 << 30)) < share).limit(SAMPLE_ROWS).collect() or rows.limit(SAMPLE_ROWS).collect()
    drawn = sorted((r["id"], tuple(r["vec"])) for r in drawn)
    sample_ids, sample = np.array([i for i, _ in drawn], np.int64), np.array([v for _, v in drawn], np.float64).reshape(len(drawn), dims)
    n_pivots = min(MOST_PIVOTS, len(sample), parts_for(n, ROWS_PER_BLOCK))
    pivots = sample[np.linspace(0, len(sample) - 1, n_pivots).astype(int)]
    pivot_even = _even(pivots, longest2)

    def to_pivots(x: np.ndarray, even: np.ndarray) -> np.ndarray:
        return np.stack([_distances(x, even, p, e) for p, e in zip(pivots, pivot_even)], axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            far = to_pivots(x, _even(x, longest2))
            pivot = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(x)), pivot])], names=["id", "vec", "pivot", "apart"]
            )

    assigned = rows.select("id", "vec").mapInArrow(assign, "id long, vec array<double>, pivot int, apart double")
    # at most MOST_PIVOTS rows: the routing entries of the root
    routes = assigned.groupBy("pivot").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
    radii, splits = np.full(n_pivots, -np.inf), np.zeros(n_pivots, np.int64)
    for r in routes:
        radii[r["pivot"]], splits[r["pivot"]] = r["radius"], parts_for(r["n"], ROWS_PER_BLOCK)
    first_part = np.concatenate([[0], np.cumsum(splits)])
    n_query = parts_for(n_queries, QUERIES_PER_BLOCK)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per query and open part, with the bound that the sample gives."""
        for batch in batches:
            ids, q = batch.column(0).to_pylist(), matrix(batch.column(1), dims)
            far = to_pivots(q, np.zeros(len(q)))
            scores = _products(q, sample.T, size)
            out: list[tuple] = []
            for i, query_id in enumerate(ids):
                own = scores[i][sample_ids != query_id]
                bound = int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else None
                lengths = float((q[i] * q[i]).sum()) + longest2
                limit = np.inf if bound is None else _reach(bound, lengths)
                margin = 1e-9 * (1 + np.sqrt(lengths))
                for p in np.flatnonzero(far[i] - radii <= limit + margin).tolist():
                    out += [(i, part, bound) for part in range(int(first_part[p]), int(first_part[p + 1]))]
            at, part, bound = zip(*out) if out else ((), (), ())
            picked = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(part, pa.int64()), pa.array(bound, score_type)], names=["id", "vec", "part", "bound"])

    asked_of = asked.select("id", "vec").mapInArrow(route, f"id long, vec array<double>, part long, bound {score_name}").select(
        "id", "vec", "bound", (F.col("part") * n_query + F.pmod(F.xxhash64("id", "vec"), F.lit(n_query))).alias("cell")
    )
    starts, wide = (F.array(*[F.lit(int(v)) for v in values]) for values in (first_part[:-1], splits))
    sub = F.pmod(F.xxhash64("id", "vec", F.monotonically_increasing_id()), F.greatest(F.get(wide, F.col("pivot")), F.lit(1)))
    placed = assigned.withColumn("part", (F.get(starts, F.col("pivot")) + sub).cast("long")).select(
        "id", "vec", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_query - 1)), lambda j: F.col("part") * n_query + j)).alias("cell")
    )

    def search(key: tuple, block: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if block.num_rows and queries.num_rows:
            tree = MTree(block.column("id").to_numpy(), matrix(block.column("vec"), dims), longest2, size=size)
            q = matrix(queries.column("vec"), dims)
            for query_id, vec, bound in zip(queries.column("id").to_pylist(), q, queries.column("bound").to_pylist()):
                ids, scores = tree.top(query_id, vec, k, None if bound is None else int(bound))
                found += [(query_id, v, s) for v, s in zip(ids.tolist(), scores.tolist())]
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, score_type)})

    hits = placed.groupBy("cell").cogroup(asked_of.groupBy("cell")).applyInArrow(search, f"query_id long, vec_id long, score {score_name}")
    return best(hits, k)


def op4_mtree_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer scores for every vector whose id is divisible by 20, among all vectors."""
    vectors = integer_vectors(finite_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = top_scores(vectors, vectors.filter(is_query()))
    return found.withColumn("score", F.col("score").try_cast("long"))


# the table's vectors have one length and moderate components
ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
