"""Density clusters, the most stable branches of the single-linkage hierarchy, noise left out.

With one neighbour as density (the setting of the job that this stands for) the mutual reachability distance of two items
is their Euclidean distance. Three steps:

1. **Edges that span.** Many items whose balls would all meet are searched by products of blocks (``_tree_by_search``). Other items live in metric balls (``metric``). Every block of a ball gives the minimum spanning tree of its own
   items. Pivots are items, so the widest edge inside two balls and the widest one on the way between their pivots
   bound what can still join them: an item meets only balls that may hold something nearer, and
   a pair of blocks gives the minimum spanning forest of its cross edges. By the cycle rule all edges of the minimum spanning
   tree are among these.
2. **Growth.** Edges join groups in the order (distance, i, j). A group carries its size, and from ``min_cluster_size`` on its open cluster with
   the mass gathered so far (the sum of 1 / distance over items that fall out) and the best total of the clusters inside, so
   hierarchy, stabilities and the choice between a cluster and its parts come out of one pass. More than
   ``BAND_EDGES`` edges are worked off in bands of distance, each connected part of a band in a task of
   its own, with groups of earlier bands as single nodes.
3. **Labels.** The topmost chosen cluster above an item, by pointer doubling over the clusters.

Exact copies are one node of their number. Distances are rounded to six digits; 1 / distance is at most 1e6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.operators import metric, vectors
from mnemolake.session import cut, stored

DIGITS = 6
LEAST = 1e-6
#: From so many rows, and if balls leave more than one pair in so many, all pairs are searched by products.
SEARCH_ROWS, SEARCH_SHARE = 32_768, 8
#: Nearest rows that a search returns for a row, rows of a block, and rows and columns that a task multiplies at once.
NEAR, SEARCH_BLOCK_ROWS = 8, 131_072
SEARCH_TILE_ROWS, SEARCH_TILE_COLS = 1024, 2048
#: Columns of which the best bounds a row from the start, groups or clusters whose links the driver follows by itself.
BOUND_COLS, KNOWN_ROWS = 16, 200_000
#: Edges that one task sorts and joins.
BAND_EDGES = 1_000_000
#: So many times that number make a band, if no connected part of it has more than one task takes.
WIDE_BAND = 16


def _rounded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round(metric.distances(x, y), DIGITS)


def spanning_forest(rows_of, n: int, ids: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (row, row, w) of the minimum spanning forest in the order (w, i, j); ``rows_of(v)`` gives the weights of row v, inf: no edge.

    Prim's rule, so that only one row of weights is needed at a time. ``ids`` must be sorted.
    """
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    rank, out_of = np.arange(n, dtype=np.int64), np.ones(n, bool)
    pair = np.zeros(n, np.int64)
    edges, v = [], 0
    for _ in range(n - 1):
        out_of[v] = False
        w = rows_of(v)
        own = np.minimum(rank, v) * n + np.maximum(rank, v)
        better = out_of & ((w < best) | ((w == best) & np.isfinite(w) & (own < pair)))
        best[better], source[better], pair[better] = w[better], v, own[better]
        reach = np.where(out_of, best, np.inf)
        low = reach.min()
        if np.isfinite(low):
            tied = np.flatnonzero(reach == low)
            v = int(tied[pair[tied].argmin()])
            a, b = sorted((int(source[v]), v))
            edges.append((a, b, float(low)))
        else:
            v = int(np.flatnonzero(out_of)[0])
    return edges


def _frame(ids: np.ndarray, edges: list[tuple[int, int, float]]) -> pd.DataFrame:
    a, b, w = zip(*edges) if edges else ((), (), ())
    return pd.DataFrame({"i": ids[list(a)], "j": ids[list(b)], "w": np.array(w, np.float64)})


def _way_between(points: np.ndarray) -> np.ndarray:
    """For every pair of points the widest edge on the way between them that keeps it smallest."""
    n = len(points)
    far = _rounded(points, points)
    widest = np.zeros((n, n))
    seen = [0]
    best, source = far[0].copy(), np.zeros(n, np.int64)
    best[0] = np.inf
    for _ in range(n - 1):
        v = int(best.argmin())
        w = float(best[v])
        to = np.maximum(widest[source[v], seen], w)
        widest[v, seen], widest[seen, v] = to, to
        seen.append(v)
        best = np.where(far[v] < best, far[v], best)
        nearer = best == far[v]
        source = np.where(nearer, v, source)
        best[seen] = np.inf
    return widest


def _nearest(x: np.ndarray, xg: np.ndarray, y: np.ndarray, yg: np.ndarray, k: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """(distances, rows of y), each (rows of x, k): the nearest rows of y in another group, ties to the earlier row; inf, -1: no more.

    ``alone``: no group has two rows. Single precision leaves out most; distances of what is left are taken in doubles.
    """
    best, of = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)
    middle = y.mean(axis=0)
    a, b = x - middle, y - middle
    size = math.sqrt(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max())) or 1.0
    a, b = (a / size).astype(np.float32), (b / size).astype(np.float32)
    slack, step = 4 * (1e-6 + 2e-7 * x.shape[1]), 2 * 10.0**-DIGITS / size
    # a product of these rows is minus the squared distance
    one = lambda m: np.ones((len(m), 1), np.float32)
    square = lambda m: (m * m).sum(axis=1, keepdims=True)
    a, b = np.hstack([2 * a, -square(a), -one(a)]), np.hstack([b, one(b), square(b)])
    for at in range(0, len(x), SEARCH_TILE_ROWS):
        end = min(at + SEARCH_TILE_ROWS, len(x))
        part, group, least = a[at:end], xg[at:end], np.full(end - at, -np.inf, np.float32)
        for start in range(0, len(y), SEARCH_TILE_COLS):
            near = part @ b[start:start + SEARCH_TILE_COLS].T
            if not alone:
                near[group[:, None] == yg[None, start:start + SEARCH_TILE_COLS]] = -np.inf
            if start == 0 and near.shape[1] >= BOUND_COLS * (k + 1):
                # among the first rows the k-th best of those that are best in their bunch, but itself, is a bound from the start
                bunches = near.shape[1] // BOUND_COLS
                tops = near[:, :bunches * BOUND_COLS].reshape(len(near), BOUND_COLS, bunches).max(axis=1)
                far = np.sqrt(np.maximum(slack - np.partition(tops, -k - 1, axis=1)[:, -k - 1], 0.0)) + step
                least = -far * far - np.float32(slack)
            some = np.flatnonzero(near.max(axis=1) >= least)
            r, c = np.divmod(np.flatnonzero(near[some] >= least[some][:, None]), near.shape[1])
            r, c = some[r], c + start
            other = group[r] != yg[c]
            r, c = r[other], c[other]
            gap = x[at + r] - y[c]
            w = np.round(np.sqrt((gap * gap).sum(axis=1)), DIGITS)
            met = np.unique(r)
            r = np.concatenate([np.repeat(met, k), r])
            c, w = np.concatenate([of[at + met].ravel(), c]), np.concatenate([best[at + met].ravel(), w])
            order = np.lexsort((c, w, r))
            r, c, w = r[order], c[order], w[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            best[at + met], of[at + met] = w[first].reshape(-1, k), c[first].reshape(-1, k)
            far = best[at + met, -1] / size + step
            least[met] = np.maximum(least[met], -far * far - slack)
    return best, of


def _search(asked: DataFrame, rows: DataFrame, k: int, alone: bool) -> DataFrame:
    """(i, j, w, place): the ``k`` nearest rows of other groups for every asked row; both sides are (id, v, g), v as bytes."""
    id_type = rows.schema["id"].dataType.simpleString()

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) and len(right):
            right = right.sort_values("id")
            x, y = vectors.unpacked(left["_qv"]), vectors.unpacked(right["_cv"])
            # rows with odd components link with nothing
            fine, sound = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
            group = pd.factorize(pd.concat([left["_qg"], right["_cg"]]))[0].astype(np.int32)
            if fine.any() and sound.any():
                w, of = _nearest(x[fine], group[:len(x)][fine], y[sound], group[len(x):][sound], k, alone)
                r, c = np.nonzero(of >= 0)
                return pd.DataFrame({"i": left["query_id"].to_numpy()[fine][r], "j": right["id"].to_numpy()[sound][of[r, c]], "w": w[r, c]})
        return pd.DataFrame({"i": [], "j": [], "w": []}, dtype=object)

    named = lambda df, key, p: df.select(F.col("id").alias(key), F.col("v").alias(f"_{p}v"), F.col("g").alias(f"_{p}g"))
    q, c = vectors._crossed(named(asked, "query_id", "q"), named(rows, "id", "c"), SEARCH_BLOCK_ROWS)
    found = q.groupBy("_cb", "_qb").cogroup(c.groupBy("_cb", "_qb")).applyInPandas(product, f"i {id_type}, j {id_type}, w double")
    return found.withColumn("place", F.row_number().over(W.partitionBy("i").orderBy("w", "j"))).filter(F.col("place") <= k)


def _roots(picked: DataFrame) -> DataFrame:
    """(g, root) where every group points to another one and only two of them can point in a circle."""
    if picked.count() <= KNOWN_ROWS:
        pairs = picked.select("g", "to").toPandas()
        g, to = pairs["g"].to_numpy(), pairs["to"].to_numpy()
        names, place = np.unique(np.concatenate([g, to]), return_inverse=True)
        own = np.arange(len(names))
        up = own.copy()
        up[place[:len(g)]] = place[len(g):]
        # of two that point at each other the smaller one stays
        up = np.where((up[up] == own) & (own < up), own, up)
        while (up[up] != up).any():
            up = up[up]
        kind = picked.schema["g"].dataType.simpleString()
        return picked.sparkSession.createDataFrame(pd.DataFrame({"g": g, "root": names[up[place[:len(g)]]]}), f"g {kind}, root {kind}")
    back = picked.select(F.col("to").alias("g"), F.col("g").alias("to"), F.lit(True).alias("both"))
    at = stored(picked.join(back, ["g", "to"], "left").select("g", F.when(F.col("both") & (F.col("g") < F.col("to")), F.col("g")).otherwise(F.col("to")).alias("root")))
    while True:
        after = at.select(F.col("g").alias("root"), F.col("root").alias("after"))
        at = stored(at.join(after, "root", "left").select("g", F.coalesce("after", "root").alias("root"), (F.col("after") != F.col("root")).alias("moved")))
        if at.filter("moved").limit(1).count() == 0:
            return at.select("g", "root")
        at = at.select("g", "root")


def _tree_by_search(rows: DataFrame, k: int | None = None) -> DataFrame:
    """(i, j, w) of ``rows(id, vec)``: the edges of the minimum spanning tree in the order (w, i, j).

    Every row lists its nearest rows of other groups (at first each row is a group). The least edge that leaves a group
    is one of the tree; lists tell it, unless a row whose list lies inside its own group may have something nearer than all the group knows.
    Groups join by these edges until lists tell none; then used-up rows of all groups but the largest search again.
    """
    k = k or NEAR
    rows = stored(rows.select("id", vectors.as_bytes("vec").alias("v")))
    label = stored(rows.select("id", F.col("id").alias("g")))
    asked, lists, full, trees = rows.join(label, "id"), None, None, []
    alone = True
    while True:
        found = stored(_search(asked, rows.join(label, "id"), k, alone))
        ends = found.filter(F.col("place") == k).select("i", F.col("w").alias("reach"))
        found = found.select("i", "j", "w")
        lists = found if lists is None else lists.select("i", "j", "w").unionByName(found)
        full = ends if full is None else full.join(asked.select(F.col("id").alias("i")), "i", "left_anti").unionByName(ends)
        full, alone, joined = stored(full), False, False
        while True:
            of = lambda end, name: label.select(F.col("id").alias(end), F.col("g").alias(name))
            lists = stored(lists.select("i", "j", "w").join(of("i", "g"), "i").join(of("j", "to"), "j").filter(F.col("g") != F.col("to")))
            edge = F.struct("w", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "to")
            least = lists.groupBy("g").agg(F.min(edge).alias("edge"))
            used = full.join(lists.select("i").distinct(), "i", "left_anti").join(of("i", "g"), "i")
            known = used.groupBy("g").agg(F.min("reach").alias("reach"))
            picked = stored(least.join(known, "g", "left").filter(F.col("reach").isNull() | (F.col("edge.w") < F.col("reach"))).select("g", "edge.*"))
            if picked.limit(1).count() == 0:
                break
            joined = True
            trees.append(picked.select("i", "j", "w").distinct())
            label = stored(label.join(_roots(picked.select("g", "to")), "g", "left").select("id", F.coalesce("root", "g").alias("g")))
        largest = label.groupBy("g").count().orderBy(F.desc("count"), "g").first()["g"]
        open_rows = used.join(least, "g", "left").filter((F.col("g") != F.lit(largest)) & (F.col("edge").isNull() | (F.col("reach") <= F.col("edge.w"))))
        asked = stored(rows.join(open_rows.select(F.col("i").alias("id"), "g"), "id"))
        if not joined or asked.limit(1).count() == 0:
            break
    edges = trees[0] if trees else rows.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("w")).limit(0)
    for more in trees[1:]:
        edges = edges.unionByName(more)
    return edges


def spanning_edges(rows: DataFrame) -> DataFrame:
    """(i, j, w) of ``rows(id, vec)``, different vectors: all edges of the minimum spanning tree and few others."""
    id_type = rows.schema["id"].dataType.simpleString()
    dealt, cells = metric.deal(rows.select("id", "vec"), metric.BLOCK_ROWS)
    edge = f"i {id_type}, j {id_type}, w double"
    if cells is None:
        return rows.sparkSession.createDataFrame([], edge)

    def own_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, ids = np.array(pdf["vec"].tolist(), np.float64), pdf["id"].to_numpy()
        found = _frame(ids, spanning_forest(lambda v: _rounded(x[v : v + 1], x)[0], len(x), ids))
        # how wide the edges are that join this block to its pivot
        found["reach"] = max(found["w"].max() if len(found) else 0.0, round(float(pdf["apart"].min()), DIGITS))
        found["cell"] = pdf["cell"].iloc[0]
        if found.empty:
            found = pd.DataFrame({"i": [ids[0]], "j": [ids[0]], "w": [0.0], "reach": [round(float(pdf["apart"].min()), DIGITS)], "cell": [pdf["cell"].iloc[0]]})
        return found

    local = cut(dealt.groupBy("cell", "block").applyInPandas(own_tree, f"{edge}, reach double, cell int"))
    trees = local.filter(F.col("i") != F.col("j")).select("i", "j", "w")
    blocks = cells.blocks()
    if len(cells) == 1 and blocks[0] == 1:
        return trees
    reach = np.zeros(len(cells))
    for r in local.groupBy("cell").agg(F.max("reach").alias("reach")).collect():  # a row per cell
        reach[r["cell"]] = r["reach"]
    most = np.maximum(_way_between(cells.pivots), np.maximum(reach[:, None], reach[None, :]))
    margin = 10.0**-DIGITS
    other = ~np.eye(len(cells), dtype=bool)
    # both ends of a pair of cells must be able to meet, or neither goes
    ball = metric.distances(cells.pivots, cells.pivots) - cells.radii[:, None] - cells.radii[None, :]
    meets = (ball <= most + margin + metric.ROUNDING * np.abs(cells.pivots).max(initial=0.0)) & other
    n = int(cells.counts.sum())
    if n >= SEARCH_ROWS and float(cells.counts @ meets.astype(np.float64) @ cells.counts) * SEARCH_SHARE > float(n) * n:
        return _tree_by_search(rows)
    going = metric.visits(dealt, cells, lambda least, home: meets[home] & (least <= most[home] + margin))
    n_blocks = metric.per_cell(blocks, F.col("other"))
    side = F.col("cell") < F.col("other")
    across = going.withColumn("other", F.explode("to")).withColumn("theirs", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    inside = dealt.withColumn("other", F.col("cell")).withColumn("theirs", F.explode(F.sequence(F.lit(0), n_blocks - 1))).filter(F.col("theirs") != F.col("block"))
    columns = ("cell", "other", "block", "theirs", "id", "vec")
    sent = across.select(*columns, side.alias("left")).unionByName(inside.select(*columns, (F.col("block") < F.col("theirs")).alias("left")))
    left = sent.filter("left").select(F.col("cell").alias("a"), F.col("other").alias("b"), F.col("block").alias("la"), F.col("theirs").alias("lb"), "id", "vec")
    right = sent.filter("not left").select(F.col("other").alias("a"), F.col("cell").alias("b"), F.col("theirs").alias("la"), F.col("block").alias("lb"), "id", "vec")

    def cross_forest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"i": [], "j": [], "w": []})
        widest = most[int(p["a"].iloc[0]), int(p["b"].iloc[0])]
        both = pd.concat([p.assign(side=False), q.assign(side=True)]).sort_values("id")
        x, ids, of = np.array(both["vec"].tolist(), np.float64), both["id"].to_numpy(), both["side"].to_numpy(dtype=bool)
        same = p["a"].iloc[0] == p["b"].iloc[0]

        def weights(v: int) -> np.ndarray:
            w = _rounded(x[v : v + 1], x)[0]
            w[of == of[v]] = np.inf
            if not same:
                w[w > widest] = np.inf
            return w

        return _frame(ids, spanning_forest(weights, len(x), ids))

    crossed = left.groupBy("a", "b", "la", "lb").cogroup(right.groupBy("a", "b", "la", "lb")).applyInPandas(cross_forest, edge)
    return trees.unionByName(crossed)


def _grow(edges: Iterator[tuple], nodes: dict, min_size: int) -> list[tuple]:
    """Join ``nodes`` (name -> [size, cluster, mass, inside]) along sorted edges (w, i, j, a, b) between nodes a and b.

    Rows (kind, node, other, cluster, parent, size, mass, inside, wins): ``in`` says which cluster an
    item group joins first, ``closed`` tells of a cluster that ended in a split, ``moved`` where a node went, ``state`` what is left.
    """
    up = {n: n for n in nodes}
    waiting = {n: [n] for n, s in nodes.items() if s[1] is None}
    out: list[tuple] = []

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    def enter(n, cluster):
        out.extend(("in", w, None, cluster, None, None, None, None, None) for w in waiting.pop(n))

    for w, i, j, a, b in edges:
        a, b = find(a), find(b)
        if a == b:
            continue
        if nodes[a][0] < nodes[b][0]:
            a, b = b, a
        x, y = nodes[a], nodes[b]
        density = 1.0 / max(w, LEAST)
        size, cluster, mass, inside = x[0] + y[0], x[1], x[2], x[3]
        if x[1] is not None and y[1] is not None:
            cluster, mass, inside = f"{i}|{j}", density * size, 0.0
            for s in (x, y):
                stability = s[2] - density * s[0]
                out.append(("closed", None, None, s[1], cluster, s[0], stability, s[3], stability >= s[3]))
                inside += max(stability, s[3])
        elif x[1] is not None:
            mass += density * y[0]
            enter(b, cluster)
        elif size >= min_size:
            cluster, mass, inside = f"{i}|{j}", density * size, 0.0
            enter(a, cluster)
            enter(b, cluster)
        else:
            waiting[a] += waiting.pop(b)
        nodes[a] = [size, cluster, mass, inside]
        up[b] = a
        del nodes[b]
    out.extend(("moved", n, find(n), None, None, None, None, None, None) for n in up)
    out.extend(("state", n, None, s[1], None, s[0], s[2], s[3], None) for n, s in nodes.items())
    return out


COLUMNS = ["kind", "node", "other", "cluster", "parent", "size", "mass", "inside", "wins"]


def _grown(edges: DataFrame, nodes: DataFrame, min_size: int, id_type: str) -> DataFrame:
    """``_grow`` for every part: edges(part, w, i, j, a, b), nodes(part, node, size, cluster, mass, inside)."""

    def run(e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        states = {r[0]: [r[1], r[2], r[3], r[4]] for r in n[["node", "size", "cluster", "mass", "inside"]].astype({"cluster": object}).itertuples(index=False)}
        for s in states.values():
            s[1] = s[1] if isinstance(s[1], str) else None
        e = e.sort_values(["w", "i", "j"])
        rows = _grow(e[["w", "i", "j", "a", "b"]].itertuples(index=False, name=None), states, min_size)
        return pd.DataFrame(rows, columns=COLUMNS).astype(object)

    schema = f"kind string, node {id_type}, other {id_type}, cluster string, parent string, size long, mass double, inside double, wins boolean"
    return edges.groupBy("part").cogroup(nodes.groupBy("part")).applyInPandas(run, schema)


def _band(live: DataFrame, n: int, wide: bool) -> tuple[DataFrame, DataFrame | None, bool]:
    """(edges of the next band, the part of each node; None: all in one part, whether wide bands still work).

    No part has more than BAND_EDGES edges. A wide band is tried until one connected part grows too large for a task; from then on
    bands are as small as a part.
    """
    from mnemolake.operators.clusters import components

    if n <= BAND_EDGES:
        return live, None, wide
    # edges of one and the same length cannot be told apart by a band
    up_to = lambda share: live.filter(F.col("w") <= live.approxQuantile("w", [min(1.0, share * BAND_EDGES / n)], 0.001)[0])
    if wide:
        band = cut(up_to(WIDE_BAND))
        parts = cut(components(band.select(F.col("a").alias("i"), F.col("b").alias("j"))))
        biggest = band.join(parts.withColumnRenamed("id", "a"), "a").groupBy("component").count().agg(F.max("count")).first()[0]
        if biggest <= BAND_EDGES:
            return band, parts, True
    return cut(up_to(0.9)), None, False


def density_clusters(items: DataFrame, min_cluster_size: int = 3) -> DataFrame:
    """(id, cluster, size) of all items with a vector; cluster is its smallest id, null for noise.

    As usual for such hierarchies the whole table is no cluster of its own. Rows with a null or empty vector, or with
    one of another length than the first row's, are left out; copies always share a cluster.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two items at least")
    rows = vectors.usable(items.select("id", "vec"), "id", "vec")
    # one id may stand on several vectors: different vectors are nodes with numbers of their own, in the order of their smallest ids
    reps = rows.groupBy("vec").agg(F.min("id").alias("_id"), F.count("*").alias("copies"))
    reps = cut(reps.orderBy("_id", "vec").select(F.monotonically_increasing_id().alias("rep"), "vec", "copies"))
    members, id_type = cut(rows.join(reps.select("vec", "rep"), "vec").select("id", "rep")), "bigint"
    own = F.col("copies") >= min_cluster_size
    # as many copies as a cluster needs are one from the start
    nodes = reps.select(
        F.col("rep").alias("node"), F.col("copies").alias("size"), F.when(own, F.col("rep").cast("string")).alias("cluster"),
        F.when(own, F.col("copies") / F.lit(LEAST)).otherwise(0.0).alias("mass"), F.lit(0.0).alias("inside"),
    )
    entered = [nodes.filter("cluster is not null").select(F.col("node").alias("id"), "cluster")]
    closed, place, wide = [], None, True
    edges = cut(spanning_edges(reps.select(F.col("rep").alias("id"), "vec")))
    while True:
        if place is None:
            live = edges.select("w", "i", "j", F.col("i").alias("a"), F.col("j").alias("b"))
        else:
            at = lambda end, name: place.select(F.col("id").alias(end), F.col("node").alias(name))
            live = cut(edges.join(at("i", "a"), "i").join(at("j", "b"), "j").filter(F.col("a") != F.col("b")).select("w", "i", "j", "a", "b"))
            edges = live.select("i", "j", "w")
        n = live.count()
        band, parts, wide = _band(live, n, wide)
        if parts is None:
            named, touched = band.withColumn("part", F.lit(0)), nodes.withColumn("part", F.lit(0))
            if n:
                ends = band.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                touched = touched.join(ends, "node", "left_semi")
        else:
            named = band.join(parts.select(F.col("id").alias("a"), F.col("component").alias("part")), "a")
            touched = nodes.join(parts.select(F.col("id").alias("node"), F.col("component").alias("part")), "node")
        grown = cut(_grown(named, touched, min_cluster_size, id_type))
        moved = grown.filter("kind = 'moved'").select("node", F.col("other").alias("_to"))
        now = reps.select(F.col("rep").alias("id"), F.col("rep").alias("node")) if place is None else place
        entered.append(now.join(grown.filter("kind = 'in'").select("node", "cluster"), "node").select("id", "cluster"))
        closed.append(grown.filter("kind = 'closed'").select("cluster", "parent", "wins"))
        state = grown.filter("kind = 'state'").select("node", "size", "cluster", "mass", "inside")
        nodes = cut(nodes.join(moved, "node", "left_anti").unionByName(state))
        place = cut(now.join(moved, "node", "left").select("id", F.coalesce("_to", "node").alias("node")))
        if n <= BAND_EDGES:
            break
    union = lambda frames: frames[0] if len(frames) == 1 else union(frames[:-1]).unionByName(frames[-1])
    roots = nodes.filter("cluster is not null").select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("wins"))
    chosen = _topmost(union([*closed, roots]))
    of = union(entered).join(chosen, "cluster").select(F.col("id").alias("rep"), "top")
    labelled = members.join(of, "rep", "left").select("id", "top")
    groups = labelled.filter("top is not null").groupBy("top").agg(F.min("id").alias("cluster"), F.count("*").alias("size"))
    return labelled.join(groups, "top", "left").select("id", "cluster", "size")


def _topmost(clusters: DataFrame) -> DataFrame:
    """(cluster, top): the highest chosen cluster at or above each one; null: none is chosen there."""
    t = cut(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("top")))
    if t.count() <= KNOWN_ROWS:
        known = {r["cluster"]: (r["up"], r["top"]) for r in t.collect()}
        tops: dict = {None: None}
        for name in known:
            way = []
            while name not in tops:
                way.append(name)
                name = known[name][0]
            for c in reversed(way):
                up, top = known[c]
                tops[c] = tops[up] if tops[up] is not None else top
        rows = [(c, top) for c, top in tops.items() if c is not None]
        return t.sparkSession.createDataFrame(rows, "cluster string, top string")
    while t.filter("up is not null").limit(1).count():
        above = t.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        t = cut(t.join(above, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")))
    return t.select("cluster", "top")
