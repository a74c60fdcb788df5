"""Density clusters against a plain hierarchy; metric balls against all pairs."""

import itertools
import math

import numpy as np
import pytest

from mnemolake.operators import clusters, density, metric, vectors


def plain_hierarchy(items, m):
    """Labels by the textbook steps: dendrogram, condensed tree, stability, excess of mass."""
    vecs = sorted({tuple(v) for _, v in items})
    groups = sorted((min(i for i, w in items if tuple(w) == v), v) for v in vecs)
    ids = [g for g, _ in groups]
    count = {g: sum(tuple(w) == v for _, w in items) for g, v in groups}
    x = np.array([v for _, v in groups], float)
    order = sorted((round(math.dist(x[a], x[b]), 6), ids[a], ids[b]) for a, b in itertools.combinations(range(len(ids)), 2))
    tree = {g: ("leaf", g, count[g]) for g in ids}
    of = {g: g for g in ids}
    root = tree[ids[0]]
    for w, a, b in order:
        if of[a] != of[b]:
            left, right = tree[of[a]], tree[of[b]]
            root = ("node", 1.0 / max(w, 1e-6), left[2] if left[0] == "leaf" else left[4], left, (left[2] if left[0] == "leaf" else left[4]) + (right[2] if right[0] == "leaf" else right[4]), right)
            keep, gone = of[a], of[b]
            tree[keep] = root
            for g in ids:
                if of[g] == gone:
                    of[g] = keep
    size = lambda t: t[2] if t[0] == "leaf" else t[4]

    def leaves(t):
        return [t[1]] if t[0] == "leaf" else leaves(t[3]) + leaves(t[5])

    found = []  # clusters as (birth, [(density, ids)], children)

    def grow(t, birth):
        cluster = {"birth": birth, "out": [], "kids": [], "size": size(t)}
        found.append(cluster)
        while True:
            if t[0] == "leaf":
                cluster["out"].append((1e6, size(t), [t[1]]))
                return cluster
            _, lam, _, left, _, right = t
            big = [s for s in (left, right) if size(s) >= m]
            for s in (left, right):
                if size(s) < m:
                    cluster["out"].append((lam, size(s), leaves(s)))
            if len(big) == 2:
                cluster["kids"] = [grow(s, lam) for s in big]
                cluster["end"] = lam
                return cluster
            if not big:
                return cluster
            t = big[0]

    def mass(c):
        return sum((lam - c["birth"]) * n for lam, n, _ in c["out"]) + sum((c["end"] - c["birth"]) * k["size"] for k in c["kids"])

    def choose(c):
        """(best mass, chosen clusters)."""
        below = [choose(k) for k in c["kids"]]
        inside = sum(b for b, _ in below)
        return (mass(c), [c]) if mass(c) >= inside else (inside, [k for _, ks in below for k in ks])

    if size(root) < m:
        return {i: None for i, _ in items}
    top = grow(root, 0.0)
    chosen = [c for k in top["kids"] for c in choose(k)[1]]
    everyone = lambda c: [i for _, _, part in c["out"] for i in part] + [i for k in c["kids"] for i in everyone(k)]
    label = {g: None for g in ids}
    for c in chosen:
        inside = everyone(c)
        for g in inside:
            label[g] = min(inside)
    rep = {tuple(v): g for g, v in groups}
    return {i: label[rep[tuple(v)]] for i, v in items}


def some_items(seed, n, dims=5, copies=True):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(2, n // 25), dims))
    spread = rng.choice([0.02, 0.1, 0.4], len(centers))
    rows = []
    for i in range(n):
        c = int(rng.integers(len(centers)))
        rows.append((int(i * 7 % 1009), (centers[c] + rng.normal(size=dims) * spread[c]).round(4).tolist()))
    if copies:
        rows += [(2000 + i, rows[int(rng.integers(n))][1]) for i in range(n // 6)]
        rows += [(3000 + i, rows[0][1]) for i in range(4)]
    return rows


def clustered(spark, rows, m):
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    out = {r["id"]: (r["cluster"], r["size"]) for r in density.density_clusters(df, m).collect()}
    sizes = {c: sum(x == c for x, _ in out.values()) for c, _ in out.values()}
    assert all(s == (sizes[c] if c is not None else None) for c, s in out.values())
    return {i: c for i, (c, _) in out.items()}


@pytest.mark.parametrize("seed,n,m", [(1, 8, 3), (2, 30, 3), (3, 120, 3), (4, 120, 2), (5, 200, 8), (6, 500, 5)])
def test_density_clusters_equal_a_plain_hierarchy(spark, seed, n, m):
    rows = some_items(seed, n)
    assert clustered(spark, rows, m) == plain_hierarchy(rows, m)


@pytest.mark.parametrize("seed,m,wide", [(7, 3, 16), (8, 5, 2)])
def test_balls_blocks_and_bands_change_nothing(spark, monkeypatch, seed, m, wide):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 20)
    monkeypatch.setattr(metric, "MOST_CELLS", 4)
    monkeypatch.setattr(density, "BAND_EDGES", 150)
    monkeypatch.setattr(density, "WIDE_BAND", wide)
    rows = some_items(seed, 100)
    assert clustered(spark, rows, m) == plain_hierarchy(rows, m)


def test_density_of_few_and_odd_items(spark):
    assert clustered(spark, [], 3) == {}
    assert clustered(spark, [(1, [0.0, 1.0])], 3) == {1: None}
    assert clustered(spark, [(i, [0.0, 1.0]) for i in range(5)], 3) == {i: None for i in range(5)}
    grid = [(10 * a + b, [float(a), float(b)]) for a in range(5) for b in range(5)]
    assert clustered(spark, grid, 3) == plain_hierarchy(grid, 3)
    two = [(i, [0.0, 1.0]) for i in range(4)] + [(i, [1.0, 0.0]) for i in range(4, 9)] + [(9, [5.0, 5.0]), (10, None), (11, []), (12, [1.0])]
    assert clustered(spark, two, 3) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: None}


def test_similarity_join_in_balls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL_ROWS", 16)
    monkeypatch.setattr(metric, "BLOCK_ROWS", 10)
    monkeypatch.setattr(metric, "TILE", 4)
    monkeypatch.setattr(vectors, "PAIR_BLOCK_ROWS", 10)
    rows = some_items(9, 300, dims=16, copies=False)
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 6)
    for threshold in (0.2, 0.9, 0.99):
        want = {tuple(sorted((rows[a][0], rows[b][0]))): sims[a, b] for a, b in itertools.combinations(range(len(rows)), 2) if sims[a, b] >= threshold}
        got = vectors.similar_pairs(df, threshold).collect()
        assert len(got) == len(want) and all(abs(want[r["i"], r["j"]] - r["cosine"]) < 2e-6 for r in got)


def test_balls_compare_few_pairs_of_clustered_vectors(spark):
    work = []
    for n in (2000, 8000):
        rng = np.random.default_rng(11)
        centers = rng.normal(size=(n // 50, 64))
        x = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, 64)) * 0.1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        radius = math.sqrt(2 - 2 * 0.95)
        work.append(vectors.pair_work(df, radius)[3])
    power = math.log(work[1] / work[0]) / math.log(4)
    print("pairs compared", work, "power", power)
    assert power < 1.5 and work[1] < 8000 * 8001 // 2 / 8


def test_greedy_leaders_over_string_ids(spark):
    ids = [f"k{i:03d}" for i in range(40)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "i string, j string")
    assert sorted(r["id"] for r in clusters.greedy_leaders(nodes, edges).collect()) == ids[::2]
    assert sorted((r["i"], r["j"]) for r in clusters.greedy_pairs(edges).collect()) == list(zip(ids[::2], ids[1::2]))
