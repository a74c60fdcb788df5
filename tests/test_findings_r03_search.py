"""all pairs searched by products of few large blocks."""

import numpy as np
import pytest
from test_density import clustered, plain_hierarchy, some_items

from mnemolake.operators import density, metric, vectors


@pytest.mark.parametrize("seed,n,near", [(3, 120, 8), (12, 150, 2), (13, 90, 1)])
def test_tree_by_search_equals_a_plain_hierarchy(spark, monkeypatch, seed, n, near):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 20)
    monkeypatch.setattr(density, "SEARCH_ROWS", 1)
    monkeypatch.setattr(density, "SEARCH_SHARE", 1 << 40)
    monkeypatch.setattr(density, "SEARCH_BLOCK_ROWS", 40)
    monkeypatch.setattr(density, "SEARCH_TILE_ROWS", 16)
    monkeypatch.setattr(density, "SEARCH_TILE_COLS", 16)
    monkeypatch.setattr(density, "NEAR", near)
    rows = some_items(seed, n)
    assert clustered(spark, rows, 3) == plain_hierarchy(rows, 3)


def test_tree_by_search_settles_equal_distances(spark, monkeypatch):
    monkeypatch.setattr(density, "NEAR", 2)
    grid = [(10 * a + b, [float(a), float(b)]) for a in range(6) for b in range(6)]
    found = {(r["i"], r["j"]): r["w"] for r in density._tree_by_search(spark.createDataFrame(grid, "id long, vec array<double>")).collect()}
    x, ids = np.array([v for _, v in grid]), np.array([i for i, _ in grid])
    want = {(int(ids[a]), int(ids[b])): w for a, b, w in density.spanning_forest(lambda v: density._rounded(x[v : v + 1], x)[0], len(x), ids)}
    assert found == want


def test_spread_vectors_are_searched_and_not_paired_by_balls(spark, monkeypatch):
    monkeypatch.setattr(density, "SEARCH_ROWS", 1000)
    monkeypatch.setattr(metric, "BLOCK_ROWS", 256)
    called = []
    search = density._tree_by_search
    monkeypatch.setattr(density, "_tree_by_search", lambda rows: called.append(1) or search(rows))
    x = np.random.default_rng(5).normal(size=(1500, 48))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    edges = density.spanning_edges(df).collect()
    assert called and len(edges) == len(x) - 1
    want = {(a, b) for a, b, _ in density.spanning_forest(lambda v: density._rounded(x[v : v + 1], x)[0], len(x), np.arange(len(x)))}
    assert {(r["i"], r["j"]) for r in edges} == want


def test_blocks_of_a_search_send_a_row_to_few_others():
    # 6 GB of the check tables: 826,000 rows on both sides
    blocks = -(-826_000 // (vectors.BLOCK_BYTES // (8 * 64)))
    assert 2 * blocks <= 14
