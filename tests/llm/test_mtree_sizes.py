"""Exact top scores of components of any size that a decimal's products allow, over several parts."""

from collections import defaultdict

import numpy as np
import pytest

from mnemolake.llm import mtree


@pytest.mark.parametrize("low,high", [(0, 2**25), (2**24, 2**25), (-(2**31), 2**31), (2**30, 2**31), (2**31 - 3, 2**31), (-(2**56), 2**56)])
def test_large_components_lose_no_row(spark, monkeypatch, low, high):
    monkeypatch.setattr(mtree, "ROWS_PER_BLOCK", 64)
    rng = np.random.default_rng(9)
    x = rng.integers(low, high, (200, 64)).astype(float)
    x[:20] = np.sign(x[:20]) * np.minimum(np.abs(x[:20]), 5)  # small rows beside large ones
    frame = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    vectors = mtree.integer_vectors(frame)
    got = defaultdict(list)
    for r in mtree.top_scores(vectors, vectors.filter(mtree.is_query())).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], int(r["score"])))
    whole = [[int(c) for c in v] for v in x]
    assert set(got) == set(range(0, 200, 20))
    for q, hits in got.items():
        scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q]
        assert hits == [(i, -s) for s, i in sorted(scores)[:20]]
