"""Approximate neighbours over many blocks of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.llm import multi_index
from mnemolake.session import prepare


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    return centres[rng.integers(0, 12, 2000)] + 0.3 * rng.normal(size=(2000, 16))


def frames(spark, x):
    rows = prepare(spark).createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    return rows, rows.filter(F.col("id") % 20 == 0)


def test_sixteen_blocks_are_probed_and_not_compared_whole(spark, clustered, monkeypatch):
    monkeypatch.setattr(multi_index, "ROWS_PER_BLOCK", 125)
    seen = []
    whole = multi_index.short_of
    monkeypatch.setattr(multi_index, "short_of", lambda *a: seen.append(whole(*a)) or seen[-1])
    rows, asked = frames(spark, clustered)
    got = {}
    for r in multi_index.nearest(rows, asked).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    held = 0
    for q in range(0, 2000, 20):
        scores = clustered @ clustered[q]
        scores[q] = -np.inf
        held += len(set(got[q]) & set(np.argsort(-scores)[:20].tolist()))
        assert len(got[q]) == 20
    assert held / 2000 >= 0.9
    # one query in ten at most falls back to the exact pass
    assert len(seen) == 1 and seen[0].count() <= 10


def test_queries_short_of_hits_are_answered_exactly(spark, clustered, monkeypatch):
    monkeypatch.setattr(multi_index, "ROWS_PER_BLOCK", 125)
    rows, asked = frames(spark, clustered)
    got = {}
    for r in multi_index.nearest(rows, asked.limit(5), k=20, radius=0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    for q, scores in got.items():
        want = np.sort(np.delete((clustered * clustered[q]).sum(axis=1), q))[::-1][:20]
        assert len(scores) == 20
        if not np.array_equal(scores, want):
            # enough rows share the query's code; what is found is a part of all, nearest first
            assert scores == sorted(scores, reverse=True) and scores[-1] <= want[-1]
    assert len(got) == 5


def test_repeated_query_rows_need_hits_each(spark):
    asked = spark.createDataFrame([(1, [1.0]), (1, [1.0]), (2, [1.0]), (3, [1.0])], "id long, vec array<double>")
    hits = spark.createDataFrame([(1, 5, 0.0), (1, 6, 0.0), (1, 5, 0.0), (2, 5, 0.0), (2, 6, 0.0)], "query_id long, vec_id long, score double")
    assert sorted(r["id"] for r in multi_index.short_of(hits, asked, 2).collect()) == [1, 1, 3]
