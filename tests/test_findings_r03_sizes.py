"""Findings of the third review that only large tables show: what is forced here by small bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemolake.operators import clusters, lineage, metric, vectors


def _rows(spark, n, seed=5, dims=6):
    x = np.random.default_rng(seed).standard_normal((n, dims)).round(2)
    x[n - n // 8:] = x[: n // 8]
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def _cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def _no_links(*_, **__):
    raise AssertionError("links between vectors became rows")


@pytest.mark.parametrize("open_rows", [1000, 3])
def test_dense_seed_pairs_never_hold_links(spark, monkeypatch, open_rows):
    """slices in id order; with more open rows than allowed what is left goes through the links."""
    x, df = _rows(spark, 90)
    c, used, want = _cosines(x), set(), set()
    for i in range(len(x)):
        j = next((j for j in range(i + 1, len(x)) if i not in used and j not in used and c[i, j] >= 0.5), None)
        if j is not None:
            used |= {i, j}
            want.add((i, j))
    monkeypatch.setattr(clusters, "MANY_LINKS", 1)
    monkeypatch.setattr(clusters, "FOLD_ROWS", 30)
    monkeypatch.setattr(clusters, "FOLD_BLOCK", 4)
    monkeypatch.setattr(clusters, "FOLD_WINDOW", 8)
    monkeypatch.setattr(clusters, "OPEN_ROWS", open_rows)
    if open_rows > len(x):
        monkeypatch.setattr(vectors, "similar_pairs", _no_links)
    assert {(r["i"], r["j"]) for r in clusters.seed_pairs(df, 0.5, dims=6).collect()} == want


@pytest.mark.parametrize("gain", [0, 1000])
def test_dense_groups_never_hold_links(spark, monkeypatch, gain):
    """leaders come in batches; a batch that settles few rows hands the rest to the links."""
    x, df = _rows(spark, 80)
    c, lead = _cosines(x), {}
    for i in range(len(x)):
        if i not in lead:
            lead |= {j: i for j in range(i, len(x)) if j not in lead and (j == i or c[i, j] > 0.5)}
    seen = []
    monkeypatch.setattr(clusters, "MANY_LINKS", 1)
    monkeypatch.setattr(clusters, "LEAD_ROWS", 5)
    monkeypatch.setattr(clusters, "LEAD_GAIN", gain)
    joined = vectors.similar_pairs
    monkeypatch.setattr(vectors, "similar_pairs", lambda r, *a, **k: (seen.append(r.count()), joined(r, *a, **k))[1])
    assert {r["id"]: r["leader"] for r in clusters.threshold_groups(df, 0.5, dims=6).collect()} == lead
    assert seen[0] == 0 if gain == 0 else 0 < seen[0] < 70


def test_rows_meet_pivots_in_small_parts():
    """A batch of any size is measured against all pivots in parts."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(metric.PART_ROWS * 2 + 5))})
    parts = list(metric.parts(iter([batch])))
    assert max(p.num_rows for p in parts) == metric.PART_ROWS and sum(p.num_rows for p in parts) == batch.num_rows


def test_blocks_of_a_similarity_join_grow_with_the_rows():
    """738 000 rows were 361 blocks, so every row was shuffled 362 times."""
    assert vectors._grid_blocks(738_000, 12) == 23 and vectors._grid_blocks(20_000, 12) == 10


@pytest.mark.parametrize("caps", [(3, 4), (500, 500)])
def test_reports_of_similar_pairs_are_cut_in_the_tasks(spark, monkeypatch, caps):
    """pairs are counted where they are found, no join takes them all."""
    monkeypatch.setattr(vectors, "PAIR_BLOCK_ROWS", 20)
    monkeypatch.setattr(vectors, "similar_pairs", _no_links)
    x, df = _rows(spark, 60)
    c = _cosines(x)
    got = [tuple(r) for r in vectors.banded_pairs(df, 0.9, 0.5, *caps).collect()]
    for band, lo, hi, cap in (("duplicate", 0.9, 2, caps[0]), ("related", 0.5, 0.9, caps[1])):
        pairs = [(i, j) for i in range(60) for j in range(i + 1, 60) if lo < c[i, j] <= hi]
        rows = sorted((r for r in got if r[0] == band), key=lambda r: r[4])
        four = {p: (int(round(c[p] * 1e6)) + 50) // 100 / 1e4 for p in pairs}
        want = sorted(pairs, key=lambda p: (-four[p], p))[:cap]
        assert [(r[1], r[2]) for r in rows] == want and {r[5] for r in rows} == {len(pairs)}


def test_notes_are_merged_where_they_are_compared(spark, monkeypatch):
    """rows of one note meet in one block, so no hit is shuffled."""
    monkeypatch.setattr(vectors, "NOTE_ROWS", 16)
    monkeypatch.setattr(vectors, "NOTE_QUERY_ROWS", 16)
    x, df = _rows(spark, 70)
    notes = df.select((F.col("id") % 40).alias("id"), F.when(F.col("id") >= 40, "child").otherwise("parent").alias("kind"), "vec")
    c, want = _cosines(x), {}
    for q in range(70):
        for i in range(70):
            if c[q, i] >= 0.4:
                want.setdefault((q, i % 40), []).append((c[q, i], "child" if i >= 40 else "parent"))
    got = {(r["query_id"], r["id"]): (r["cosine"], r["source_kinds"], r["candidates"]) for r in vectors.best_of_notes(df.withColumnRenamed("id", "query_id"), notes, 0.4).collect()}
    assert got == {k: (max(v)[0], ",".join(sorted({s for _, s in v})), len(v)) for k, v in want.items()}


def test_equal_spans_of_notes_are_searched_once(spark, monkeypatch):
    """thousands of notes over one span are one range; a note with two spans is listed once."""
    cr = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 9), ("c", 50)], "correction_id string, qa_id long")
    en = spark.createDataFrame([(1, 7), (2, 7), (1, 7)], "source_qa_id long, topic_id long")
    notes = spark.createDataFrame([(n, 0, 5) for n in range(200)] + [(0, 1, 10), (500, 8, 10), (501, 4, 4)], "note_id long, lo long, hi long")
    want = {tuple(r) for r in lineage.affected_artifacts(cr, en, notes).select("correction_id", "derived_kind", "derived_id").collect()}
    asked = []
    search = lineage.contained_in_ranges
    monkeypatch.setattr(lineage, "contained_in_ranges", lambda p, r, *a, **k: (asked.append(r.count()), search(p, r, *a, **k))[1])
    got = [tuple(r) for r in lineage.affected_once(cr, en, notes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and asked == [3]
    assert [r["qa_id"] for r in lineage.unmapped(cr, lineage.covered(cr, en, notes)).collect()] == [50]


@pytest.mark.parametrize("held", [512, 0])
def test_segments_of_a_session_are_held_beside_its_answers(spark, monkeypatch, held):
    """words of answers become rows in crowded sessions only."""
    monkeypatch.setattr(lineage, "HELD_SEGMENTS", held)
    if held:
        monkeypatch.setattr(lineage, "_prefix_grams", lambda c: F.array(F.lit("no rows of words")))
    qa = spark.createDataFrame(
        [("s", "h", "old/s/1", ["x"], "so the last line is here"), ("s", "h", "old/s/2", ["x"], "an underlined word"), ("s", "h", "old/s/3", ["x"], "nothing"), ("t", "h", "old/t/1", ["x"], "last line")],
        "session_id string, host string, source_id string, merged_event_ids array<string>, answer string",
    )
    dl = spark.createDataFrame([("s", ["e"], "last line\n line \n\n"), ("s", ["e"], "derline")], "session_id string, event_ids array<string>, content string")
    got = lineage.contaminated_pairs(qa, dl).collect()
    assert sorted((r["source_id"], r["verdict"]) for r in got) == [("old/s/1", "unknown"), ("old/s/2", "unknown")]
