"""Findings of the fourth review."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mnemolake.catalog import all_queries
from mnemolake.functions import vec as V
from mnemolake.operators import density, inverted_file, lexical, vectors


def test_report_cosines_are_rounded_as_sql_rounds_them(spark):
    """some cosines times 10000 lie below the half in doubles, so four digits of such cosines are the lower ones."""
    halves = [m / 1e6 for m in range(350_050, 900_000, 100)]
    sql = duckdb.connect().execute("SELECT x, round(x, 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [halves]).fetchall()
    low = [x for x, r in sql if r < x][:20]
    assert len(low) == 20
    # every pair lives in two dimensions of its own; next to each a pair of the same four digits but the last half
    near = [x for c in low for x in (c, round(c - 0.00002, 6))]
    rows = []
    for k, c in enumerate(near):
        for i, part in ((2 * k, (1.0, 0.0)), (2 * k + 1, (c, math.sqrt(1 - c * c)))):
            v = [0.0] * (2 * len(near))
            v[2 * k:2 * k + 2] = part
            rows.append((i, v))
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = sorted((r["rank"], r["source_id"], r["cosine"]) for r in vectors.banded_pairs(df, 0.9, 0.35, 50, 7).collect())
    con = duckdb.connect()
    want = con.execute(
        "SELECT row_number() OVER (ORDER BY round(c, 4) DESC, i) AS rank, i, round(c, 4) FROM (SELECT unnest(?::BIGINT[]) AS i, unnest(?::DOUBLE[]) AS c) ORDER BY rank LIMIT 7",
        [[2 * k for k in range(len(near))], near],
    ).fetchall()
    assert got == want


@pytest.mark.parametrize("share", [1, 4, 1 << 20])
def test_many_keywords_are_searched_in_parts_and_items_meet_texts_once(spark, monkeypatch, share):
    """more keywords than one automaton takes were joined through the words of all texts, and blocks of 16,384 items each took all texts."""
    monkeypatch.setattr(lexical, "TERM_BYTES", 200)
    monkeypatch.setattr(lexical, "OBSERVED_TEXTS", 20)
    monkeypatch.setattr(lexical, "BITS_SHARE", share)
    monkeypatch.setattr(lexical, "UNION_ITEMS", 7)

    def no_join(*_, **__):
        raise AssertionError("words of texts became rows")

    monkeypatch.setattr(lexical, "term_matches", no_join)
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdeé" for b in ("x", "yy", "Zz", "数据", "q q")]
    texts = [(int(i) // 2, " ".join(rng.choice(words, 4))) for i in range(100)] + [(900, None), (901, "")]
    kw = [(i, str(w)) for i in range(60) for w in {str(w) for w in rng.choice([*words, "gone", "b"], 3)}] + [(77, "gone")]
    want = {}
    for i in {i for i, _ in kw}:
        n = len({t for t, text in texts if text and any(w in text for j, w in kw if j == i)})
        if n:
            want[i] = n
    got = lexical.observation_counts(
        spark.createDataFrame(kw, "id long, keyword string"), "id", spark.createDataFrame(texts, "text_id long, text string"), "text_id", "text"
    )
    got = got.collect()
    assert len(got) == len(want) and {r["id"]: r["observations"] for r in got} == want


def test_blocks_of_items_hold_half_a_million(spark):
    """texts are sent once for every block of items; 2,000,000 items were 122 blocks."""
    assert lexical.OBSERVED_ITEMS >= 500_000


def _vectors_with_shared_ids(folder, n=60, dims=64, seed=1):
    """Near copies have the id of their vector and 100,000, which other vectors have too."""
    x = np.random.default_rng(seed).standard_normal((2 * n, dims))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.concatenate([np.arange(n), 100_000 + np.arange(n)])
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(ids % 10, pa.int32())}), f"{folder}/embeddings.parquet")


def _same_as_sql(spark, folder, name):
    query = all_queries()[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    want = con.execute(query.sql)
    columns = [d[0] for d in want.description]
    got = query.fn(spark, str(folder)).select(*columns).collect()
    assert oracle.rows_of(columns, [tuple(r) for r in got]) == oracle.rows_of(columns, want.fetchall())


@pytest.mark.parametrize("search", [False, True])
@pytest.mark.parametrize("known", [0, 1000])
def test_vectors_under_one_id_are_nodes_of_their_own(spark, monkeypatch, tmp_path, search, known):
    """from 100,000 vectors on near copies share ids with other vectors; rounds of joins by these ids doubled rows."""
    _vectors_with_shared_ids(tmp_path)
    if search:
        monkeypatch.setattr(density.metric, "CELL_ROWS", 8)
        monkeypatch.setattr(density, "SEARCH_ROWS", 1)
    monkeypatch.setattr(density, "KNOWN_ROWS", known)
    _same_as_sql(spark, tmp_path, "density_clusters")


def _notes(spark, n, days, undated, kinds, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 8)).round(1)
    x[n - n // 6:] = x[: n // 6]
    rows = [(i % (n * 2 // 3), "child" if rng.random() < kinds else "parent", [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, kind string, vec array<double>")
    at = F.timestamp_seconds(F.col("id") % days * 86400 + F.col("id") % 3 * 60)
    queries = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n // 5)], "query_id long, vec array<double>")
    return queries, df.withColumn("created_at", F.when(F.col("id") % 11 >= undated, at))


@pytest.mark.parametrize("days, undated, kinds, block", [(20, 2, 0.3, 1 << 20), (20, 2, 0.02, 1 << 20), (3, 5, 0.05, 1 << 20), (4, 2, 0.05, 1), (30, 11, 0.3, 1 << 20), (1, 0, 0.0, 1)])
def test_days_are_decided_in_the_task_that_holds_them(spark, monkeypatch, days, undated, kinds, block):
    """whole days, large days (more rows than a block), no children, few days with undated notes behind them."""
    monkeypatch.setattr(vectors, "FIRST_COLS", 3)
    monkeypatch.setattr(vectors, "TILE_COLS", 7)
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    queries, notes = _notes(spark, 2400 if block == 1 else 600, days, undated, kinds)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    hits = queries.withColumnRenamed("vec", "q").crossJoin(notes).withColumn("cosine", F.round(V.cosine(F.col("q"), F.col("vec")), 6)).filter("cosine >= 0.1")
    hits = hits.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"), F.array_join(F.collect_set("kind"), ",").alias("source_kinds"), F.max("created_at").alias("created_at"))
    as_rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "cosine").collect())
    assert as_rows(vectors.newest_notes(queries, notes, 0.1, 0.3, 12, dims=8)) == as_rows(vectors.newest_per_day(hits, 0.3, 12))


def test_undated_notes_are_left_where_days_fill_the_places(spark, monkeypatch):
    """all hits of all days and undated notes were sorted; now blocks of hits are for large days and for queries with few days."""
    monkeypatch.setattr(vectors, "_hits_by_block", lambda *_: pytest.fail("hits were gathered"))
    queries, notes = _notes(spark, 3000, 14, 2, 0.3)
    assert vectors.newest_notes(queries.limit(20), notes, 0.1, 0.3, 12, dims=8).count() > 0


def test_exact_search_of_an_index_keeps_no_shortlists(spark, monkeypatch):
    """100 rows for every query and visited cell were shuffled before all rows were checked anyway."""
    x = np.random.default_rng(2).standard_normal((150, 8)).round(1)
    x[100:] = x[:50]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    index = inverted_file.build(df)
    monkeypatch.setattr(inverted_file, "search", lambda *_, **__: pytest.fail("cells were visited"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    want = {(q, i, c[q, i], k) for q in range(150) for k, i in enumerate(sorted(np.flatnonzero(c[q] >= 0.9).tolist(), key=lambda i: (-c[q, i], i))[:5], 1)}
    got = inverted_file.search_exactly(index, df.withColumnRenamed("id", "query_id"), 5, 0.9).collect()
    assert {(r["query_id"], r["id"], r["cosine"], r["rank"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("text_ids", [False, True])
def test_rows_of_notes_are_given_out_in_small_batches(spark, monkeypatch, tmp_path, text_ids):
    """blocks of 8,192 notes and 16,384 queries sent every vector of 6 GB to up to 101 tasks, as a task held its whole result."""
    assert min(vectors.NOTE_ROWS, vectors.NOTE_QUERY_ROWS) >= 100_000
    monkeypatch.setattr(vectors, "NOTE_PAIRS", 500)
    queries, notes = _notes(spark, 300, 5, 0, 0.4)
    if text_ids:
        queries, notes = queries.withColumn("query_id", F.concat(F.lit("q"), "query_id")), notes.withColumn("id", F.concat(F.lit("é"), "id"))
    hits = queries.withColumnRenamed("vec", "q").crossJoin(notes).withColumn("cosine", F.round(V.cosine(F.col("q"), F.col("vec")), 6)).filter("cosine >= 0.25")
    want = hits.groupBy("query_id", "id").agg(F.max("cosine"), F.array_join(F.array_sort(F.collect_set("kind")), ","), F.count("*"))
    got = vectors.best_of_notes(queries, notes, 0.25, dims=8)
    assert got.columns == ["query_id", "id", "cosine", "source_kinds", "candidates"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_notes_of_shared_ids_are_those_of_sql(spark, tmp_path):
    """as in tables of 1 GB, where ids of near copies are ids of other vectors too."""
    _vectors_with_shared_ids(tmp_path, 150)
    for name in ("parent_child_max", "newest_note_per_day", "inverted_file_copies"):
        _same_as_sql(spark, tmp_path, name)
