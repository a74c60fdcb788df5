"""One small case for each finding of the third review."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import fusion


@pytest.mark.parametrize("rrf", [0.00291, 0.00465, 0.00507, 0.00533])
def test_decayed_scores_round_as_the_sql_does(spark, rrf):
    import duckdb

    old = spark.createDataFrame([(1, "note", "a", rrf, dt.datetime(2020, 1, 1))], "query_id int, kind string, source_id string, rrf double, created_at timestamp")
    got = fusion.decayed(old, F.lit("2024-06-01 00:00:00").cast("timestamp")).first()["score"]
    assert got == duckdb.sql(f"SELECT round({rrf}::DOUBLE * 0.05::DOUBLE, 6)").fetchall()[0][0]


def _some_vectors(spark, n, seed=3, dims=8):
    import numpy as np

    x = np.random.default_rng(seed).standard_normal((n, dims)).round(2)
    x[n // 2:] = x[: n - n // 2] + 0.01
    return x, spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def test_searched_rows_are_copied_once_per_large_block(spark):
    """5000 queries are one block of 8-dimensional vectors, so no corpus row is shuffled five times."""
    from mnemolake.operators import vectors

    _, rows = _some_vectors(spark, 5000)
    q, c = vectors._crossed(rows.withColumnRenamed("id", "query_id"), rows, 32768)
    assert c.count() == 5000 and q.select("_qb").distinct().count() == 1


@pytest.mark.parametrize("k,own", [(3, False), (3, True), (None, False)])
def test_search_in_tiles_finds_what_brute_force_finds(spark, monkeypatch, k, own):
    import numpy as np

    from mnemolake.operators import vectors

    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(vectors, "TILE_COLS", 11)
    x, rows = _some_vectors(spark, 60)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    want = set()
    for q in range(60):
        hits = sorted((-sims[q, i], i) for i in range(60) if sims[q, i] >= 0.3 and not (own and i == q))
        want |= {(q, i, -s) for s, i in hits[:k]}
    found = vectors.top_k_cosine(rows.withColumnRenamed("id", "query_id"), rows, k, 0.3, dims=8, but_own=own).collect()
    assert {(r["query_id"], r["id"], round(r["cosine"], 6)) for r in found} == want


def test_a_message_id_of_every_session_meets_one_row(spark):
    """400 cases and 400 sessions share a message id; the join by that id carries 400 rows, not 160,000."""
    from mnemolake.operators import evaluation

    cases = spark.range(400).selectExpr("id AS case_id", "concat('x', id) AS session_id", "array('D:1', 'D:9', 'D:1 D:2') AS evidence")
    pairs = spark.range(400).selectExpr("concat('s', id) AS session_id", "'D:1' AS message_id", "concat(id, '-0') AS source_id")
    found = evaluation.resolve_evidence(cases, pairs)
    rows = found.collect()
    assert {(tuple(r["gold"]), r["unmapped"], r["unresolved"]) for r in rows} == {(("0-0",), 1, 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # sources are aggregated by message alone, never by case and message
    assert not [line for line in plan.splitlines() if "Aggregate [case_id" in line and "min(source_id" in line]


def test_hashed_candidates_are_scored_without_becoming_rows(spark, monkeypatch):
    """the products of the buckets give the hits that scoring every candidate pair gives."""
    import numpy as np

    from mnemolake.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1)
    x, rows = _some_vectors(spark, 300)
    planes = np.random.default_rng(11).standard_normal((2, 3, 8))
    code = (np.einsum("nd,tbd->ntb", x, planes) >= 0) @ (1 << np.arange(3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    want = set()
    for q in range(300):
        hits = sorted((-sims[q, i], i) for i in range(300) if (code[q] == code[i]).any() and sims[q, i] >= 0.5)
        want |= {(q, i, -s, at + 1) for at, (s, i) in enumerate(hits[:4])}
    found = vectors.ann_with_exact_fallback(rows.withColumnRenamed("id", "query_id"), rows, 4, 0.5, tables=2, bits=3, dims=8)
    assert {(r["query_id"], r["id"], round(r["cosine"], 6), r["rank"]) for r in found.filter("path = 'ann'").collect()} == want
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in text  # no cosine per candidate row


@pytest.mark.parametrize("tiles", [2048, 5])
def test_newest_notes_of_blocks_are_those_of_all_hits(spark, monkeypatch, tiles):
    """what a task leaves out cannot win a day."""
    from mnemolake.operators import vectors

    monkeypatch.setattr(vectors, "TILE_COLS", tiles)
    _, rows = _some_vectors(spark, 240)
    queries = rows.filter("id < 40").withColumnRenamed("id", "query_id")
    note = F.col("id") % 150
    notes = rows.withColumn("kind", F.when(F.col("id") >= 150, "child").otherwise("parent")).withColumn("id", note).withColumn(
        "created_at", F.when(note % 5 != 0, F.timestamp_seconds(note % 7 * 86400 + note % 3 * 60))
    )
    all_hits = vectors.top_k_cosine(queries, notes.filter("kind = 'parent'").select("id", "vec"), None, 0.1, dims=8).withColumn("kind", F.lit("parent")).unionByName(
        vectors.top_k_cosine(queries, notes.filter("kind = 'child'").select("id", "vec"), None, 0.1, dims=8).withColumn("kind", F.lit("child"))
    ).withColumn("content", F.lit(""))
    merged = vectors.merge_parent_child(all_hits).join(notes.select("id", "created_at").distinct(), "id")
    as_set = lambda df: {(r["query_id"], r["id"], r["cosine"]) for r in df.select("query_id", "id", "cosine").collect()}
    assert as_set(vectors.newest_notes(queries, notes, 0.1, 0.3, 12, dims=8)) == as_set(vectors.newest_per_day(merged, 0.3, 12))


def test_exact_search_finds_what_lies_outside_the_visited_cells(spark):
    """F8: one probe misses copies across a cell border; the check that follows finds them."""
    from mnemolake.operators import inverted_file, vectors

    _, rows = _some_vectors(spark, 400, dims=16)
    asked = rows.withColumnRenamed("id", "query_id")
    index = inverted_file.build(rows)
    as_set = lambda df: {(r["query_id"], r["id"], r["cosine"], r["rank"]) for r in df.collect()}
    want = as_set(vectors.top_k_cosine(asked, rows, 5, 0.2, dims=16))
    assert as_set(inverted_file.search(index, asked, 5, 0.2, probes=1)) != want
    assert as_set(inverted_file.search_exactly(index, asked, 5, 0.2, probes=1)) == want


def test_facts_of_small_and_large_topics_are_kept_alike(spark, monkeypatch):
    """one task a topic, by joins above its bound; both keep what the scan in order keeps."""
    import random

    from mnemolake.operators import topics

    rng = random.Random(5)
    facts = [(t, t * 1000 + i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))) for t in range(4) for i in range(40)]
    rows = spark.createDataFrame(facts, "topic_id long, fact_id long, fact string")
    bodies = spark.createDataFrame([(0, "abcabc"), (1, None)], "topic_id long, body string")
    want = set()
    for t in range(4):
        kept: list[str] = []
        for _, i, x in (f for f in facts if f[0] == t):
            if (t == 0 and x in "abcabc") or any(x in k or k in x for k in kept):
                continue
            kept.append(x)
            want.add((t, i))
    found = lambda: {(r["topic_id"], r["fact_id"]) for r in topics.distinct_facts(bodies, rows).collect()}
    assert found() == want
    monkeypatch.setattr(topics, "TOPIC_CHARS", 0)
    assert found() == want


def test_observations_are_counted_in_blocks(spark, monkeypatch):
    """items and texts in several blocks, counted as bits."""
    import random

    from mnemolake.operators import lexical

    monkeypatch.setattr(lexical, "OBSERVED_TEXTS", 20)
    monkeypatch.setattr(lexical, "OBSERVED_ITEMS", 7)
    rng = random.Random(2)
    words = ["lake", "Lake", "node", "snow", "rare"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for i in range(90)]
    kw = [(i, w) for i in range(25) for w in rng.sample([*words, "none"], 2)]
    got = lexical.observation_counts(
        spark.createDataFrame(kw, "id long, keyword string"), "id", spark.createDataFrame(texts, "text_id long, text string"), "text_id", "text"
    )
    want = {i: sum(any(w in x for j, w in kw if j == i) for _, x in texts) for i in range(25)}
    assert {r["id"]: r["observations"] for r in got.collect()} == {i: n for i, n in want.items() if n}


def test_pipeline_cuts_content_defined_chunks_first(spark, monkeypatch):
    """the chunks are asked for, and chunks with the exact pass behind them remove what the pass alone removes."""
    import random

    import corpus_pipeline
    from mnemolake.llm import linechunks

    rng = random.Random(9)
    docs = spark.createDataFrame(
        [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 14)))) for i in range(40)] + [(None, "a\nb\nc\nd"), (3, "a\nb\nc\nd")], "doc_id long, text string"
    )
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(linechunks.remove_chunks_and_passages(docs, "n")) == as_rows(linechunks.remove_repeated_passages(docs, "n"))
    asked = []
    plain = linechunks.repeated_chunks
    monkeypatch.setattr(linechunks, "repeated_chunks", lambda *a: asked.append(1) or plain(*a))
    corpus_pipeline.line_dedup(spark, docs, "")
    assert asked
