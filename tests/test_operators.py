"""Truth tables, brute-force checks and invariance under forced slicing and reordering."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.functions import clean as C
from mnemolake.functions import text as T
from mnemolake.operators import chunking, clusters, dedupe, graph, lexical, lineage, ordered, pairing, providers, sessions, topics, vectors, versions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("role,content,dk,src,kind", [
    ("tool", "x", None, None, "NORMAL_TOOL"), ("assistant", "Operation interrupted", None, None, "TERMINAL"), ("user", "hi", "hidden", None, "TERMINAL"),
    ("user", "[OUT-OF-BAND USER MESSAGE] hi", None, None, "REAL_USER"), ("user", "x", "steer", None, "REAL_USER"),
    ("user", "[CONTEXT COMPACTION] s", None, None, "CONTINUATION"), ("user", "[IMPORTANT: 3 background processes ended", None, None, "ASYNC_BOUNDARY"),
    ("user", "plain", "process_complete", None, "ASYNC_BOUNDARY"), ("user", "【IMPORTANT a scheduled cron job】", None, None, "NEW_ROOT"),
    ("user", "【ASYNC x】", None, None, "ASYNC_BOUNDARY"), ("user", "【IMPORTANT else】", None, None, "CONTROL"),
    ("user", "Sat 2026-04-11 01:15 GMT+8] [Subagent Context] x", None, None, "CONTROL"), ("user", "run", None, "cron", "NEW_ROOT"),
    ("user", "### Task:\nSuggest 3-5 relevant follow-up questions", None, None, "CONTROL"), ("user", "abc 5 hello", None, None, "REAL_USER"),
    ("assistant", "ok", None, None, "NORMAL_ASSISTANT"), ("system", "x", None, None, "CONTROL"),
])
def test_event_kinds(spark, role, content, dk, src, kind):
    df = spark.createDataFrame([(role, content, dk, src)], "r string, c string, d string, s string")
    assert df.select(C.host_event_kind(F.col("r"), F.col("c"), F.col("d"), F.col("s"))).first()[0] == kind


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("Hello, 数据湖治理 abc-DEF 一 数据湖",)], "t string")
    r = df.select(T.tokenize(F.col("t")), T.cjk_bigrams(F.col("t"))).first()
    assert r[0] == ["hello", "数据湖", "据湖治", "湖治理", "数据湖治理", "abc", "def", "一"]
    assert r[1] == ["数据", "据湖", "湖治", "治理", "一"]


@pytest.fixture()
def messages(spark):
    from mnemolake.catalog.base import Tables, messages

    return messages(Tables(spark, SF))


def test_pairs_do_not_depend_on_order_or_slicing(spark, messages, monkeypatch):
    rows = lambda d: sorted(map(tuple, pairing.qa_pairs(d).collect()))
    plain = rows(messages)
    assert rows(messages.repartition(7).orderBy(F.rand(3))) == plain
    monkeypatch.setattr(ordered, "PLAIN_WINDOW_ROWS", 0)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 2)
    assert rows(messages) == plain and len(plain) > 10


def test_sliced_scans_equal_plain_windows(spark, monkeypatch):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("v")).withColumn("s", F.floor(F.col("o") / 7))
    scans = (
        lambda h: ordered.running_sum(df, ["k"], "s", ["o"], F.coalesce("v", F.lit(0)), "x", h), lambda h: ordered.running_max(df, ["k"], "s", ["o"], -F.col("v"), "x", h),
        lambda h: ordered.lag(df, ["k"], "s", ["o"], F.col("v"), "x", h), lambda h: ordered.carry_forward(df, ["k"], "s", ["o"], F.col("v"), "x", h),
        lambda h: ordered.row_number(df, ["k"], "s", ["o"], "x", h),
    )
    for scan in scans:
        assert {(r["o"], r["x"]) for r in scan(True).collect()} == {(r["o"], r["x"]) for r in scan(False).collect()}


def test_budget_batches_sliced_equals_scan(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = [(s, i, int(n)) for s in ("a", "b") for i, n in enumerate(rng.integers(0, 130, 300))]
    df = spark.createDataFrame(data, "session_id string, ord long, chars long")
    want = sorted(map(tuple, chunking.budget_batches(df, 100).collect()))
    monkeypatch.setattr(ordered, "PLAIN_WINDOW_ROWS", 0)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 16)
    assert sorted(map(tuple, chunking.budget_batches(df, 100).collect())) == want


def test_import_twice_adds_nothing(spark, messages, tmp_path):
    from mnemolake.plans import history

    table = messages.withColumns({"identity_kind": F.lit("x"), "artifact": F.lit("f"), "skip_reason": F.when(F.col("role") == "tool", "skipped_roles")}).drop("conv_id", "turn", "dup")
    run = lambda: {r["what"]: r["n"] for r in history.import_items(table, str(tmp_path / "raw"), str(tmp_path / "qa")).collect()}
    first, second = run(), run()
    assert first["raw_new"] > 0 and first["pairs_new"] > 0
    assert second["raw_new"] == 0 and second["pairs_new"] == 0 and first["skipped_roles"] == second["skipped_roles"]


def _vectors(spark, copies=True):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (base[i] + 0.2 * rng.standard_normal(8)).tolist()) for i in range(20)]
    if copies:
        rows += [(200 + i, base[i % 5].tolist()) for i in range(15)]
    return rows, spark.createDataFrame(rows, "id long, vec array<double>")


def _sims(rows):
    m = np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.round(m @ m.T, 6)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.97])
def test_similar_pairs_lose_nothing(spark, threshold, monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_BLOCK_ROWS", 8)
    rows, df = _vectors(spark, copies=False)
    s = _sims(rows)
    want = {(rows[a][0], rows[b][0]) for a, b in itertools.combinations(range(len(rows)), 2) if s[a, b] >= threshold}
    assert {(r["i"], r["j"]) for r in vectors.similar_pairs(df, threshold, dims=8).collect()} == want


def test_greedy_groups_and_pairs_match_the_sequential_rule(spark):
    rows, df = _vectors(spark)
    rows = sorted(rows)
    s = _sims(rows)
    ids = [i for i, _ in rows]
    used, groups, mates, taken = set(), {}, set(), set()
    for a in range(len(ids)):
        if a not in used:
            for b in range(a, len(ids)):
                if b == a or (b not in used and s[a, b] > 0.75):
                    used.add(b)
                    groups[ids[b]] = ids[a]
        if a not in taken:
            for b in range(a + 1, len(ids)):
                if b not in taken and s[a, b] >= 0.65:
                    taken |= {a, b}
                    mates.add((ids[a], ids[b]))
                    break
    assert {r["id"]: r["leader"] for r in clusters.threshold_groups(df, 0.75, dims=8).collect()} == groups
    assert {(r["i"], r["j"]) for r in clusters.seed_pairs(df, 0.65, dims=8).collect()} == mates


def test_orphan_flow_keeps_every_item_once(spark):
    rows, df = _vectors(spark)
    out = clusters.orphan_flow(df, 0.9, 0.6, 2, dims=8).collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _ in rows)


def test_long_chain_components(spark):
    edges = spark.range(0, 60).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert {r["component"] for r in clusters.components(edges).collect()} == {0}


def test_ann_rows_are_exact_rows(spark):
    rows, df = _vectors(spark)
    q = df.select(F.col("id").alias("query_id"), "vec")
    ann = vectors.ann_with_exact_fallback(q, df, 3, 0.5, tables=4, bits=3, dims=8).collect()
    s, pos = _sims(rows), {i: n for n, (i, _) in enumerate(rows)}
    assert all(abs(s[pos[r["query_id"]], pos[r["id"]]] - r["cosine"]) < 1e-6 for r in ann)
    assert {r["query_id"] for r in ann} == {i for i, _ in rows}


def test_phrase_and_short_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Alpha beta-gamma"), (2, "alphabet"), (3, "beta, gamma"), (4, None)], "id long, text string")
    terms = spark.createDataFrame([("alpha",), ("a",), ("beta-gamma",), ("zz",), (",",)], "term string")
    want = {("alpha", 1), ("alpha", 2), ("a", 1), ("a", 2), ("a", 3), ("beta-gamma", 1), (",", 3)}
    got = lambda: {(r["term"], r["id"]) for r in lexical.term_matches(terms, docs, "id", [F.col("text")]).collect()}
    assert got() == want
    monkeypatch.setattr(lexical, "BROADCAST_HITS", 0)
    assert got() == want
    monkeypatch.setattr(lexical, "SALT_ROWS", 1)
    assert got() == want


def test_as_of_truth_table(spark):
    d = lambda n: f"2024-01-{n:02d}"
    mem = spark.createDataFrame([("A", d(1), "archived"), ("B", d(5), "archived"), ("C", d(9), "active"), ("X", d(1), "archived")], "memory_id string, c string, status string").withColumn("created_at", F.col("c").cast("timestamp"))
    e = spark.createDataFrame(
        [("A", "B", "supersedes", d(5), d(4)), ("B", "C", "supersedes", d(9), None), ("X", None, "withdraws", d(7), d(7))],
        "from_id string, to_id string, relation_type string, r string, f string",
    ).select("from_id", "to_id", "relation_type", F.col("r").cast("timestamp").alias("recorded_at"), F.col("f").cast("timestamp").alias("effective_at"))
    members, errors = versions.chains(mem, e)
    assert errors.count() == 0
    asked = [("before", "A", "2023-12-31"), ("exact", "A", d(5)), ("between", "C", d(6)), ("after", "B", d(20)), ("gone", "X", d(8)), ("still", "X", d(6))]
    rq = spark.createDataFrame(asked, "request_id string, memory_id string, t0 string").select("request_id", "memory_id", F.col("t0").cast("timestamp").alias("t"))
    got = lambda b: {r["request_id"]: (r["status"], r["current_id"]) for r in versions.as_of(rq, members, mem, e, b).collect()}
    assert got("recorded") == {"before": ("absent", None), "exact": ("active", "B"), "between": ("active", "B"), "after": ("active", "C"), "gone": ("withdrawn", None), "still": ("active", "X")}
    eff = got("effective")
    assert eff["exact"] == ("indeterminate", None) and eff["before"] == ("absent", None) and eff["gone"] == ("withdrawn", None)


def test_wide_and_narrow_ranges(spark):
    r = spark.createDataFrame([(1, 0, 100000), (2, 63, 65), (3, 64, 64), (4, 500, 501), (5, 4096, 8192)], "n long, lo long, hi long")
    p = spark.range(0, 9000, 7).withColumnRenamed("id", "p")
    got = {(x["n"], x["p"]) for x in lineage.contained_in_ranges(p, r, "p", "lo", "hi", bucket=64).collect()}
    want = {(n, v) for n, lo, hi in [(1, 0, 100000), (2, 63, 65), (3, 64, 64), (4, 500, 501), (5, 4096, 8192)] for v in range(0, 9000, 7) if lo <= v < hi}
    assert got == want


def test_ranges_of_any_width(spark):
    bounds = [(1, 0, 4 * 10**10), (2, 10, 11), (3, -(10**12), 10**12), (4, 3 * 10**10, 3 * 10**10 + 5), (5, 0, 10**15)]
    r = spark.createDataFrame(bounds, "n long, lo long, hi long")
    points = [5, 10, 10**10, 3 * 10**10, 3 * 10**10 + 4, 10**12, -(10**12), -1, 10**15 - 1, 10**15]
    p = spark.createDataFrame([(x,) for x in points], "p long")
    for bucket in (1, 64, 1024):
        got = {(x["n"], x["p"]) for x in lineage.contained_in_ranges(p, r, "p", "lo", "hi", bucket=bucket).collect()}
        assert got == {(n, v) for n, lo, hi in bounds for v in points if lo <= v < hi}
    assert lineage.contained_in_ranges(p, r.limit(0), "p", "lo", "hi").count() == 0


def test_greedy_rules_settle_long_paths(spark):
    n = 1000
    path = spark.range(0, n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    chosen = sorted(r["id"] for r in clusters.greedy_leaders(spark.range(n), path).collect())
    assert chosen == list(range(0, n, 2))
    pairs = sorted((r["i"], r["j"]) for r in clusters.greedy_pairs(path).collect())
    assert pairs == [(k, k + 1) for k in range(0, n, 2)]
    members = spark.range(n).select("id", F.col("id").alias("rep"))
    pairs = sorted((r["i"], r["j"]) for r in clusters._group_pairs(members, path, 2).collect())
    assert pairs == [(k, k + 1) for k in range(0, n, 2)]


def test_greedy_finish_equals_rounds(spark):
    import random

    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(150)})
    e = spark.createDataFrame(edges, "i long, j long")
    lead, used, pairs = [], set(), []
    for v in range(80):
        if not any((u, v) in edges for u in lead if u < v):
            lead.append(v)
    for a, b in edges:
        if a not in used and b not in used:
            used |= {a, b}
            pairs.append((a, b))
    for rounds in (1, 2, 8):
        assert sorted(r["id"] for r in clusters.greedy_leaders(spark.range(80), e, rounds).collect()) == lead
        assert sorted((r["i"], r["j"]) for r in clusters.greedy_pairs(e, rounds).collect()) == pairs


def test_mutual_neighbours_leave_out_the_item_itself(spark):
    copies = [(i, [1.0, 0.0]) for i in range(5)] + [(5, [0.0, 1.0])]
    df = spark.createDataFrame(copies, "id long, vec array<double>")
    near = vectors.top_k_cosine(df.select(F.col("id").alias("query_id"), "vec"), df, 2, 0.5, dims=2, but_own=True)
    got = {}
    for r in near.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == {0: {1, 2}, 1: {0, 2}, 2: {0, 1}, 3: {0, 1}, 4: {0, 1}}
    comp = {r["id"]: r["component"] for r in clusters.mutual_knn_components(df, 2, 0.5, dims=2).collect()}
    assert comp == {0: 0, 1: 0, 2: 0}


def test_a_provider_that_returns_too_few_vectors_fails_the_batch(spark):
    fn = lambda texts: [[1.0]] * (len(texts) - 1 if len(texts) > 1 else 1)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert {r["outcome"] for r in providers.embed(df, "id", "t", fn).collect()} == {"ok"}
    none = lambda texts: []
    assert {r["error_class"] for r in providers.embed(df, "id", "t", none).collect()} == {"invalid_input"}


def test_embedding_failures_become_rows(spark):
    def fn(texts):
        if any("bad" in t for t in texts):
            raise TimeoutError("slow")
        return [[0.0] if t == "zero" else [1.0] for t in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "zero"), (4, " "), (5, "ok")], "id long, t string")
    out = {r["id"]: (r["outcome"], r["error_class"], r["retryable"]) for r in providers.embed(df, "id", "t", fn).collect()}
    assert out == {1: ("ok", None, False), 2: ("failed", "timeout", True), 3: ("failed", "zero_vector", False), 4: ("skipped", None, False), 5: ("ok", None, False)}


def test_rerank_hook_is_all_or_nothing(spark):
    c = spark.createDataFrame([(1, "q", "a", 1, "xx"), (1, "q", "b", 2, "y"), (2, "q", "c", 1, "z")], "query_id long, query string, source_id string, rank int, text string")
    fn = lambda q, docs: [float(len(d)) for d in docs] if len(docs) > 1 else []
    assert {(r["source_id"], r["rerank_score"]) for r in providers.rerank_scores(c, fn).collect()} == {("a", 2.0), ("b", 1.0), ("c", None)}


def test_rebuild_resumes(spark, tmp_path):
    from mnemolake.plans import rebuild

    rows = spark.range(1, 101).select("id", F.lit(1.0).alias("cost"))
    go = lambda: rebuild.run(rows, lambda d: d.select("id"), str(tmp_path), 10, 25.0)
    go()
    assert spark.read.parquet(f"{tmp_path}/data").count() == 30
    go()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/data").collect()) == list(range(1, 61))


def test_every_query_has_a_twin_or_a_reason():
    import __spark_entry__ as e
    from mnemolake.catalog import all_queries

    # the optional training-data part lists its own
    no_sql = (set(e.queries()) - set(e.oracle_sql())) & set(all_queries())
    assert no_sql == {
        "ann_with_fallback", "recall_trace", "embedding_outcomes",
    }
