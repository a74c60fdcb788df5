import json

from pyspark.sql import functions as F

from mnemolake.plans import corrections, recall
from mnemolake.sources import sinks


def test_memory_sink_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "curated", "md", "A.md", " body ", None, None, ["x", "x"], None), (2, "legacy", "old", "r", "body", None, "T", None, {"kind": "mine"}), (3, "raw", "r", "r", "no", None, None, None, None), (4, "curated", "md", "A.md", "body", None, None, ["x"], None)],
        "ord long, kind string, source_system string, source_ref string, text string, category string, title string, tags array<string>, provenance map<string,string>",
    )
    path = str(tmp_path / "m")
    for _ in range(2):
        sinks.append_memories(rows, F.lit("2026-01-01"), path)
    got = {r["ord"]: r for r in spark.read.parquet(path).collect()}
    assert set(got) == {1, 2}
    assert got[1]["tags"] == ["x", "user-curated"] and got[1]["provenance"]["kind_marker"] == "user-curated"
    assert got[2]["provenance"]["kind"] == "mine" and "original_text_sha256" in got[2]["provenance"]


def test_version_overwrite_and_evaluation_outputs(spark, tmp_path):
    s = spark.createDataFrame([("v1", "a"), ("v1", "b"), ("v2", "c")], "version string, section string")
    sinks.replace_version(s, str(tmp_path / "s"))
    sinks.replace_version(s.filter("section = 'a'"), str(tmp_path / "s"))
    assert {tuple(sorted(r)) for r in spark.read.parquet(str(tmp_path / "s")).select("version", "section").collect()} == {("a", "v1"), ("c", "v2")}
    lat = s.withColumn("ms", F.lit(1.5))
    one = sinks.write_evaluation(s, lat, str(tmp_path / "e"), {"k": 5}).first()
    two = sinks.write_evaluation(s.repartition(3), lat.repartition(2), str(tmp_path / "e"), {"k": 5}).first()
    assert one == two and one["results_rows"] == 3 and json.loads(one["settings"]) == {"k": 5}


def test_correction_reaches_the_ledger(spark):
    req = spark.createDataFrame(
        [(1, "m1", "replace", "new", None, None, None, None, "explicit_user"), (2, "m1", "withdraw", None, None, None, None, None, "explicit_user"), (3, "m2", "withdraw", None, None, None, None, None, "explicit_user"), (4, "m3", "replace", "x", None, None, None, "2026-01-01", "explicit_user")],
        "req_no long, memory_id string, mode string, replacement_content string, replacement_title string, correction_reason string, correction_source_id string, effective_at string, authority string",
    )
    mem = spark.createDataFrame([("m1", "active", "c", "t"), ("m2", "active", "c", "t"), ("m3", "active", "c", "t")], "memory_id string, status string, category string, title string")
    edges = spark.createDataFrame([], "from_id string, correction_id string")
    src = spark.createDataFrame([], "source_id long, role string")
    prov = spark.createDataFrame([("m1", "7", None), ("m2", None, "20")], "memory_id string, stream_id string, qa_id string")
    stream = spark.createDataFrame([(7, "user", "h", "s", "e")], "id long, role string, host string, session_id string, event_id string")
    qa = spark.createDataFrame([(10, "qa_sync/h/s/e"), (20, "x")], "id long, source_id string")
    entries = spark.createDataFrame([(10, "t9")], "source_qa_id long, topic_id string")
    notes = spark.createDataFrame([(5, 8, 15)], "note_id long, lo long, hi long")
    out = corrections.run(req, mem, edges, src, prov, stream, qa, entries, notes, F.current_timestamp())
    assert {r["req_no"]: r["result"] for r in out["results"].collect()} == {1: "COMMITTED", 2: "TARGET_NOT_CURRENT", 3: "COMMITTED", 4: "INVALID_REQUEST"}
    assert {(r["from_id"], r["relation_type"]) for r in out["edges"].collect()} == {("m1", "supersedes"), ("m2", "withdraws")}
    assert out["memories"].count() == 1
    assert {(r["derived_kind"], r["derived_id"]) for r in out["ledger"].collect()} == {("topic", "t9"), ("observer_note", "5")}
    assert [r["qa_id"] for r in out["unmapped"].collect()] == [20]


def test_recall_drops_nothing_without_a_reason(spark):
    def item(i, kind, text, far):
        return (i, kind, text, [1.0, far] + [0.0] * 62, "2024-01-01 00:00:00")

    # 60 plain matches each way; 90 is an exact match whose lexical score is that of the others or less
    found = [item(i, "qa", "common words", 0.01 * i) for i in range(60)] + [item(90, "qa", "zebra", 2.0)]
    found += [item(200 + i, "note", "other", 0.01 * i) for i in range(60)]
    items = spark.createDataFrame(found, "id long, kind string, text string, vec array<double>, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    queries = spark.createDataFrame([(1, "common words zebra", [1.0] + [0.0] * 63)], "query_id long, text string, vec array<double>")
    ledger = spark.createDataFrame([("note", f"note_{200 + i}") for i in range(5)], "derived_kind string, derived_id string")
    got = {r["source_id"]: r for r in recall.recall(queries, items, ledger, F.lit("2024-02-01").cast("timestamp"), path_k=5).collect()}
    # every match is there but the suppressed ones, whose places go to the next
    assert set(got) == {f"{k}_{i}" for i, k, *_ in found} - {f"note_{200 + i}" for i in range(5)}
    assert all(got[f"note_{205 + i}"]["votes"] == 1 for i in range(5))
    outside = {s for s, r in got.items() if r["drop_reason"] == "OUTSIDE_LANE"}
    assert {f"note_{i}" for i in range(210, 260)} <= outside and not any(got[s]["selected"] or got[s]["position"] for s in outside)
    ranked = sorted(r["position"] for s, r in got.items() if s not in outside)
    assert ranked == list(range(1, len(ranked) + 1))
    assert got["qa_90"]["boosted"] == 1 and got["qa_90"]["selected"]


def test_recall_promotes_an_exact_match_behind_the_lane(spark):
    # every text has a rare word of its own, so all lexical scores are equal and the id decides the lane's place
    found = [(i, "qa", f"word{i}", [0.0, 1.0] + [0.0] * 62, "2024-01-01 00:00:00") for i in range(1, 5)]
    items = spark.createDataFrame(found, "id long, kind string, text string, vec array<double>, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    queries = spark.createDataFrame([(1, "word1 word2 word3 word4", [1.0] + [0.0] * 63)], "query_id long, text string, vec array<double>")
    ledger = spark.createDataFrame([("qa", "qa_1"), ("qa", "qa_2")], "derived_kind string, derived_id string")
    got = {r["source_id"]: r for r in recall.recall(queries, items, ledger, F.lit("2024-02-01").cast("timestamp"), path_k=1).collect()}
    assert set(got) == {"qa_3", "qa_4"}
    assert got["qa_3"]["votes"] == 2 and got["qa_4"]["votes"] == 0
    assert got["qa_4"]["boosted"] == 1 and got["qa_4"]["selected"] and got["qa_4"]["drop_reason"] is None
