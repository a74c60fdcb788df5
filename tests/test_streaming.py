import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import pairing
from mnemolake.streaming import steps, turns

SCHEMA = "host string, session_id string, ord long, event_id string, kind string, role string, content string, machine boolean, has_tools boolean, ts timestamp, host_turn_id string"
T0 = dt.datetime(2026, 1, 1)
END = ("h", "zz", 0, "end", "REAL_USER", "user", "bye", False, False, T0 + dt.timedelta(days=9), None)


def ev(session, ord_, kind, text, minute, turn=None, tools=False, machine=False):
    role = {"REAL_USER": "user", "NORMAL_ASSISTANT": "assistant"}.get(kind, "other")
    return ("h", session, ord_, f"{session}{ord_}", kind, role, text, machine, tools, T0 + dt.timedelta(minutes=minute), turn)


def run(spark, tmp_path, batches, build):
    src, name = tmp_path / "in", f"t{abs(hash(str(tmp_path))) % 10**9}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        if i == 0:
            stream = spark.readStream.schema(SCHEMA).parquet(str(src))
            q = build(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_turns_deliveries_late_and_idle(spark, tmp_path):
    first = [
        ev("a", 1, "REAL_USER", "q1", 0, "t1"), ev("a", 2, "NORMAL_ASSISTANT", "working", 1, "t1", tools=True),
        ev("a", 3, "NORMAL_TOOL", "x", 1), ev("a", 4, "NORMAL_ASSISTANT", "done", 2, "t1"), ev("a", 5, "CONTROL", "c", 2),
        ev("a", 6, "REAL_USER", "q2", 3, "t2"),
        ev("b", 1, "ASYNC_BOUNDARY", "[ASYNC", 0), ev("b", 2, "NORMAL_ASSISTANT", "part1", 1), ev("b", 3, "NORMAL_ASSISTANT", "part2", 2),
        ev("b", 4, "REAL_USER", "thanks", 3), ev("c", 1, "NORMAL_ASSISTANT", "orphan", 1, "tX"),
    ]
    second = [ev("a", 7, "NORMAL_ASSISTANT", "postscript", 5, "t1"), ev("a", 8, "NORMAL_ASSISTANT", "a2", 6, "t2")]
    out = run(spark, tmp_path, [first, second, [END], [END[:3] + ("end2",) + END[4:]]], lambda s: turns.live_turns(s.drop("role"), "1 minute"))
    rows = {(r["session_id"], r["output"], r["q_event_id"]): r for r in out.filter("session_id <> 'zz'").collect()}
    assert rows[("a", "qa", "a1")]["answer"] == "done"
    assert rows[("a", "qa", "a6")]["answer"] == "a2"
    assert rows[("b", "delivery", "b1")]["answer"] == "part1\npart2" and rows[("b", "delivery", "b1")]["event_ids"] == ["b2", "b3"]
    assert ("b", "incomplete", "b4") in rows
    late = [r for k, r in rows.items() if k[1] == "late"]
    assert [(r["source_id"], r["answer"]) for r in late] == [("qa_sync/h/a/a1", "postscript")]
    assert [r["answer"] for k, r in rows.items() if k[1] == "held"] == ["orphan"]
    pairs = {r["source_id"]: r["answer"] for r in steps.latest_pairs(out).collect()}
    assert pairs["qa_sync/h/a/a1"] == "done\npostscript"


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for s in range(4):
        for i in range(17):
            kind = ("REAL_USER", "REAL_USER", "NORMAL_ASSISTANT", "NORMAL_ASSISTANT", "NORMAL_TOOL")[(i + s) % 5]
            rows.append(ev(f"s{s}", i, kind, f"text {s} {i}", i, tools=(i % 7 == 2)))
    out = run(spark, tmp_path, [rows[:40], rows[40:], [END], [END[:3] + ("end2",) + END[4:]]], lambda s: turns.live_turns(s.drop("role"), "30 minutes", merge_unanswered=True))
    live = {(r["session_id"], r["q_event_id"], r["question"], r["answer"]) for r in out.filter("output = 'qa'").collect()}
    m = spark.createDataFrame(rows, SCHEMA).withColumns({
        "occurred_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "session_source": F.lit("tui"),
        "tool_calls": F.when(F.col("has_tools"), '[{"n":1}]').otherwise("[]"),
    }).filter("role in ('user', 'assistant')")
    batch = {(r["session_id"], r["q_event_id"], r["question"], r["answer"]) for r in pairing.qa_pairs(m).collect()}
    assert live == batch and len(batch) > 8


def test_dedupe_and_gap_windows(spark, tmp_path):
    one = [ev("a", 1, "REAL_USER", "x", 0), ev("a", 1, "REAL_USER", "x", 0), ev("a", 2, "REAL_USER", "y", 3)]
    out = run(spark, tmp_path, [one, one + [ev("a", 3, "REAL_USER", "z", 4)]], lambda s: turns.deduplicated(s).select("event_id"))
    assert sorted(r[0] for r in out.collect()) == ["a1", "a2", "a3"]


def test_gap_windows_match_batch(spark, tmp_path):
    rows = [ev("a", i, "REAL_USER", "x", m) for i, m in enumerate((0, 1, 2, 30, 31, 90))]
    out = run(spark, tmp_path, [rows, [END], [END[:3] + ("end2",) + END[4:]]], lambda s: turns.gap_windows(s, "session_id", "5 minutes", "1 minute"))
    assert sorted(r["n"] for r in out.filter("session_id = 'a'").collect()) == [1, 2, 3]


def test_receipts(spark):
    batch = spark.createDataFrame([("h", "s", 1, "e1", "x"), ("h", "s", 2, "e1", "x"), ("h", "s", 3, "old", "x"), ("h", "s", 4, "", "x"), ("h", "s", 5, "e5", " ")], "host string, session_id string, ord long, event_id string, content string")
    store = batch.filter("event_id = 'old'")
    assert [r["receipt"] for r in steps.receipts(batch, store).orderBy("ord").collect()] == ["accepted", "duplicate", "duplicate", "rejected", "rejected"]


def test_trigger_and_raw_steps_survive_replay(spark, tmp_path):
    qa = "id long, session_id string, ts timestamp, question string, answer string"
    b0 = spark.createDataFrame([(1, "s1", T0, "q" * 30, "a" * 30)], qa)
    b1 = spark.createDataFrame([(2, "s1", T0, "q" * 30, "a" * 30)], qa)
    known = spark.createDataFrame([("s1",)], "session_id string")
    step = steps.trigger_step(str(tmp_path), known, F.lit(T0), chars_at=100)
    step(b0, 0)
    step(b1, 1)
    step(b1, 1)
    got = {r["batch_id"]: (r["reason"], r["unobs_chars"]) for r in spark.read.parquet(f"{tmp_path}/decisions/*").collect()}
    assert got == {0: (None, 60), 1: ("token", 120)}
    raw = "host string, session_id string, ord long, event_id string, role string, content string, occurred_at string"
    put = steps.raw_step(str(tmp_path / "raw"))
    r0 = spark.createDataFrame([("h", "s", 1, "a", "user", "x", "t"), ("h", "s", 2, "a", "user", "x", "t")], raw)
    r1 = spark.createDataFrame([("h", "s", 3, "a", "user", "x", "t"), ("h", "s", 4, "b", "user", "y", "t")], raw)
    put(r0, 0)
    put(r1, 1)
    put(r1, 1)
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == ["a", "b"]


def test_receipts_of_batches_survive_replay(spark, tmp_path):
    event = "host string, session_id string, ord long, event_id string, content string"
    put = steps.receipt_step(str(tmp_path / "receipts"))
    first = spark.createDataFrame([("h", "s", 1, "a", "x"), ("h", "s", 2, "b", " ")], event)
    second = spark.createDataFrame([("h", "s", 3, "a", "x"), ("h", "s", 4, "b", "y"), ("h", "t", 5, "a", "x"), ("h", "s", 6, "b", "y")], event)
    put(first, 0)
    put(second, 1)
    put(second, 1)
    put(first, 0)
    got = {r["ord"]: r["receipt"] for r in spark.read.parquet(str(tmp_path / "receipts")).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "duplicate", 4: "accepted", 5: "accepted", 6: "duplicate"}
