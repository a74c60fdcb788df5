import json

import pytest
import zstandard

from mnemolake.sources import readers
from pyspark.sql import functions as F


def put(folder, name, rows):
    p = folder / name
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(p)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.orderBy("artifact", "ord").collect())


TREE = [
    {"type": "session", "id": "S1", "version": 3, "cwd": "/w"},
    {"type": "message", "id": "a", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": " hi "}},
    {"type": "message", "id": "b", "message": {"role": "assistant", "content": [{"type": "text", "text": "x "}, {"type": "image"}, {"type": "text", "text": "y"}]}},
    {"type": "custom", "id": "c"},
    {"type": "message", "id": "d", "message": {"role": "custom", "content": "no"}},
    {"type": "message", "id": "e", "message": {"role": "tool", "content": "no"}},
    {"type": "message", "id": "f", "message": {"role": "user", "content": []}},
    {"type": "message", "message": {"role": "user", "content": '[{"type":"thinking"}]'}},
    "{broken",
]


def test_session_tree(spark, tmp_path):
    t = readers.session_tree(spark, put(tmp_path, "s.jsonl", TREE))
    rows = got(readers.kept(t), "ord", "event_id", "role", "content", "session_id")
    assert rows == [(2, "a", "user", "hi", "S1"), (3, "b", "assistant", "x\n\ny", "S1"), (8, None, "user", '[{"type":"thinking"}]', "S1")]
    assert {r["skip_reason"]: r["n"] for r in readers.skips(t).collect()} == {
        "skipped_entries": 1, "skipped_injected": 1, "skipped_roles": 1, "skipped_empty": 1, "malformed": 1,
    }


def test_session_tree_bad_version(spark, tmp_path):
    t = readers.session_tree(spark, put(tmp_path, "s.jsonl", [{"type": "session", "id": "S", "version": 99}, TREE[1]]))
    assert [r["skip_reason"] for r in t.collect()] == ["skipped_version"]


def test_line_numbers_when_split(spark, tmp_path, sliced):
    path = put(tmp_path, "big.txt", [f"line {i}" for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = readers.lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r["value"] == f"line {r['line_no'] - 1}" for r in rows) and len(rows) == 2000


def test_event_log_multi_frame_zstd(spark, tmp_path):
    rows = [
        {"type": "session", "id": "Z", "version": 4},
        {"type": "user/message", "time": 1767225600000, "data": {"id": "u1", "source": {"kind": "user"}, "content": "q"}},
        {"type": "user/message", "time": 1, "data": {"id": "u2", "source": {"kind": "runtime"}, "content": "q"}},
        {"type": "assistant/message", "time": 1767225601000, "data": {"message": {"id": "a1", "content": [{"type": "text", "text": "ans"}]}}},
        {"type": "assistant/message", "time": 1, "data": {"interrupted": True, "message": {"id": "a2", "content": "cut"}}},
        {"type": "turn/start"},
    ]
    raw = [(json.dumps(r) + "\n").encode() for r in rows]
    c = zstandard.ZstdCompressor()
    p = tmp_path / "e.jsonl.zst"
    p.write_bytes(c.compress(b"".join(raw[:3])) + c.compress(b"".join(raw[3:])))
    t = readers.event_log(spark, str(p))
    assert got(readers.kept(t), "event_id", "role", "content", "occurred_at") == [
        ("a1", "assistant", "ans", "2026-01-01T00:00:01Z"), ("u1", "user", "q", "2026-01-01T00:00:00Z"),
    ]
    assert {r["skip_reason"] for r in readers.skips(t).collect()} == {"skipped_injected", "skipped_interrupted", "skipped_entries"}


def test_message_table_maps_columns(spark):
    m = spark.createDataFrame(
        [("c1", "user", "hello", 1767225600.0, None, "1"), ("c1", "assistant", "yo", 1767225601.0, "U", "2"), ("c2", "user", "h", 1.0, None, "3")],
        "conversation_id string, Speaker string, body string, created double, uid string, id string",
    ).withColumn("display_kind", F.when(F.col("id") == "3", "hidden"))
    s = spark.createDataFrame([("c1", "tui")], "id string, source string")
    assert readers.map_columns(m.columns)["role"] == "Speaker"
    t = readers.kept(readers.message_table(m, s))
    rows = got(t, "ord", "session_id", "role", "content", "occurred_at", "session_source", "identity_kind")
    assert rows == [
        (1, "c1", "user", "hello", "2026-01-01T00:00:00Z", "tui", "content-hash"),
        (2, "c1", "assistant", "yo", "2026-01-01T00:00:01Z", "tui", "native"),
    ]


@pytest.mark.parametrize("doc", [
    [{"role": "user", "text": "a", "id": 5}, {"speaker": "bot", "body": "b", "thread_id": "T"}],
    {"records": [{"role": "user", "text": "a", "id": 5}, {"speaker": "bot", "body": "b", "thread_id": "T"}]},
])
def test_json_document(spark, tmp_path, doc):
    p = tmp_path / "x.json"
    p.write_text(json.dumps(doc, indent=1))
    rows = got(readers.kept(readers.json_document(spark, str(p))), "ord", "role", "content", "event_id", "session_id")
    assert rows == [(1, "user", "a", "5", "ungrouped:x.json"), (2, "bot", "b", None, "T")]


def test_json_lines_and_normalized(spark, tmp_path):
    p = put(tmp_path, "a.jsonl", [{"role": "user", "content": "a", "session_id": "s", "timestamp": "2026-01-01"}, "nope", {"role": "user", "content": ""}])
    t = readers.json_lines(spark, p)
    assert got(readers.kept(t), "content", "session_id") == [("a", "s")]
    assert {r["skip_reason"]: r["n"] for r in readers.skips(t).collect()} == {"malformed": 1, "skipped_empty": 1}
    p = put(tmp_path, "n.jsonl", [
        {"session_id": "s", "content": "hi", "role": "other", "peer": "ou_9", "ts": 1767225600000},
        {"session_id": "s", "content": "[SILENT] x", "role": "assistant"}, {"content": "x"},
    ])
    t = readers.normalized_jsonl(spark, p)
    assert got(readers.kept(t), "role", "content", "occurred_at") == [("user", "hi", "2026-01-01T00:00:00.000Z")]


def test_trajectory(spark, tmp_path):
    stamp = "[Wed 2026-04-22 01:59 GMT+8] "
    ev = [
        {"type": "session.started", "data": {"sessionKey": "K1"}},
        {"type": "prompt.submitted", "ts": "2026-01-01T00:00:00Z", "data": {"prompt": f"{stamp}first\nnoise\n{stamp}second"}},
        {"type": "model.completed", "ts": "2026-01-01T00:00:05Z", "data": {"assistantTexts": ["one", "HEARTBEAT_OK", "two"]}},
        {"type": "session.started", "data": {"sessionKey": "a:cron:b"}},
        {"type": "prompt.submitted", "data": {"prompt": f"{stamp}dropped"}},
    ]
    t = readers.kept(readers.trajectory(spark, put(tmp_path, "t.jsonl", ev)))
    assert got(t, "ord", "role", "content", "session_id") == [
        (2000, "user", "first", "K1"), (2001, "user", "second", "K1"), (3000, "assistant", "one", "K1"), (3002, "assistant", "two", "K1"),
    ]


def test_checkpoint_snapshots_collapse(spark, tmp_path):
    row = {"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": [{"type": "text", "text": "same"}]}}
    put(tmp_path, "sess.checkpoint.0a1b2c3d-11.jsonl", [row])
    put(tmp_path, "sess.checkpoint.0a1b2c3e-22.jsonl", [row, {"type": "model_change"}])
    t = readers.kept(readers.checkpoint_messages(spark, str(tmp_path)))
    assert t.count() == 2 and t.select("session_id", "event_id").distinct().count() == 1


def test_peer_csv_and_copy_dump(spark, tmp_path):
    p = put(tmp_path, "m.csv", ["id,peer_name,content,session_name,created_at,seq_in_session", '1,owner,"line1\nline2 ""q""",S,2026-01-01 00:00:00+00,1', "2,agent-x,ok,S,2026-01-01 00:00:01+00,2"])
    rows = got(readers.kept(readers.peer_csv(spark, p)), "event_id", "role", "content", "occurred_at")
    assert rows == [("1", "user", 'line1\nline2 "q"', "2026-01-01T00:00:00.000Z"), ("2", "assistant", "ok", "2026-01-01T00:00:01.000Z")]
    p = put(tmp_path, "d.sql", ["SET x;", 'COPY public.messages (id, content, peer_name, session_name, created_at) FROM stdin;', "7\ta\\nb\\\\c\tbot\tS\t2026-01-01 00:00:00", "8\t\\N\towner\tS\t\\N", "short", "\\.", "9\tafter\towner\tS\t\\N"])
    t = readers.copy_dump(spark, p)
    assert got(readers.kept(t), "event_id", "role", "content") == [("7", "assistant", "a\nb\\c")]
    assert [(r["skip_reason"], r["n"]) for r in readers.skips(t).collect()] == [("empty", 1)]


def test_chat_markdown(spark, tmp_path, sliced):
    p = put(tmp_path, "2026-01-05.md", ["---", "date: 2026-01-05", "---", "### 09:30", "- 👤 hello", "- 🤖 **10:05**: reply", "- 🍬 system", "## 2026-01-06", "- 👤 next"])
    rows = got(readers.kept(readers.chat_markdown(spark, p)), "ord", "role", "content", "occurred_at", "event_id")
    assert rows == [
        (5, "user", "hello", "2026-01-05T09:30:00Z", "2026-01-05:1"), (6, "assistant", "reply", "2026-01-05T10:05:00Z", "2026-01-05:2"),
        (9, "user", "next", "2026-01-06T09:30:00Z", "2026-01-05:3"),
    ]


def test_shapes_and_census(spark, tmp_path):
    put(tmp_path, "a.jsonl", [{"type": "session.started"}])
    put(tmp_path, "b.jsonl", [{"session_id": "s", "content": "c", "role": "user", "ts": "2026-01-01"}])
    put(tmp_path, "c.jsonl", [{"type": "message"}])
    put(tmp_path, "d.csv", ["id,peer_name"])
    put(tmp_path, "e.sql", ["x", "COPY public.messages (a) FROM stdin;"])
    put(tmp_path, "f.md", ["- 👤 x"])
    put(tmp_path, "g.bin", ["?"])
    shapes = readers.detect_shapes(spark, str(tmp_path))
    assert {r["artifact"][-5:-4] + r["artifact"][-4:] if False else r["artifact"].rsplit("/", 1)[1]: r["shape"] for r in shapes.collect()} == {
        "a.jsonl": "trajectory", "b.jsonl": "normalized_jsonl", "c.jsonl": "message_events", "d.csv": "peer_csv", "e.sql": "copy_dump", "f.md": "chat_md", "g.bin": "unknown",
    }
    c = readers.census(shapes, readers.normalized_jsonl(spark, str(tmp_path / "b.jsonl")))
    assert c.filter("shape = 'normalized_jsonl'").first()["rows"] == 1


def test_failure_markers(spark, tmp_path):
    good = {"job_id": "j", "pending": {"q_msg_id": "q"}, "embedding_status": "failed", "error_class": "timeout", "embedding_attempts": 2, "embedding_next_retry_at": 10.0}
    put(tmp_path, "1.json", [good])
    put(tmp_path, "2.json", ["{bad"])
    put(tmp_path, "3.json", ["[1]"])
    put(tmp_path, "4.json", [{"pending": {}}])
    put(tmp_path, "5.json", [{"job_id": "k"}])
    put(tmp_path, "6.json", [{"job_id": "m", "pending": {}, "embedding_attempts": 0}])
    rows = {r["artifact"][-6:-5]: r for r in readers.failure_markers(spark, str(tmp_path), F.current_timestamp()).collect()}
    assert {k: (v["status"], v["malformed_reason"]) for k, v in rows.items()} == {
        "1": ("retry_due", None), "2": ("malformed", "json_error"), "3": ("malformed", "not_object"),
        "4": ("malformed", "missing_job_id"), "5": ("malformed", "missing_pending"), "6": ("pending", None),
    }
    assert rows["1"]["question_id"] == "q" and rows["1"]["generation"] == "v2"


def test_large_markers_are_listed_but_not_opened(spark, tmp_path):
    put(tmp_path, "1.json", [{"job_id": "j", "pending": {}, "embedding_attempts": 0, "pad": "x" * 4000}])
    put(tmp_path, "2.json", [{"job_id": "k", "pending": {}, "embedding_attempts": 0}])
    found = readers.failure_markers(spark, str(tmp_path), F.current_timestamp(), max_bytes=1000)
    assert {r["artifact"][-6:-5]: (r["job_id"], r["malformed_reason"]) for r in found.collect()} == {"1": (None, "oversize"), "2": ("k", None)}
    plan = found._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,1000)" in plan and "GreaterThan(length,1000)" in plan


def test_copy_line_far_down_names_the_dump(spark, tmp_path):
    put(tmp_path, "e.sql", ["-- x"] * 1000 + ["COPY public.messages (a) FROM stdin;"])
    (tmp_path / "empty.jsonl").touch()
    put(tmp_path, "blank.jsonl", [])
    got = {r["artifact"].rsplit("/", 1)[1]: (r["shape"], r["n_lines"]) for r in readers.detect_shapes(spark, str(tmp_path)).collect()}
    assert got == {"e.sql": ("copy_dump", 1001), "blank.jsonl": ("unknown", 1)}
