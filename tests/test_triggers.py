"""The live trigger: four signals, one firing per backlog, debounce, and independence of micro-batches."""

import datetime as dt

import pytest

from mnemolake.streaming import triggers

SCHEMA = "host string, session_id string, ts timestamp, question string, answer string"
T0 = dt.datetime(2026, 1, 1)


def qa(host, session, minute, chars, answer=True):
    return (host, session, T0 + dt.timedelta(minutes=minute, seconds=5), "q" * chars, "" if answer else None)


END = [qa("zz", "end", 60 * 24 * 3 + i, 1) for i in range(2)]
ROWS = [
    # a new session at once; 180 characters by minute 3 wait for the debounce until 9 and take the next row along; then the idle rest
    qa("a", "s", 0, 60), qa("a", "s", 1, 60), qa("a", "s", 2, 120), qa("a", "s", 3, 10), qa("a", "s", 30, 5),
    # count, although a null answer and an inspection session stand between
    qa("b", "s", 0, 1), qa("b", "s", 0, 1), qa("b", "s", 1, 900, answer=False), qa("b", "x.trajectory", 1, 900), qa("b", "s", 2, 1),
    # a new session of 40 characters; known afterwards, so its next 40 only pause
    qa("c", "n", 0, 20), qa("c", "n", 1, 20), qa("c", "n", 20, 40),
    qa("d", "s", 5, 1),
    # enough for every signal: the first in order names it
    qa("e", "s", 0, 140), qa("e", "s", 0, 1), qa("e", "s", 0, 1),
]
# minute ends: a row of minute m is known at m + 1
WANT = {
    ("a", 1, "new_session", 1, 60), ("a", 9, "token", 3, 190), ("a", 271, "pause", 1, 5),
    ("b", 3, "count", 3, 3), ("c", 2, "new_session", 2, 40), ("c", 261, "pause", 1, 40), ("d", 246, "pause", 1, 1),
    ("e", 1, "token", 3, 142),
}


def fired(spark, tmp_path, batches):
    src = str(tmp_path / "in")
    spark.createDataFrame(batches[0], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    out = triggers.live_triggers(
        spark.readStream.schema(SCHEMA).parquet(src), "1 minute", chars_at=130, count_at=3, new_session_at=40,
    )
    name = f"trig{abs(hash(str(tmp_path))) % 10**9}"
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    for rows in batches[1:]:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    q.stop()
    ms = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return {(r["host"], (r["fired_ms"] - ms) // 60_000, r["reason"], r["n"], r["chars"]) for r in spark.table(name).collect() if r["host"] != "zz"}


@pytest.mark.parametrize("parts", [1, 3])
def test_one_firing_per_backlog(spark, tmp_path, parts):
    rows = sorted(ROWS, key=lambda r: r[2])
    size = -(-len(rows) // parts)
    batches = [rows[i:i + size] for i in range(0, len(rows), size)] + [[END[0]], [END[1]]]
    assert fired(spark, tmp_path, batches) == WANT
