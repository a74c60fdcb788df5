"""Live pairing: one processor per (host, session) turns an event stream into pairs,
autonomous deliveries, late-answer updates and incomplete turns.

Watermarks bound the state: a turn is closed when its session has been idle for
``idle_ms`` of event time, and a closed turn can still take late assistant rows
for ``closed_ttl_ms``. What comes later than that is emitted as ``held`` for the
batch repair (``lineage.merge_late_answers``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = (
    "host string, session_id string, output string, source_id string, q_event_id string, "
    "question string, answer string, event_ids array<string>, trigger_kind string"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOUNDARIES = ("ASYNC_BOUNDARY", "NEW_ROOT")


def choose_answer(rows: list[dict]) -> str:
    """The batch answer rule on plain dicts (content, machine, tools)."""
    real = [r for r in rows if not r["machine"]]
    plain = [r for r in real if not r["tools"]]
    if not real:
        return ""
    if len(plain) == len(real):
        return "\n\n".join(r["content"].strip() for r in real)
    return (plain or real)[-1]["content"].strip()


class TurnProcessor(StatefulProcessor):
    """State: the open turn and the open delivery as JSON, closed turns by turn id."""

    def __init__(self, idle_ms: int, closed_ttl_ms: int, merge_unanswered: bool):
        self.idle_ms, self.closed_ttl_ms, self.merge = idle_ms, closed_ttl_ms, merge_unanswered

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "body string")
        self.delivery = handle.getValueState("delivery", "body string")
        # event-time jobs cannot use store TTL, so closed turns carry their own expiry
        self.closed = handle.getMapState("closed", "turn string", "source string, until bigint")

    def _load(self, state):
        return json.loads(state.get()[0]) if state.exists() else None

    def _row(self, key, output, turn, answer="", kind=None):
        host, session = key
        q = turn.get("q_event") or ""
        return {
            "host": host, "session_id": session, "output": output, "source_id": f"qa_sync/{host}/{session}/{q}" if kind is None else turn["source"],
            "q_event_id": q, "question": turn.get("question", ""), "answer": answer, "event_ids": turn.get("events", []), "trigger_kind": kind,
        }

    def _flush(self, key, turn, out, now):
        if turn is None:
            return
        answer = choose_answer(turn["answers"])
        row = self._row(key, "qa" if answer.strip() else "incomplete", turn, answer)
        out.append(row)
        if row["output"] == "qa" and turn.get("turn_id"):
            self.closed.updateValue((turn["turn_id"],), (row["source_id"], int(now + self.closed_ttl_ms)))
        self.open.clear()

    def _flush_delivery(self, key, group, out):
        if group and group["events"]:
            source = f"delivery/{key[0]}/{key[1]}/{group['q_event']}"
            out.append(self._row(key, "delivery", {**group, "source": source}, "\n".join(group["parts"]), group["kind"]))
        self.delivery.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "ord"], kind="stable")
        out: list[dict] = []
        turn, group = self._load(self.open), self._load(self.delivery)
        last = 0
        for r in batch.itertuples(index=False):
            now = int(pd.Timestamp(r.ts).value // 1_000_000)
            last = max(last, now)
            text = r.content or ""
            turn_id = getattr(r, "host_turn_id", None) or ""
            if r.kind == "REAL_USER":
                self._flush_delivery(key, group, out)
                group = None
                if turn is not None and self.merge and not turn["answers"]:
                    turn["question"] += "\n\n" + text.strip()
                    turn["events"].append(r.event_id)
                    continue
                self._flush(key, turn, out, now)
                turn = {"q_event": r.event_id, "question": text.strip(), "answers": [], "events": [r.event_id], "turn_id": turn_id}
            elif r.kind in BOUNDARIES:
                self._flush(key, turn, out, now)
                self._flush_delivery(key, group, out)
                turn, group = None, {"q_event": r.event_id, "kind": r.kind, "parts": [], "events": []}
            elif r.kind == "NORMAL_ASSISTANT" and text.strip():
                if group is not None:
                    group["parts"].append(text)
                    group["events"].append(r.event_id)
                elif turn is not None and (not turn_id or not turn["turn_id"] or turn_id == turn["turn_id"]):
                    turn["answers"].append({"content": text, "machine": bool(r.machine), "tools": bool(r.has_tools)})
                    turn["events"].append(r.event_id)
                elif turn_id and self.closed.containsKey((turn_id,)) and self.closed.getValue((turn_id,))[1] >= now:
                    owner = self.closed.getValue((turn_id,))[0]
                    row = self._row(key, "late", {"events": [r.event_id]}, text)
                    out.append({**row, "source_id": owner})
                elif turn_id or turn is None:
                    out.append({**self._row(key, "held", {"events": [r.event_id]}, text), "source_id": turn_id or None})
        for state, value in ((self.open, turn), (self.delivery, group)):
            if value is None:
                state.clear()
            else:
                state.update((json.dumps(value, ensure_ascii=False),))
        for old in list(self.closed.iterator()):
            if old[1][1] < last:
                self.closed.removeKey(old[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if turn is not None or group is not None:
            self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        self._flush(key, self._load(self.open), out, expiredTimerInfo.getExpiryTimeInMs())
        self._flush_delivery(key, self._load(self.delivery), out)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def live_turns(
    events: DataFrame, delay: str = "10 minutes", idle_ms: int = 1_800_000, closed_ttl_ms: int = 86_400_000, merge_unanswered: bool = False
) -> DataFrame:
    """X1/X3/X4/X9. ``events``: host, session_id, ord, event_id, kind, content, machine,
    has_tools, ts, host_turn_id. Rows are upserts by ``source_id``; ``late`` rows append.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        events.withWatermark("ts", delay).groupBy("host", "session_id")
        .transformWithStateInPandas(
            statefulProcessor=TurnProcessor(idle_ms, closed_ttl_ms, merge_unanswered),
            outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
        )
    )


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (host, session, event) once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["host", "session_id", "event_id"])


def gap_windows(events: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Inactivity windows per key."""
    return (
        events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
    )
