"""The live trigger. One firing per backlog, after token, count, new-session and idle signals, never within the debounce.

Rows are summed per host, session and minute first, by a windowed aggregation that combines on the map side, so
a host that sends a third of all rows costs the keyed state one row per session and minute. The
state walks those minutes in event time: whatever falls due before a minute fires before it is added, and timers
fire what falls due with no row behind it. Firings therefore do not depend on how rows fall into micro-batches.

Defined cases: rows without an answer and inspection sessions do not count; null texts are empty; rows behind the watermark are
dropped, as in every stream; repeated rows count again (``turns.deduplicated`` goes before); an empty stream fires nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemolake.functions import clean as C
from mnemolake.streaming.turns import ROCKSDB

OUTPUT = "host string, fired_ms long, reason string, n long, chars long, sessions long"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
NEVER = -(1 << 60)


class TriggerProcessor(StatefulProcessor):
    """Backlog of one host: counters, unobserved characters per session, sessions seen by an earlier firing."""

    def __init__(self, chars_at: int, count_at: int, new_session_at: int, idle_ms: int, debounce_ms: int):
        self.chars_at, self.count_at, self.new_session_at = chars_at, count_at, new_session_at
        self.idle_ms, self.debounce_ms = idle_ms, debounce_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, chars long, newest long, last long, fired long")
        self.waiting = handle.getMapState("waiting", "session string", "chars long")
        self.known = handle.getMapState("known", "session string", "seen boolean")

    def _load(self) -> list[int]:
        return list(self.totals.get()) if self.totals.exists() else [0, 0, 0, NEVER, NEVER]

    def _due(self, s: list[int]) -> tuple[int, str] | None:
        """When the backlog fires if nothing more comes, and why."""
        n, chars, newest, last, fired = s
        if not n:
            return None
        free = fired + self.debounce_ms
        for hit, reason in ((chars >= self.chars_at, "token"), (n >= self.count_at, "count"), (newest >= self.new_session_at, "new_session")):
            if hit:
                return max(last, free), reason
        return max(last + self.idle_ms, free), "pause"

    def _fire(self, host: str, s: list[int], at: int, reason: str) -> tuple:
        seen = [k[0] for k in self.waiting.keys()]
        for session in seen:
            self.known.updateValue((session,), (True,))
        self.waiting.clear()
        row = (host, at, reason, s[0], s[1], len(seen))
        s[:] = [0, 0, 0, s[3], at]
        return row

    def _settle(self, s: list[int]) -> None:
        self.totals.update(tuple(s))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = self._due(s)
        if due:
            self.handle.registerTimer(due[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        minutes = pd.concat(list(rows)).sort_values(["at_ms", "session_id"], kind="stable")
        s, out = self._load(), []
        for at, some in minutes.groupby("at_ms", sort=True):
            due = self._due(s)
            if due and due[0] < at:
                out.append(self._fire(key[0], s, *due))
            for session, n, chars in zip(some["session_id"], some["n"], some["chars"]):
                have = int(chars) + (self.waiting.getValue((session,))[0] if self.waiting.containsKey((session,)) else 0)
                self.waiting.updateValue((session,), (have,))
                s[0] += int(n)
                s[1] += int(chars)
                if not self.known.containsKey((session,)):
                    s[2] = max(s[2], have)
            s[3] = max(s[3], int(at))
            due = self._due(s)
            if due and due[0] <= at:
                out.append(self._fire(key[0], s, *due))
        self._settle(s)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        due = self._due(s)
        if due and due[0] <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._fire(key[0], s, *due))
            self.totals.update(tuple(s))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def live_triggers(
    pairs: DataFrame, delay: str = "10 minutes", chars_at: int = 50_000, count_at: int = 100, new_session_at: int = 5_000,
    idle_hours: float = 4, debounce_minutes: float = 8, step: str = "1 minute",
) -> DataFrame:
    """One row per firing. ``pairs``: host, session_id, ts, question, answer; ``fired_ms`` is event time, ``n`` and ``chars`` the backlog it takes."""
    pairs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    chars = F.length(F.coalesce("question", F.lit(""))) + F.length("answer")
    live = pairs.filter(F.col("answer").isNotNull() & C.not_inspection_session(F.col("session_id")))
    per_minute = (
        live.withWatermark("ts", delay).groupBy("host", "session_id", F.window("ts", step).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(chars).cast("long").alias("chars"))
        .select("host", "session_id", "n", "chars", F.unix_millis(F.col("w.end")).alias("at_ms"), F.window_time("w").alias("at"))
    )
    return per_minute.groupBy("host").transformWithStateInPandas(
        statefulProcessor=TriggerProcessor(chars_at, count_at, new_session_at, int(idle_hours * 3_600_000), int(debounce_minutes * 60_000)),
        outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )
