"""Query registry, table loading and the input variants that several queries share.

Each variant exists twice: as a DataFrame over the given tables and as SQL text
for the check engine. They plant what the given tables lack (adjacent rows of one
role, repeats, machine text, missing vectors) by arithmetic on the ids.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.session import prepare


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    ops: str
    sql: str | None


@dataclass
class Registry:
    items: dict[str, Query] = field(default_factory=dict)

    def query(self, ops: str, sql: str | None = None):
        def add(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                prepare(spark)
                return fn(Tables(spark, sf_dir))

            run.__name__ = fn.__name__
            run.__doc__ = fn.__doc__
            if fn.__name__ in self.items:
                raise ValueError(f"query {fn.__name__} is registered twice")
            self.items[fn.__name__] = Query(run, ops, sql)
            return fn

        return add


class Tables:
    """Lazy access to the given tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


# --- SQL text helpers --------------------------------------------------------
def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS_SQL = "(chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12))"


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def lstrip_sql(x: str) -> str:
    return f"ltrim({x}, {WS_SQL})"


def prefixes_sql(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def markers_sql(x: str) -> str:
    head = rf"^(?:(?:{R.TS_PREFIX})?(?:{R.MESSAGE_ID_MARK})?(?:\[\[reply_to_current\]\])?\s*){{1,4}}"
    return strip_sql(f"regexp_replace({strip_sql(x)}, {q(head)}, '')")


def preamble_sql(x: str) -> str:
    t = strip_sql(x)
    plain = strip_sql(f"regexp_replace({t}, {q('^' + R.TS_PREFIX)}, '')")
    return (
        f"({prefixes_sql(t, R.AUTOMATION_PREFIXES)} OR regexp_matches({plain}, {q(R.CRON_BRACKET)}) "
        f"OR (starts_with({t}, '[{{') AND contains({t}[1:200], '\"type\"')))"
    )


def dump_sql(x: str) -> str:
    head = f"{lstrip_sql(x)}[1:{R.DUMP_HEAD_CHARS}]"
    marks = " OR ".join(f"contains({head}, {q(m)})" for m in R.DUMP_MARKERS)
    return f"({head} <> '' AND (length({x}) > {R.MAX_QUESTION_CHARS} OR {prefixes_sql(head, R.DUMP_PREFIXES)} OR {marks}))"


def ts_sql(seconds: str) -> str:
    return f"strftime(make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ')"


def ts_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- message variant ---------------------------------------------------------
EPOCH = 1704067200

MSG_SQL = f"""
src AS (
  SELECT conv_id, turn, text, 0 AS dup FROM conversations
  UNION ALL SELECT conv_id, turn, text, 1 AS dup FROM conversations WHERE turn % 3 = 0),
msg AS (
  SELECT conv_id, turn, dup, 'test' AS host, 's' || conv_id AS session_id, turn * 2 + dup AS ord,
    CASE WHEN turn % 4 = 3 THEN NULL ELSE conv_id || ':' || turn || CASE WHEN dup = 1 THEN 'r' ELSE '' END END AS event_id,
    CASE WHEN turn % 5 < 2 THEN 'user' WHEN turn % 5 < 4 THEN 'assistant' ELSE 'tool' END AS role,
    CASE WHEN (conv_id + turn) % 7 = 0 THEN '[SILENT] ' || text
         WHEN (conv_id + turn) % 11 = 0 THEN '[OUT-OF-BAND USER MESSAGE — note]' || chr(10) || text || chr(10) || '[/OUT-OF-BAND USER MESSAGE]'
         WHEN (conv_id + turn) % 13 = 0 THEN '[Wed 2026-04-22 01:59 GMT+8] [message_id: m1] ' || text
         WHEN (conv_id + turn) % 17 = 0 THEN '[CONTEXT COMPACTION] ' || text
         WHEN (conv_id + turn) % 19 = 0 THEN '{{"version": 1}} ' || text
         ELSE text END AS content,
    CASE WHEN conv_id % 9 = 4 THEN NULL
         ELSE {ts_sql(f"{EPOCH} + conv_id * 86400 + turn * 60 - CASE WHEN turn % 10 = 6 THEN 120 ELSE 0 END")} END AS occurred_at,
    CASE WHEN conv_id % 10 = 3 THEN 'Cron' WHEN conv_id % 10 = 4 THEN NULL ELSE 'tui' END AS session_source,
    CASE WHEN turn % 5 = 2 AND conv_id % 2 = 0 THEN '[{{"name":"f"}}]' ELSE '[]' END AS tool_calls
  FROM src)
"""


def messages(t: Tables) -> DataFrame:
    base = t.conversations.select("conv_id", "turn", "text")
    src = base.withColumn("dup", F.lit(0)).unionByName(base.filter("turn % 3 = 0").withColumn("dup", F.lit(1)))
    n = F.col("conv_id") + F.col("turn")
    text = F.col("text")
    content = (
        F.when(n % 7 == 0, F.concat(F.lit("[SILENT] "), text))
        .when(n % 11 == 0, F.concat(F.lit("[OUT-OF-BAND USER MESSAGE — note]\n"), text, F.lit("\n[/OUT-OF-BAND USER MESSAGE]")))
        .when(n % 13 == 0, F.concat(F.lit("[Wed 2026-04-22 01:59 GMT+8] [message_id: m1] "), text))
        .when(n % 17 == 0, F.concat(F.lit("[CONTEXT COMPACTION] "), text))
        .when(n % 19 == 0, F.concat(F.lit('{"version": 1} '), text))
        .otherwise(text)
    )
    seconds = F.lit(EPOCH) + F.col("conv_id") * 86400 + F.col("turn") * 60 - F.when(F.col("turn") % 10 == 6, 120).otherwise(0)
    suffix = F.when(F.col("dup") == 1, "r").otherwise("")
    return src.select(
        "conv_id", "turn", "dup",
        F.lit("test").alias("host"), F.concat(F.lit("s"), F.col("conv_id")).alias("session_id"),
        (F.col("turn") * 2 + F.col("dup")).alias("ord"),
        F.when(F.col("turn") % 4 != 3, F.concat("conv_id", F.lit(":"), "turn", suffix)).alias("event_id"),
        F.when(F.col("turn") % 5 < 2, "user").when(F.col("turn") % 5 < 4, "assistant").otherwise("tool").alias("role"),
        content.alias("content"),
        F.when(F.col("conv_id") % 9 != 4, ts_text(seconds)).alias("occurred_at"),
        F.when(F.col("conv_id") % 10 == 3, "Cron").when(F.col("conv_id") % 10 != 4, "tui").alias("session_source"),
        F.when((F.col("turn") % 5 == 2) & (F.col("conv_id") % 2 == 0), '[{"name":"f"}]').otherwise("[]").alias("tool_calls"),
    )


OOB_SQL_BODY = q(R.OOB_BODY)

# pairable rows -> collapsed -> turns, as SQL
PAIR_SQL = f"""{MSG_SQL},
p0 AS (SELECT *, {markers_sql('content')} AS c1 FROM msg
  WHERE role IN ('user','assistant') AND {strip_sql('content')} <> '' AND coalesce(lower(session_source) NOT IN ({','.join(q(s) for s in R.MACHINE_SESSION_SOURCES)}), true)),
p1 AS (SELECT *, CASE WHEN role = 'user' AND starts_with(c1, {q(R.OOB_OPEN)}) THEN {strip_sql(f"regexp_extract(c1, {OOB_SQL_BODY}, 1)")} ELSE c1 END AS c2
  FROM p0 WHERE NOT (role = 'user' AND ({preamble_sql('c1')} OR {dump_sql('c1')}))),
pairable AS (SELECT * FROM p1 WHERE c2 <> '' AND NOT (role = 'user' AND {preamble_sql('c2')}) AND NOT regexp_matches({lstrip_sql('c2')}, {q(R.COMPACTION_HEAD)})),
lagged AS (SELECT *, lag(role) OVER w AS pr, lag({strip_sql('c2')}) OVER w AS pc FROM pairable WINDOW w AS (PARTITION BY host, session_id ORDER BY ord)),
kept AS (SELECT * FROM lagged WHERE pr IS NULL OR pr <> role OR pc <> {strip_sql('c2')}),
o1 AS (SELECT *, coalesce(occurred_at, '') AS ts, lag(role) OVER (PARTITION BY host, session_id ORDER BY coalesce(occurred_at, ''), ord) AS prev_role FROM kept),
turned AS (SELECT * FROM (SELECT *, sum(CASE WHEN role = 'user' AND coalesce(prev_role, '') <> 'user' THEN 1 ELSE 0 END)
   OVER (PARTITION BY host, session_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS turn_no FROM o1) WHERE turn_no > 0),
flagged AS (SELECT *, {preamble_sql('c2')} AS machine, tool_calls NOT IN ('', '[]', 'null') AS has_tools FROM turned),
turns AS (SELECT host, session_id, turn_no,
   string_agg(CASE WHEN role = 'user' THEN {strip_sql('c2')} END, chr(10)||chr(10) ORDER BY ts, ord) AS question,
   count(CASE WHEN role = 'user' THEN 1 END) AS nu, count(CASE WHEN role = 'assistant' THEN 1 END) AS na,
   count(CASE WHEN role = 'assistant' AND NOT machine THEN 1 END) AS nreal,
   count(CASE WHEN role = 'assistant' AND NOT machine AND has_tools THEN 1 END) AS ntool,
   string_agg(CASE WHEN role = 'assistant' AND NOT machine THEN {strip_sql('c2')} END, chr(10)||chr(10) ORDER BY ts, ord) AS joined,
   arg_max(CASE WHEN role = 'assistant' AND NOT machine AND NOT has_tools THEN {strip_sql('c2')} END, CASE WHEN role = 'assistant' AND NOT machine AND NOT has_tools THEN ts || lpad(ord::varchar, 12, '0') END) AS last_plain,
   arg_max(CASE WHEN role = 'assistant' AND NOT machine THEN {strip_sql('c2')} END, CASE WHEN role = 'assistant' AND NOT machine THEN ts || lpad(ord::varchar, 12, '0') END) AS last_real,
   arg_min(CASE WHEN role = 'user' THEN coalesce(event_id, '') END, CASE WHEN role = 'user' THEN ts || lpad(ord::varchar, 12, '0') END) AS q_event,
   arg_min(CASE WHEN role = 'user' THEN ts END, CASE WHEN role = 'user' THEN ts || lpad(ord::varchar, 12, '0') END) AS q_ts
  FROM flagged GROUP BY host, session_id, turn_no),
answered AS (SELECT *, CASE WHEN nreal = 0 THEN '' WHEN ntool = 0 THEN joined ELSE coalesce(last_plain, last_real) END AS answer FROM turns),
emitted AS (SELECT *, row_number() OVER (PARTITION BY host, session_id ORDER BY turn_no) AS turn_id FROM answered
  WHERE nu > 0 AND na > 0 AND {strip_sql('answer')} <> '' AND NOT {dump_sql('question')}),
qa AS (SELECT host, session_id, turn_id, question, answer,
   CASE WHEN q_event = '' THEN 'derived:' || host || ':' || session_id || ':turn-' || turn_id ELSE q_event END AS q_event_id,
   nullif(q_ts, '') AS occurred_at FROM emitted)
"""


# --- document variants -------------------------------------------------------
def planted(t: Tables, cases: dict[int, tuple[str, str]], mod: int) -> DataFrame:
    """Documents as (doc_id, c): text between the prefix and suffix chosen by ``doc_id % mod``."""
    c = F.col("text")
    for k, (before, after) in cases.items():
        c = F.when(F.col("doc_id") % mod == k, F.concat(F.lit(before), F.col("text"), F.lit(after))).otherwise(c)
    return t.documents.select("doc_id", "lang", "source", c.alias("c"))


def planted_sql(cases: dict[int, tuple[str, str]], mod: int) -> str:
    def lit(s: str) -> str:
        return "(" + " || chr(10) || ".join(q(part) for part in s.split("\n")) + ")"

    whens = " ".join(f"WHEN {k} THEN {lit(a)} || text || {lit(b)}" for k, (a, b) in cases.items())
    return f"d AS (SELECT doc_id, lang, source, CASE doc_id % {mod} {whens} ELSE text END AS c FROM documents)"


# stored question/answer pairs with numeric ids, made from neighbouring turns
QA_SQL = f"""
pr AS (SELECT conv_id, turn, text, role FROM conversations),
qp AS (SELECT a.conv_id * 1000 + a.turn // 2 AS id, 's' || a.conv_id || CASE WHEN a.conv_id % 12 = 5 THEN '.trajectory' ELSE '' END AS session_id,
   a.conv_id, a.turn, a.text AS question, CASE WHEN (a.conv_id + a.turn) % 14 = 0 THEN NULL WHEN (a.conv_id + a.turn) % 15 = 1 THEN '' ELSE b.text END AS answer,
   make_timestamp(CAST(({EPOCH} + a.conv_id * 86400 + a.turn * 60) * 1000000 AS BIGINT)) AS ts
  FROM pr a JOIN pr b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0)
"""


def stored_pairs(t: Tables) -> DataFrame:
    c = t.conversations
    a = c.filter("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("question"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_b"))
    n = F.col("conv_id") + F.col("turn")
    return a.join(b, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("id"),
        F.concat(F.lit("s"), "conv_id", F.when(F.col("conv_id") % 12 == 5, ".trajectory").otherwise("")).alias("session_id"),
        "conv_id", "turn", "question",
        F.when(n % 14 == 0, None).when(n % 15 == 1, "").otherwise(F.col("_b")).alias("answer"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 86400 + F.col("turn") * 60).alias("ts"),
    )
