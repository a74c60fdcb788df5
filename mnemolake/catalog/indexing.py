"""Registered queries: chunk spans, batches, worklists, ledgers, integrity, health, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.catalog.base import EPOCH, QA_SQL, Registry, stored_pairs, strip_sql
from mnemolake.functions.frames import side_by_side
from mnemolake.operators import chunking, health, index_state

reg = Registry()

TARGET = 60
SPAN_SQL = f"""pc AS (SELECT doc_id, regexp_extract_all(text, '(\\s*\\S+\\s*|\\s+)') AS p FROM documents),
px AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS i FROM pc),
sp AS (SELECT doc_id, CAST(i // {TARGET} AS INTEGER) AS chunk_index, string_agg(piece, '' ORDER BY i) AS text, count(*) AS token_count FROM px GROUP BY 1, 2),
so AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS source_end FROM sp)"""


@reg.query("W11 G5 D10", f"WITH {SPAN_SQL} SELECT doc_id, chunk_index, token_count, CAST(source_end - length(text) AS BIGINT) AS source_start, CAST(source_end AS BIGINT) AS source_end, sha256(text) AS source_sha256 FROM so")
def token_spans(t):
    s = chunking.token_spans(t.documents, "doc_id", ["text"], TARGET)
    return s.select("doc_id", "chunk_index", F.col("token_count").cast("long").alias("token_count"), "source_start", "source_end", "source_sha256")


@reg.query("W12", """WITH RECURSIVE w(doc_id, i, s, e, n) AS (
 SELECT doc_id, 0, 0, CASE WHEN length(text) <= 900 THEN length(text) WHEN strpos(reverse(text[801:900]), chr(10)) > 0 THEN 900 - strpos(reverse(text[801:900]), chr(10)) ELSE 900 END, length(text) FROM documents
 UNION ALL SELECT w.doc_id, i + 1, greatest(e - 100, s + 1), CASE WHEN n <= greatest(e - 100, s + 1) + 900 THEN n
   WHEN strpos(reverse(substr(text, greatest(e - 100, s + 1) + 801, 100)), chr(10)) > 0 THEN greatest(e - 100, s + 1) + 900 - strpos(reverse(substr(text, greatest(e - 100, s + 1) + 801, 100)), chr(10)) ELSE greatest(e - 100, s + 1) + 900 END, n
  FROM w JOIN documents USING (doc_id) WHERE e < n)
SELECT doc_id, CAST(i AS INTEGER) AS window_index, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end" FROM w""")
def overlapping_windows(t):
    return chunking.overlapping_windows(t.documents, "doc_id", "text", 900, 100).drop("text")


@reg.query("F8", """WITH pc AS (SELECT doc_id, text, regexp_extract_all(text, '(\\s*\\S+\\s*|\\s+)') AS p FROM documents)
SELECT doc_id, md5(CASE WHEN len(p) <= 50 THEN text ELSE rtrim(array_to_string(p[1:30], ''), chr(32)||chr(9)||chr(10)||chr(13)) || chr(10) || array_to_string(p[greatest(len(p) - 19, 1):len(p)], '') END) AS shortened FROM pc""")
def query_shortening(t):
    return t.documents.select("doc_id", F.md5(chunking.shorten_query(F.col("text"), 50)).alias("shortened"))


@reg.query("F9", "SELECT doc_id, greatest(n_chars - 512, 1) AS target, strlen(text) <= 600 AS fits FROM documents")
def token_gates(t):
    return t.documents.select(
        "doc_id", chunking.safe_token_target(F.col("n_chars"), F.lit(512)).alias("target"), chunking.fits_one_call(F.col("text"), 600).alias("fits")
    )


@reg.query("W10", """WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f(conv_id, rn, used, b) AS (SELECT conv_id, rn, CASE WHEN n > 1200 THEN -1 ELSE n END, 1 FROM r WHERE rn = 1
 UNION ALL SELECT r.conv_id, r.rn, CASE WHEN n > 1200 THEN -1 WHEN used < 0 OR used + n > 1200 THEN n ELSE used + n END, CASE WHEN n > 1200 OR used < 0 OR used + n > 1200 THEN b + 1 ELSE b END FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id, turn, CAST(b AS BIGINT) AS batch_no FROM f JOIN r USING (conv_id, rn)""")
def budget_batches(t):
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("chars"))
    return chunking.budget_batches(rows, 1200, ("conv_id",), "turn").select("conv_id", "turn", "batch_no")


# missing vectors where id % 13 = 0, failure rows where id % 26 = 0
FAIL_SQL = """fl AS (SELECT 'vec' AS entity_table, vec_id::VARCHAR AS entity_id, vec_id % 52 <> 0 AS retryable, CASE WHEN vec_id % 78 = 0 THEN 1 END AS resolved FROM embeddings WHERE vec_id % 26 = 0),
nv AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE 1 END AS v, CASE WHEN vec_id % 39 = 0 THEN ' ' ELSE 'text ' || label END AS txt FROM embeddings)"""


def _failing(t):
    e = t.embeddings
    rows = e.select(
        "vec_id", F.when(F.col("vec_id") % 13 != 0, F.col("embedding")).alias("vec"),
        F.when(F.col("vec_id") % 39 == 0, " ").otherwise(F.concat(F.lit("text "), "label")).alias("txt"),
    )
    fl = e.filter("vec_id % 26 = 0").select(
        F.lit("vec").alias("entity_table"), F.col("vec_id").cast("string").alias("entity_id"), (F.col("vec_id") % 52 != 0).alias("retryable"),
        F.when(F.col("vec_id") % 78 == 0, F.lit("2024-01-01").cast("timestamp")).alias("resolved_at"),
    )
    return rows, fl


@reg.query("J26", f"WITH {FAIL_SQL} SELECT vec_id FROM nv WHERE v IS NULL AND vec_id::VARCHAR NOT IN (SELECT entity_id FROM fl WHERE resolved IS NULL)")
def unexplained_nulls(t):
    rows, fl = _failing(t)
    return index_state.unexplained_nulls(rows, fl, "vec", F.col("vec_id")).select("vec_id")


@reg.query("J27", f"WITH {FAIL_SQL} SELECT vec_id FROM nv WHERE v IS NULL AND trim(txt) <> '' AND length(txt) <= 6 AND vec_id::VARCHAR NOT IN (SELECT entity_id FROM fl WHERE resolved IS NULL AND NOT retryable) ORDER BY vec_id LIMIT 20")
def backfill_worklist(t):
    rows, fl = _failing(t)
    return index_state.backfill_worklist(rows, fl, "vec", "vec_id", F.col("txt"), 20, max_chars=6).select("vec_id")


CHUNK_SQL = f"""{SPAN_SQL}, ck AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 0 ELSE chunk_index END AS chunk_index, CASE WHEN doc_id % 19 = 0 THEN source_end ELSE source_end - length(text) END AS s, source_end AS e, CASE WHEN (doc_id + chunk_index) % 23 = 0 THEN NULL ELSE 1 END AS v FROM so),
pa AS (SELECT doc_id FROM documents WHERE doc_id % 29 <> 0)"""


def _chunks(t):
    s = chunking.token_spans(t.documents, "doc_id", ["text"], TARGET)
    c = s.select(
        "doc_id", F.when(F.col("doc_id") % 17 == 0, 0).otherwise(F.col("chunk_index")).alias("chunk_index"),
        F.when(F.col("doc_id") % 19 == 0, F.col("source_end")).otherwise(F.col("source_start")).alias("source_start"), "source_end",
        F.when((F.col("doc_id") + F.col("chunk_index")) % 23 != 0, F.array(F.lit(1.0))).alias("vec"),
    )
    return c, t.documents.filter("doc_id % 29 <> 0")


@reg.query("A12 J25", f"""WITH {CHUNK_SQL} SELECT count(*) AS child_rows, count(DISTINCT doc_id) AS distinct_parents, count(*) FILTER (WHERE v IS NULL) AS null_vectors, count(*) FILTER (WHERE s < 0 OR e <= s) AS bad_offsets,
 (SELECT count(*) FROM (SELECT 1 FROM ck GROUP BY doc_id, chunk_index HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(DISTINCT doc_id) FROM ck WHERE doc_id NOT IN (SELECT doc_id FROM pa)) AS parents_missing FROM ck""")
def chunk_integrity(t):
    c, parents = _chunks(t)
    return index_state.chunk_integrity(c, parents, "doc_id", "doc_id")


@reg.query("J25", f"WITH {CHUNK_SQL} SELECT doc_id, chunk_index FROM ck WHERE doc_id NOT IN (SELECT doc_id FROM pa)")
def orphan_chunks(t):
    c, parents = _chunks(t)
    return index_state.orphan_chunks(c, parents, "doc_id", "doc_id").select("doc_id", "chunk_index")


@reg.query("G7", f"WITH {CHUNK_SQL} SELECT doc_id AS parent, count(*) AS planned, count(v) AS embedded, count(*) = count(v) AS complete FROM (SELECT doc_id, so.chunk_index, CASE WHEN (doc_id + so.chunk_index) % 23 = 0 THEN NULL ELSE 1 END AS v FROM so) GROUP BY doc_id")
def complete_parents(t):
    s = chunking.token_spans(t.documents, "doc_id", ["text"], TARGET).select(F.col("doc_id").alias("parent"), "chunk_index")
    emb = s.withColumn("vec", F.when((F.col("parent") + F.col("chunk_index")) % 23 != 0, F.array(F.lit(1.0))))
    return index_state.complete_parents(s, emb)


@reg.query("G7", f"WITH {SPAN_SQL} SELECT doc_id AS parent, (chunk_index + 1)::INTEGER AS chunk_index FROM so WHERE chunk_index + 1 > (SELECT max(chunk_index) FROM so s2 WHERE s2.doc_id = so.doc_id)")
def stale_chunks(t):
    s = chunking.token_spans(t.documents, "doc_id", ["text"], TARGET).select(F.col("doc_id").alias("parent"), "chunk_index")
    stored = s.unionByName(s.withColumn("chunk_index", F.col("chunk_index") + 1)).distinct()
    return index_state.stale_chunks(s, stored)


LEDGER_SQL = """le AS (SELECT event_type AS entity_table, CAST(user_id AS VARCHAR) AS entity_id, 'p' || (event_id % 2) AS phase, ts AS tt, CASE WHEN value < 20 THEN 'resolved' WHEN value > 95 THEN 'entity_resolved' ELSE 'failed' END AS outcome, 'e' || (event_id % 3) AS error_class, event_id % 4 <> 0 AS retryable, 1 + event_id % 2 AS attempts, event_id FROM events),
fd AS (SELECT entity_table, entity_id, phase, sum(attempts) AS attempts, min(tt) AS f, max(tt) AS l, arg_max(error_class, tt) AS error_class, arg_max(retryable, tt) AS retryable FROM le WHERE outcome = 'failed' GROUP BY 1, 2, 3),
rs AS (SELECT entity_table, entity_id, phase, max(tt) AS p FROM le WHERE outcome = 'resolved' GROUP BY 1, 2, 3), es AS (SELECT entity_table, entity_id, max(tt) AS e FROM le WHERE outcome = 'entity_resolved' GROUP BY 1, 2),
lg AS (SELECT fd.*, CASE WHEN greatest(p, e) > l THEN greatest(p, e) END AS r FROM fd LEFT JOIN rs USING (entity_table, entity_id, phase) LEFT JOIN es USING (entity_table, entity_id))"""


def _ledger(t):
    e = t.events.select(
        F.col("event_type").alias("entity_table"), F.col("user_id").cast("string").alias("entity_id"),
        F.concat(F.lit("p"), F.col("event_id") % 2).alias("phase"), F.col("ts").alias("at"),
        F.when(F.col("value") < 20, "resolved").when(F.col("value") > 95, "entity_resolved").otherwise("failed").alias("outcome"),
        F.concat(F.lit("e"), F.col("event_id") % 3).alias("error_class"), (F.col("event_id") % 4 != 0).alias("retryable"),
        (1 + F.col("event_id") % 2).alias("attempts"),
    )
    return index_state.failure_ledger(e)


@reg.query("A16", f"WITH {LEDGER_SQL} SELECT entity_table, entity_id, phase, CAST(attempts AS BIGINT) AS attempts, epoch_us(f) AS first_us, epoch_us(l) AS last_us, error_class, retryable, epoch_us(r) AS resolved_us FROM lg")
def failure_ledger(t):
    us = lambda c: F.unix_micros(c)
    return _ledger(t).select(
        "entity_table", "entity_id", "phase", "attempts", us("first_failed_at").alias("first_us"), us("last_failed_at").alias("last_us"),
        "error_class", "retryable", us("resolved_at").alias("resolved_us"),
    )


@reg.query("A15", f"WITH {LEDGER_SQL} SELECT entity_table, error_class, retryable, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM lg WHERE r IS NULL GROUP BY 1, 2, 3")
def failure_summary(t):
    return index_state.failure_summary(_ledger(t))


DEBT_SQL = f"""{QA_SQL}, dq AS (SELECT *, CASE WHEN id % 13 = 0 THEN NULL ELSE 1 END AS v, ts >= TIMESTAMP '2024-01-20' - INTERVAL 240 HOURS AS rec, {strip_sql("coalesce(answer, '')")} = '' AS emp FROM qp WHERE ts < TIMESTAMP '2024-01-20')
SELECT count(*) FILTER (WHERE rec) AS recent_qa, count(*) FILTER (WHERE rec AND v IS NOT NULL) AS recent_with_vector, count(*) FILTER (WHERE rec AND v IS NULL) AS recent_embedding_null, count(*) FILTER (WHERE rec AND emp) AS recent_empty_answer,
 count(*) FILTER (WHERE v IS NULL) AS embedding_null_total, count(*) FILTER (WHERE emp) AS empty_answer_total, epoch_us(min(ts) FILTER (WHERE v IS NULL)) AS oldest_us, epoch_us(max(ts) FILTER (WHERE v IS NULL)) AS newest_us, epoch_us(max(ts)) AS last_us FROM dq"""


def _debt(t):
    now = F.lit("2024-01-20").cast("timestamp")
    p = stored_pairs(t).filter(F.col("ts") < now).withColumn("created_at", F.col("ts")).withColumn(
        "vec", F.when(F.col("id") % 13 != 0, F.array(F.lit(1.0)))
    )
    return index_state.null_debt(p, now, 240)


@reg.query("A10 A11", f"WITH {DEBT_SQL}")
def embedding_debt(t):
    us = F.unix_micros
    return _debt(t).select(
        "recent_qa", "recent_with_vector", "recent_embedding_null", "recent_empty_answer", "embedding_null_total", "empty_answer_total",
        us("oldest_null").alias("oldest_us"), us("newest_null").alias("newest_us"), us("last_write").alias("last_us"),
    )


_ISSUES = [
    ("RECENT_EMBEDDING_FAILURE", "'error'", "recent_embedding_null", "true"),
    ("HISTORICAL_EMBEDDING_DEBT", "'info'", "greatest(embedding_null_total - recent_embedding_null, 0)", "true"),
    ("EMPTY_ANSWER_RECENT", "'warning'", "recent_empty_answer", "false"),
    ("EMPTY_ANSWER_HISTORICAL_DEBT", "'info'", "greatest(empty_answer_total - recent_empty_answer, 0)", "false"),
    ("LONG_QA_CHUNK_INCONSISTENT", "CASE WHEN pm > 0 OR nv > 0 THEN 'error' ELSE 'warning' END", "pm + nv + bo + dk", "true"),
    ("POISONED_FAILURE_MARKER", "'info'", "7", "true"), ("RETRY_EXHAUSTED", "'warning'", "2", "true"), ("STALE_PENDING_MARKER", "'warning'", "1", "true"),
]
HEALTH_SQL = f"""dd AS (WITH {DEBT_SQL}), {CHUNK_SQL}, ci AS (SELECT count(*) FILTER (WHERE v IS NULL) AS nv, count(*) FILTER (WHERE s < 0 OR e <= s) AS bo, (SELECT count(*) FROM (SELECT 1 FROM ck GROUP BY doc_id, chunk_index HAVING count(*) > 1)) AS dk, (SELECT count(DISTINCT doc_id) FROM ck WHERE doc_id NOT IN (SELECT doc_id FROM pa)) AS pm FROM ck),
m AS (SELECT * FROM dd, ci), iss AS ({" UNION ALL ".join(f"SELECT '{c}' AS code, {s} AS severity, CAST({n} AS BIGINT) AS n, {r} AS repairable FROM m WHERE {n} > 0" for c, s, n, r in _ISSUES)})"""


def _issues(t):
    c, parents = _chunks(t)
    integ = index_state.chunk_integrity(c, parents, "doc_id", "doc_id").select(
        F.col("parents_missing").alias("chunk_parents_missing"), F.col("null_vectors").alias("chunk_null_vectors"),
        F.col("bad_offsets").alias("chunk_bad_offsets"), F.col("duplicate_keys").alias("chunk_duplicate_keys"),
    )
    zero = {k: F.lit(0) for k in ("explicit_embedding_null", "current_active", "current_poisoned", "malformed")}
    m = side_by_side(_debt(t), integ).withColumns(
        {**zero, "current_retrying": F.lit(2), "total_poisoned": F.lit(7), "stale": F.lit(1)}
    )
    return health.diagnose(m)


@reg.query("A19", f"WITH {HEALTH_SQL} SELECT * FROM iss")
def health_diagnosis(t):
    return _issues(t).drop("severity_rank")


@reg.query("A19", f"""WITH {HEALTH_SQL}, mp AS (SELECT *, CASE WHEN code IN ('RECENT_EMBEDDING_FAILURE','HISTORICAL_EMBEDDING_DEBT') THEN 'REBUILD_EMBEDDING_FOR_QA_IDS' WHEN code = 'LONG_QA_CHUNK_INCONSISTENT' THEN 'REBUILD_LONG_QA_CHUNKS' ELSE 'RETRY_PENDING_FAILURES' END AS action FROM iss WHERE repairable)
SELECT action, CAST(sum(n) AS BIGINT) AS target_count, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM mp GROUP BY action""")
def repair_plan(t):
    return health.plan_repairs(_issues(t)).select("action", "target_count", "codes")


@reg.query("A13", f"""WITH {QA_SQL}, tpc AS (SELECT make_timestamp(CAST(({EPOCH} + (doc_id % 12) * 86400) * 1000000 AS BIGINT)) AS u FROM documents)
SELECT count(*) FILTER (WHERE ts > (SELECT max(u) FROM tpc)) AS backlog, epoch_us(max(ts)) AS newest_qa, epoch_us((SELECT max(u) FROM tpc)) AS newest_topic, CAST(floor((epoch(TIMESTAMP '2024-06-01') - epoch((SELECT max(u) FROM tpc))) / 3600) AS BIGINT) AS hours_since FROM qp""")
def topic_freshness(t):
    tp = t.documents.select(F.timestamp_seconds(F.lit(EPOCH) + (F.col("doc_id") % 12) * 86400).alias("updated_at"))
    f = health.freshness(tp, stored_pairs(t).withColumnRenamed("ts", "created_at"), F.lit("2024-06-01").cast("timestamp"))
    return f.select("backlog", F.unix_micros("newest_qa").alias("newest_qa"), F.unix_micros("newest_topic").alias("newest_topic"), "hours_since")


@reg.query("A18", "SELECT CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 5 = 0 THEN 'm1' ELSE 'm2' END AS embed_model, count(*) AS n, CASE WHEN vec_id % 7 = 0 THEN true WHEN vec_id % 5 = 0 THEN true ELSE false END AS dirty FROM embeddings GROUP BY 1, 3")
def model_fingerprints(t):
    r = t.embeddings.select(F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 5 == 0, "m1").otherwise("m2").alias("embed_model"))
    return index_state.fingerprints(r, "m2")


@reg.query("A18", "SELECT lang AS version, source AS section, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sections(t):
    return index_state.duplicate_sections(t.documents.select(F.col("lang").alias("version"), F.col("source").alias("section")))


@reg.query("J32", f"WITH {QA_SQL} SELECT count(*) AS linked FROM documents d JOIN qp ON qp.id = d.doc_id * 1000")
def linked_entries(t):
    return t.documents.select((F.col("doc_id") * 1000).alias("id")).join(stored_pairs(t).select("id"), "id").agg(F.count("*").alias("linked"))


MARK_SQL = """mk AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'recovered' WHEN 1 THEN 'poisoned' WHEN 2 THEN 'failed' WHEN 3 THEN 'in_flight' WHEN 4 THEN 'embedding_succeeded_pending_db' WHEN 5 THEN NULL WHEN 6 THEN 'failed' WHEN 7 THEN 'odd' ELSE NULL END AS raw, event_id % 2 AS attempts, (event_id * 37 % 1000)::DOUBLE AS age, CASE WHEN event_id % 9 = 2 THEN (event_id % 200)::DOUBLE END AS nxt FROM events),
ms AS (SELECT CASE WHEN raw = 'recovered' THEN 'recovered' WHEN raw = 'poisoned' THEN 'poisoned' WHEN raw = 'failed' AND nxt IS NOT NULL THEN CASE WHEN nxt > 100 THEN 'retryable' ELSE 'retry_due' END WHEN raw = 'failed' THEN CASE WHEN age < 300 THEN 'retryable' ELSE 'retry_due' END
 WHEN raw = 'in_flight' THEN CASE WHEN age > 500 THEN 'stale_in_flight' ELSE 'in_flight' END WHEN raw = 'embedding_succeeded_pending_db' THEN CASE WHEN age > 500 THEN 'stale_pending_db' ELSE 'pending_db' END WHEN raw IS NULL AND attempts = 0 THEN 'pending' ELSE 'unresolved' END AS status, age < 300 AS rec FROM mk)"""


@reg.query("A17 X8", f"""WITH {MARK_SQL}, dm AS (SELECT unnest([{",".join(f"'{s}'" for s in health.MARKER_STATUSES)}]) AS status)
SELECT dm.status, count(ms.status) AS n, count(*) FILTER (WHERE rec) AS recent FROM dm LEFT JOIN ms USING (status) GROUP BY 1""")
def marker_ledger(t):
    k = F.col("event_id") % 9
    raw = F.when(k == 0, "recovered").when(k == 1, "poisoned").when(k.isin(2, 6), "failed").when(k == 3, "in_flight").when(k == 4, "embedding_succeeded_pending_db").when(k == 7, "odd")
    m = t.events.select(
        F.col("event_id").alias("job_id"), raw.alias("raw"), (F.col("event_id") % 2).alias("attempts"),
        (F.col("event_id") * 37 % 1000).cast("double").alias("age"), F.when(k == 2, (F.col("event_id") % 200).cast("double")).alias("nxt"),
    )
    st = health.marker_status(F.col("raw"), F.col("attempts"), F.col("age"), F.col("nxt"), F.lit(100.0), 300, 500)
    return health.marker_ledger(m.select("job_id", st.alias("status"), (F.col("age") < 300).alias("is_recent")))


@reg.query("A17", "SELECT user_id AS question_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_markers(t):
    return health.duplicate_markers(t.events.select(F.col("user_id").alias("question_id")))


@reg.query("A20", """WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN '-4' WHEN 3 THEN NULL ELSE event_id::VARCHAR END AS e0 FROM events), x AS (SELECT event_id, CASE WHEN e0::BIGINT >= 0 THEN e0::BIGINT END AS e FROM s)
SELECT count(*) AS total, count(*) FILTER (WHERE e IS NULL OR e > 500) AS active, count(*) FILTER (WHERE e IS NULL) AS malformed, 'x' || min(event_id) AS first_error FROM x""")
def failed_segments(t):
    k = F.col("event_id") % 5
    v = F.col("event_id").cast("string")
    seg = F.when(k == 0, F.concat(F.lit('{"qa_range_end": '), v, F.lit(', "error": "x'), v, F.lit('"}'))).when(
        k == 1, F.concat(F.lit('{"source_end_id": "'), v, F.lit('", "error_class": "x'), v, F.lit('"}'))
    ).when(k == 2, '{"end_id": -4}').when(k == 3, '{"error": "none"}').otherwise(F.concat(F.lit('{"end_id": " '), v, F.lit(' "}')))
    return health.failed_segments(t.events.select(F.col("event_id").alias("seg_no"), seg.alias("seg")), 500)


AFF_CATS = ("session_summary", "lessons", "decisions", "projects", "creative", "memory", "evolution", "rules")


@reg.query("A21", """WITH c AS (SELECT user_id, ['session_summary','lessons','decisions','projects','creative','memory','evolution','rules'][event_id % 8 + 1] AS cat, event_type AS t1, 'x' || event_id % 40 AS t2, ts FROM events),
a AS (SELECT user_id, count(*) AS total_cards, greatest(1, floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400))::BIGINT AS span_days, count(*) FILTER (WHERE cat = 'session_summary') AS sc, count(*) FILTER (WHERE cat = 'lessons') AS l, count(*) FILTER (WHERE cat = 'decisions') AS d, count(*) FILTER (WHERE cat = 'projects') AS p,
 count(*) FILTER (WHERE cat = 'creative') AS cr, count(*) FILTER (WHERE cat = 'memory') AS m, count(*) FILTER (WHERE cat = 'evolution') AS ev, count(*) FILTER (WHERE cat = 'rules') AS ru FROM c GROUP BY 1),
tg AS (SELECT user_id, count(DISTINCT t) AS n FROM (SELECT user_id, t1 AS t FROM c UNION ALL SELECT user_id, t2 FROM c) WHERE length(trim(t)) > 2 GROUP BY 1),
x AS (SELECT a.user_id, total_cards, span_days, least(100, floor(round(ln(1 + span_days) * 15 + ln(1 + sc) * 8, 9))) AS c1, least(100, floor(round(ln(1 + l * 3 + d * 5) * 6, 9))) AS c2, least(100, floor(round(ln(1 + p * 8 + cr * 20) * 6, 9))) AS c3, least(100, floor(round(ln(1 + m * 6 + ev * 15 + ru * 3 + n * 0.3::DOUBLE) * 6, 9))) AS c4 FROM a JOIN tg USING (user_id))
SELECT user_id, total_cards, span_days, CAST(c1 AS BIGINT) AS companionship, CAST(c2 AS BIGINT) AS progress, CAST(c3 AS BIGINT) AS creation, CAST(c4 AS BIGINT) AS understanding, CAST(least(1000, floor((c1 + c2 + c3 + c4) * 2.5)) AS BIGINT) AS score FROM x""")
def affinity(t):
    cats = F.array(*[F.lit(c) for c in AFF_CATS])
    c = t.events.select(
        "user_id", F.get(cats, (F.col("event_id") % 8).cast("int")).alias("category"),
        F.array("event_type", F.concat(F.lit("x"), F.col("event_id") % 40)).alias("tags"), "ts",
    )
    return health.affinity(c).select(
        "user_id", "total_cards", "span_days", "companionship", "progress", "creation", "understanding",
        F.col("score").cast("long").alias("score"),
    )


@reg.query("A22", """WITH b AS (SELECT count(*) AS messages FROM conversations), c AS (SELECT messages, greatest(1, messages // 2) AS qa FROM b), d AS (SELECT *, greatest(1, CAST(ceil(qa / 20.0) AS BIGINT)) AS notes FROM c)
SELECT messages, qa, notes, CAST(floor(qa * 450.0) AS BIGINT) AS est_input_tokens, CAST(floor(notes * 900.0) AS BIGINT) AS est_output_tokens, CAST(floor(round(qa * 450.0 * 0.7, 6)) AS BIGINT) AS input_lo, CAST(floor(round(qa * 450.0 * 1.3, 6)) AS BIGINT) AS input_hi,
 CAST(floor(notes * 600.0) AS BIGINT) AS output_lo, CAST(floor(notes * 1500.0) AS BIGINT) AS output_hi, round(floor(qa * 450.0) / 1000 * 0.5::DOUBLE + floor(notes * 900.0) / 1000 * 2.0::DOUBLE, 4)::DOUBLE AS est_cost FROM d""")
def rebuild_estimate(t):
    return health.rebuild_estimate(t.conversations, 450.0, 900.0, (600.0, 1500.0), 20, 0.5, 2.0)


@reg.query("A23", f"""WITH {QA_SQL} SELECT round(avg(length(question)), 4) AS avg_question_chars, round(avg(length(answer)), 4) AS avg_answer_chars, count(*) AS pairs, count(DISTINCT CAST(ts AS DATE)) AS days, (SELECT count(*) FROM documents) AS notes,
 round(count(*) / (SELECT count(*) FROM documents), 4) AS pairs_per_note, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 4) AS turns_per_day FROM qp""")
def usage_telemetry(t):
    return health.usage_telemetry(stored_pairs(t).withColumnRenamed("ts", "created_at"), t.documents)
