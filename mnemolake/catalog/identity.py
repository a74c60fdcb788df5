"""Registered queries: identities, idempotent inserts, exact dedup, import totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.catalog.base import MSG_SQL, PAIR_SQL, QA_SQL, Registry, messages, stored_pairs
from mnemolake.functions import clean as C
from mnemolake.functions import ident as I
from mnemolake.operators import dedupe, health, pairing

reg = Registry()


@reg.query("I2", "SELECT event_id, 'u' || user_id || ':' || strftime(ts, '%Y%m%dT%H%M%S') || ':' || (event_id % 3) || ':' || substr(sha1('u' || user_id || '|' || props), 1, 16) AS sid FROM events")
def snapshot_event_ids(t):
    e = t.events
    sid = I.snapshot_event_id(F.concat(F.lit("u"), "user_id"), F.col("ts"), F.col("props"), F.col("event_id") % 3)
    return e.select("event_id", sid.alias("sid"))


@reg.query("I3", f"""WITH {MSG_SQL} SELECT session_id, ord, CASE WHEN turn % 4 <> 3 THEN 'uid:' || event_id
 ELSE 'h:' || substr(sha1(session_id || '|' || role || '|' || coalesce(occurred_at, 'None') || '|' || content), 1, 24) END AS eid FROM msg""")
def uid_or_hash_ids(t):
    m = messages(t)
    return m.select(
        "session_id", "ord",
        I.uid_or_hash_event_id(F.col("event_id"), F.col("session_id"), F.col("role"), F.col("occurred_at"), F.col("content")).alias("eid"),
    )


_JS = lambda x: f"CAST(to_json({x}) AS VARCHAR)"


@reg.query("I4 I5 I6", f"""WITH m AS (SELECT doc_id, 'mem_' || sha256('{{"category":' || {_JS('lang')} || ',"content":' || {_JS('text')} || ',"tags":' || CAST(to_json([source, lang, '标签"q']) AS VARCHAR) || ',"title":' || {_JS('source')} || '}}') AS mid FROM documents)
SELECT doc_id, mid, 'rel_' || sha256('cor_' || sha256(mid)) AS rel, 'inv_' || sha256('cor_' || sha256(mid) || '|topic|' || doc_id) AS inv,
 't_' || substr(md5(doc_id || '|rebuild|' || 'cor_' || sha256(mid)), 1, 8) AS rebuilt, 't_' || substr(md5(mid), 1, 8) AS tid FROM m""")
def memory_ids(t):
    d = t.documents
    mid = I.memory_id(F.col("lang"), F.col("source"), F.col("text"), F.array("source", "lang", F.lit('标签"q')))
    m = d.select("doc_id", mid.alias("mid")).withColumn("cor", I.correction_id(F.col("mid")))
    doc = F.col("doc_id").cast("string")
    return m.select(
        "doc_id", "mid", I.relation_id(F.col("cor")).alias("rel"), I.invalidation_id(F.col("cor"), F.lit("topic"), doc).alias("inv"),
        I.rebuilt_topic_id(doc, F.col("cor")).alias("rebuilt"), I.topic_id(F.col("mid")).alias("tid"),
    )


@reg.query("I7", "SELECT page_id, 'delivery/test/' || replace(url_encode(url), '+', '%20') || '/' || replace(url_encode('a b*~/' || page_id), '+', '%20') AS did FROM pages")
def delivery_ids(t):
    return t.pages.select(
        "page_id", I.delivery_id(F.lit("test"), F.col("url"), F.concat(F.lit("a b*~/"), "page_id")).alias("did")
    )


@reg.query("I8", f"""WITH {MSG_SQL} SELECT session_id, ord, coalesce(event_id, CASE WHEN occurred_at IS NOT NULL THEN 'ts:' || replace(occurred_at, 'Z', '') || '+00:00|' || role END, 'fb:' || role || '|' || sha256(content)) AS key,
 event_id IS NOT NULL OR occurred_at IS NOT NULL AS reliable FROM msg""")
def message_keys(t):
    m = messages(t)
    k = I.message_key([F.col("event_id")], F.col("occurred_at").try_cast("timestamp"), F.col("role"), F.col("content"))
    return m.select("session_id", "ord", k.alias("k")).select("session_id", "ord", "k.key", "k.reliable")


@reg.query("I9", f"""WITH {MSG_SQL}, h AS (SELECT session_id, ord, turn, CASE turn % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'legacy' ELSE '' END AS host, event_id FROM msg)
SELECT session_id, ord, CASE WHEN coalesce(event_id, '') <> '' AND host NOT IN ('', 'legacy') THEN 'qa_sync/' || host || '/' || session_id || '/' || event_id
 WHEN coalesce(event_id, '') <> '' THEN 'qa_sync/' || session_id || '/' || turn || '/' || event_id[1:16] ELSE 'qa_sync/' || session_id || '/' || turn END AS source_id,
 CASE WHEN host <> '' AND coalesce(event_id, '') <> '' THEN 'qa_sync/' || host || '/' || session_id || '/' || event_id || '|qa_import/' || host || '/' || session_id || '/' || event_id ELSE '' END AS candidates FROM h""")
def qa_source_ids(t):
    m = messages(t).withColumn("host", F.when(F.col("turn") % 3 == 0, "test").when(F.col("turn") % 3 == 1, "legacy").otherwise(""))
    return m.select(
        "session_id", "ord",
        I.qa_source_id(F.col("host"), F.col("session_id"), F.col("turn"), F.col("event_id")).alias("source_id"),
        F.array_join(I.source_candidates(F.col("host"), F.col("session_id"), F.col("event_id")), "|").alias("candidates"),
    )


# a batch that repeats ids (re-import) and repeats content under new ids, against a store of half the sessions
BATCH_SQL = f"""{MSG_SQL},
b AS (SELECT host, session_id, ord, coalesce(event_id, 'x' || ord) AS event_id, role, content, occurred_at FROM msg
 UNION ALL SELECT host, session_id, ord + 1000000, coalesce(event_id, 'x' || ord), role, content || ' edited', occurred_at FROM msg WHERE turn % 3 = 1
 UNION ALL SELECT host, session_id, ord + 2000000, 'twin' || ord, role, content, occurred_at FROM msg WHERE turn % 4 = 1),
store AS (SELECT host, session_id, coalesce(event_id, 'x' || ord) AS event_id, role, content, occurred_at FROM msg WHERE conv_id % 2 = 0 AND turn < 3)"""


def import_batch(t):
    m = messages(t).withColumn("event_id", F.coalesce("event_id", F.concat(F.lit("x"), "ord")))
    cols = ["host", "session_id", "ord", "event_id", "role", "content", "occurred_at"]
    again = m.filter("turn % 3 = 1").withColumn("content", F.concat("content", F.lit(" edited"))).withColumn("_o", F.col("ord") + 1000000)
    twin = m.filter("turn % 4 = 1").withColumn("event_id", F.concat(F.lit("twin"), "ord")).withColumn("_o", F.col("ord") + 2000000)
    fix = lambda d: d.drop("ord").withColumnRenamed("_o", "ord").select(*cols)
    store = m.filter((F.col("conv_id") % 2 == 0) & (F.col("turn") < 3)).select(*cols)
    return m.select(*cols).unionByName(fix(again)).unionByName(fix(twin)), store


@reg.query("J1 S17", f"""WITH {BATCH_SQL},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, session_id, event_id ORDER BY ord) AS rn FROM b) WHERE rn = 1),
g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.host = f.host AND s.session_id = f.session_id AND s.event_id = f.event_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY host, session_id, role, occurred_at, md5(content) ORDER BY ord) AS rc FROM g)
SELECT session_id, ord, event_id FROM c WHERE occurred_at IS NULL OR (rc = 1 AND NOT EXISTS (SELECT 1 FROM store s WHERE s.host = c.host AND s.session_id = c.session_id AND s.role = c.role AND s.occurred_at = c.occurred_at AND md5(s.content) = md5(c.content)))""")
def raw_dedupe_insert(t):
    batch, store = import_batch(t)
    return dedupe.new_raw_rows(batch, store).select("session_id", "ord", "event_id")


@reg.query("J2", f"""WITH {BATCH_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id, role, occurred_at ORDER BY ord) AS rc FROM b)
SELECT session_id, ord FROM c WHERE occurred_at IS NULL OR (rc = 1 AND NOT EXISTS (SELECT 1 FROM store s WHERE s.session_id = c.session_id AND s.role = c.role AND s.occurred_at = c.occurred_at))""")
def fallback_dedupe_insert(t):
    batch, store = import_batch(t)
    return dedupe.new_raw_rows_without_host(batch, store).select("session_id", "ord")


@reg.query("J3", "SELECT DISTINCT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def existing_id_probe(t):
    return dedupe.existing_ids(t.labels.select("doc_id").distinct(), t.documents, "doc_id")


@reg.query("J4", """WITH b AS (SELECT doc_id, lang AS question, text AS answer FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT lang AS question, text AS answer FROM documents WHERE doc_id % 3 = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, answer ORDER BY doc_id) AS rn FROM b) WHERE rn = 1)
SELECT doc_id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.question = f.question AND s.answer = f.answer)""")
def cross_source_dedupe(t):
    d = t.documents.select("doc_id", F.col("lang").alias("question"), F.col("text").alias("answer"))
    return dedupe.new_content(d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 3 = 0"), "doc_id").select("doc_id")


@reg.query("S18", f"WITH {PAIR_SQL} SELECT session_id, turn_id, q_event_id FROM qa WHERE NOT (session_id IN (SELECT 's' || conv_id FROM conversations WHERE conv_id % 2 = 0) AND turn_id = 1)")
def qa_insert_once(t):
    pairs = pairing.qa_pairs(messages(t))
    even = F.regexp_extract("session_id", "([0-9]+)", 1).cast("long") % 2 == 0
    stored = pairs.filter(even & (F.col("turn_id") == 1)).select("source_id")
    twice = pairs.unionByName(pairs)
    return dedupe.missing_by_key(twice, stored, ["source_id"]).select("session_id", "turn_id", "q_event_id")


@reg.query("S19", """WITH m AS (SELECT doc_id, 'mem_' || sha256('{"category":"legacy_derived","content":' || CAST(to_json(text) AS VARCHAR) || ',"tags":' || CAST(to_json([lang, 'legacy-derived']) AS VARCHAR) || ',"title":' || CAST(to_json(source) AS VARCHAR) || '}') AS mid, text, lang FROM documents)
SELECT mid, min(doc_id) AS doc_id, lang || '|legacy-derived' AS tags, sha256(text) AS original_sha FROM m GROUP BY mid, lang, text HAVING min(doc_id) % 5 <> 0 OR count(*) < 0""")
def memory_insert_once(t):
    from mnemolake.sources import sinks

    d = t.documents.select(
        F.col("doc_id").alias("ord"), F.lit("legacy").alias("kind"), F.lit("docs").alias("source_system"), F.col("source").alias("source_ref"),
        "text", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("title"),
        F.array("lang", "lang").alias("tags"), F.create_map(F.lit("origin"), F.lit("x")).alias("provenance"),
    )
    rows = sinks.memory_rows(d, F.lit("2026-01-01T00:00:00Z"))
    stored = rows.filter("ord % 5 = 0").select("memory_id")
    new = dedupe.missing_by_key(rows, stored, ["memory_id"])
    return new.select(
        F.col("memory_id").alias("mid"), F.col("ord").alias("doc_id"), F.array_join("tags", "|").alias("tags"),
        F.col("provenance")["original_text_sha256"].alias("original_sha"),
    )


@reg.query("C1", """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN true ELSE doc_id = min(CASE WHEN doc_id % 10 <> 0 THEN doc_id END) OVER (PARTITION BY lang, CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END) END AS kept FROM documents""")
def title_dedup(t):
    d = t.documents.select(
        F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")).alias("title")
    )
    return dedupe.title_dedup(d, ["lang"]).select("id", "kept")


@reg.query("J5", """SELECT c.conv_id, c.turn, CASE WHEN s.source IS NULL THEN 'unknown' ELSE s.source END AS source FROM conversations c LEFT JOIN (SELECT doc_id AS conv_id, source FROM documents WHERE doc_id % 3 <> 0) s USING (conv_id)""")
def session_metadata(t):
    meta = t.documents.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("conv_id"), "source")
    # one row per session; the size check is Spark's own broadcast threshold
    j = t.conversations.select("conv_id", "turn").join(meta, "conv_id", "left")
    return j.withColumn("source", F.coalesce("source", F.lit("unknown")))


@reg.query("A9", """SELECT event_type AS source, count(*) AS imported, CAST(count(*) FILTER (WHERE value < 10) AS BIGINT) AS skipped, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, bool_or(value > 50) AS ready FROM events GROUP BY event_type""")
def import_totals(t):
    r = t.events.select(
        F.col("event_type").alias("source"), F.lit(1).cast("long").alias("imported"),
        F.when(F.col("value") < 10, 1).otherwise(0).cast("long").alias("skipped"),
        F.col("ts").alias("oldest"), F.col("ts").alias("newest"), (F.col("value") > 50).alias("ready"),
    )
    fmt = "yyyy-MM-dd HH:mm:ss"
    return health.import_totals(r).withColumns({
        "oldest": F.date_format("oldest", fmt), "newest": F.date_format("newest", fmt)
    })
