"""Registered queries: topic updates, merges, facts, graphs, upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.catalog.base import EPOCH, Registry, q
from mnemolake.functions import text as T
from mnemolake.operators import clusters, graph, lexical, topics

reg = Registry()
E_ = EPOCH


@reg.query("W8 C9 J31", """WITH ex AS (SELECT label AS topic_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS seq FROM embeddings WHERE vec_id % 3 = 0),
nw AS (SELECT label AS topic_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings WHERE vec_id % 3 = 1)
SELECT nw.topic_id, vec_id, coalesce((SELECT max(seq) FROM ex WHERE ex.topic_id = nw.topic_id), 0) + rn AS seq FROM nw""")
def appended_entries(t):
    from pyspark.sql import Window as W

    e = t.embeddings.select(F.col("label").alias("topic_id"), "vec_id")
    existing = e.filter("vec_id % 3 = 0").withColumn("seq", F.row_number().over(W.partitionBy("topic_id").orderBy("vec_id")))
    new = e.filter("vec_id % 3 = 1").withColumn("ord", F.col("vec_id"))
    return topics.append_entries(existing, new).select("topic_id", "vec_id", "seq")


@reg.query("F14", """SELECT conv_id AS session_id, string_agg(text[1:300], ' ' ORDER BY turn) AS text, count(*) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 4 AND role IN ('user','assistant','tool') GROUP BY conv_id""")
def session_text(t):
    m = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"))
    return topics.session_text(m, 4)


@reg.query("C11", """WITH s AS (SELECT conv_id AS session_id, count(*) AS turns, conv_id % 5 AS lp, conv_id % 13 AS mins, string_agg(text[1:300], ' ' ORDER BY turn) AS text FROM conversations WHERE role IN ('user','assistant','tool') GROUP BY conv_id),
b AS (SELECT session_id, CASE WHEN session_id % 7 = 0 THEN NULL ELSE (session_id * 37 % 100) / 100.0 END AS c, session_id % 10 AS topic, session_id % 3 = 0 AS stable FROM s),
a AS (SELECT s.session_id, topic, CASE WHEN turns < 3 THEN 'skip_short' WHEN turns <= lp THEN 'skip_no_new' WHEN mins * 60 < 300 AND lp > 0 THEN 'skip_cooldown' WHEN length(trim(text)) < 30 THEN 'skip_text'
  WHEN c >= 0.75 THEN 'assign' WHEN c >= 0.55 AND stable THEN 'candidate' WHEN c >= 0.55 THEN 'changed' ELSE 'orphan' END AS action FROM s JOIN b USING (session_id))
SELECT session_id, action, CASE WHEN action IN ('assign','candidate') THEN topic END AS topic FROM a""")
def refine_decisions(t):
    m = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"))
    now = F.lit("2024-02-01").cast("timestamp")
    sid = F.col("session_id")
    s = topics.session_text(m).withColumns({
        "last_processed": sid % 5, "last_active": F.timestamp_seconds(F.unix_timestamp(now) - (sid % 13) * 60),
    })
    best = s.filter("session_id % 7 <> 0").select("session_id", (sid % 10).alias("topic"), ((sid * 37 % 100) / 100.0).alias("cosine"))
    stable = s.select("session_id", (sid % 3 == 0).alias("stable"))
    return topics.refine_decision(s, best, stable, now)


@reg.query("C10", f"""WITH tp AS (SELECT DISTINCT label AS topic_id, CASE WHEN label % 4 = 0 THEN 'archived' ELSE 'active' END AS status FROM embeddings),
en AS (SELECT label AS topic_id, max(DATE '2024-01-01' + (vec_id * 7 % (20 + label * 5))::INTEGER) AS l FROM embeddings WHERE label <> 7 GROUP BY 1)
SELECT tp.topic_id, CASE WHEN status = 'active' AND DATE '2024-02-20' - coalesce(l, DATE '2024-01-05') >= 14 THEN 'dormant' ELSE status END AS status FROM tp LEFT JOIN en USING (topic_id)""")
def dormant_topics(t):
    e = t.embeddings
    tp = e.select(F.col("label").alias("topic_id")).distinct().withColumns({
        "status": F.when(F.col("topic_id") % 4 == 0, "archived").otherwise("active"), "updated_at": F.lit("2024-01-05").cast("timestamp"),
    })
    days = F.col("vec_id") * 7 % (20 + F.col("label") * 5)
    en = e.filter("label <> 7").select(F.col("label").alias("topic_id"), F.timestamp_seconds(F.lit(E_) + days * 86400).alias("ts"))
    return topics.mark_dormant(tp, en, F.lit("2024-02-20").cast("timestamp")).select("topic_id", "status")


@reg.query("C9", """SELECT event_id, CASE WHEN event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND event_id % 5 <> 0 THEN 'moved' ELSE 'buffer' END AS place FROM events""")
def drained_candidates(t):
    b = t.events.select(
        F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 3 == 0, "candidate").otherwise("orphan").alias("action"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("topic_id"),
    )
    out, stay = topics.drain_candidates(b, F.lit("2024-01-20").cast("timestamp"))
    return out.select("id", F.lit("moved").alias("place")).unionByName(stay.select("id", F.lit("buffer").alias("place"))).withColumnRenamed("id", "event_id")


# facts: every line of ten documents in a row is a fact of their topic, whose body is the first of the ten
FACT_SQL = f"""fx AS (SELECT doc_id // 10 AS topic_id, doc_id * 100000 + i AS fact_id, CASE i % 3 WHEN 0 THEN line || '.' WHEN 1 THEN line ELSE '(' || line || ')' END AS fact FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
tb AS (SELECT doc_id // 10 AS topic_id, text AS body FROM documents WHERE doc_id % 10 = 0),
fn AS (SELECT *, regexp_replace(lower(fact), {q(R.FACT_NORMALISE)}, '', 'g') AS n FROM fx),
fb AS (SELECT fn.* FROM fn LEFT JOIN tb USING (topic_id) WHERE n <> '' AND NOT coalesce(contains(regexp_replace(lower(body), {q(R.FACT_NORMALISE)}, '', 'g'), n), false)),
fr AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY fact_id) AS rn FROM fb),
kp(topic_id, rn, ids, ns) AS (SELECT topic_id, rn, [fact_id], [n] FROM fr WHERE rn = 1
 UNION ALL SELECT fr.topic_id, fr.rn, CASE WHEN len(list_filter(ns, lambda x: contains(x, fr.n) OR contains(fr.n, x))) > 0 THEN ids ELSE list_append(ids, fr.fact_id) END, CASE WHEN len(list_filter(ns, lambda x: contains(x, fr.n) OR contains(fr.n, x))) > 0 THEN ns ELSE list_append(ns, fr.n) END
  FROM kp JOIN fr ON fr.topic_id = kp.topic_id AND fr.rn = kp.rn + 1)"""


def _facts(t):
    d = t.documents
    topic = F.floor(F.col("doc_id") / 10).alias("topic_id")
    i = F.col("p") + 1
    f = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select(
        topic, (F.col("doc_id") * 100000 + i).alias("fact_id"),
        F.when(i % 3 == 0, F.concat("line", F.lit("."))).when(i % 3 == 1, F.col("line")).otherwise(F.concat(F.lit("("), "line", F.lit(")"))).alias("fact"),
    )
    tb = d.filter("doc_id % 10 = 0").select(topic, F.col("text").alias("body"))
    return tb, f


@reg.query("P29", f"WITH RECURSIVE {FACT_SQL} SELECT topic_id, unnest(arg_max(ids, rn)) AS fact_id FROM kp GROUP BY topic_id")
def distinct_facts(t):
    return topics.distinct_facts(*_facts(t)).select("topic_id", "fact_id")


@reg.query("P28", """WITH f AS (SELECT doc_id AS fact_id, doc_id // 10 AS batch_no, CASE doc_id % 4 WHEN 0 THEN 'a [#2] b' WHEN 1 THEN 'x [# 1 ] y [#3] z [#1]' WHEN 2 THEN 'none' ELSE 'far [#99] [#4]' END AS fact FROM documents)
SELECT fact_id, CASE fact_id % 4 WHEN 0 THEN CASE WHEN batch_no * 10 + 1 < (SELECT count(*) FROM documents) THEN batch_no * 1000 + 2 END WHEN 3 THEN CASE WHEN batch_no * 10 + 3 < (SELECT count(*) FROM documents) THEN batch_no * 1000 + 4 END END AS source_qa_id,
 CASE WHEN fact_id % 4 = 1 THEN ':qa=' || (batch_no * 1000 + 1) || ',' || (batch_no * 1000 + 3) ELSE '' END AS source_suffix FROM f""")
def fact_references(t):
    k = F.col("doc_id") % 4
    batch = F.floor(F.col("doc_id") / 10)
    f = t.documents.select(
        F.col("doc_id").alias("fact_id"), batch.alias("batch_no"),
        F.when(k == 0, "a [#2] b").when(k == 1, "x [# 1 ] y [#3] z [#1]").when(k == 2, "none").otherwise("far [#99] [#4]").alias("fact"),
    )
    b = t.documents.select(batch.alias("batch_no"), (F.col("doc_id") % 10 + 1).alias("ordinal"), (batch * 1000 + F.col("doc_id") % 10 + 1).alias("qa_id"))
    return topics.fact_refs(f, b)


@reg.query("C18 P20", """WITH tp AS (SELECT doc_id AS topic_id, text AS title, source AS summary, [lang] AS kw, text AS body FROM documents WHERE doc_id % 3 <> 0),
up AS (SELECT doc_id AS topic_id, 'new ' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'sum ' || doc_id END AS summary, [source, lang] AS kw, 'fact ' || text AS fact FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT topic_id, CASE WHEN trim(coalesce(tp.title, ''), ' ' || chr(9) || chr(10)) <> '' THEN trim(tp.title, ' ' || chr(9) || chr(10)) ELSE up.title END AS title, CASE WHEN trim(coalesce(up.summary, '')) <> '' THEN up.summary ELSE tp.summary END AS summary,
 array_to_string(CASE WHEN tp.topic_id IS NULL THEN [source, lang] WHEN up.topic_id IS NULL THEN [lang] ELSE [lang, source] END, '|') AS keywords,
 md5(CASE WHEN up.topic_id IS NULL THEN tp.body WHEN tp.topic_id IS NULL OR trim(tp.body, ' ' || chr(9) || chr(10)) = '' THEN '- ' || fact ELSE tp.body || chr(10) || '- ' || fact END) AS body,
 CASE WHEN up.topic_id IS NULL THEN 'kept' WHEN tp.topic_id IS NULL THEN 'created' ELSE 'updated' END AS change FROM tp FULL JOIN up USING (topic_id) JOIN documents d ON d.doc_id = topic_id""")
def topic_updates(t):
    d = t.documents
    tp = d.filter("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("topic_id"), F.col("text").alias("title"), F.col("source").alias("summary"),
        F.array("lang").alias("keywords"), F.col("text").alias("body"),
    )
    up = d.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select(
        F.col("doc_id").alias("topic_id"), F.concat(F.lit("new "), "doc_id").alias("title"),
        F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.concat(F.lit("sum "), "doc_id")).alias("summary"),
        F.array("source", "lang").alias("keywords"), F.array(F.concat(F.lit("fact "), "text")).alias("facts"),
    )
    u = topics.apply_updates(tp, up)
    return u.withColumns({"keywords": F.array_join("keywords", "|"), "body": F.md5("body")})


@reg.query("A24 U6", """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE doc_id - doc_id % 5 END AS t, lang, source, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM documents),
k AS (SELECT t, k, min(o) AS o FROM (SELECT t, lang AS k, doc_id * 2 AS o FROM m UNION ALL SELECT t, source, doc_id * 2 + 1 FROM m) GROUP BY 1, 2)
SELECT m.t AS topic_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY doc_id) FILTER (WHERE b <> '')) AS body, (SELECT string_agg(k.k, '|' ORDER BY k.o) FROM k WHERE k.t = m.t) AS keywords, CAST(count(*) AS INTEGER) AS merged_from FROM m GROUP BY m.t""")
def merged_topics(t):
    d = t.documents
    tp = d.select(F.col("doc_id").alias("topic_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.array("lang", "source").alias("keywords"))
    mapping = d.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") - F.col("doc_id") % 5).alias("target_id"))
    m = topics.merge_topics(tp, mapping)
    return m.select("topic_id", F.md5("body").alias("body"), F.array_join("keywords", "|").alias("keywords"), "merged_from")


@reg.query("A32 T12", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id % 25 AS topic_id, md5(string_agg('[' || strftime(make_timestamp(CAST(({E_} + doc_id * 3600) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') || '] ' || text[1:300], chr(10) ORDER BY doc_id)) AS material, count(*) AS n_entries FROM e WHERE rn <= 15 GROUP BY 1""")
def synthesis_input(t):
    e = t.documents.select(
        (F.col("doc_id") % 25).alias("topic_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(E_) + F.col("doc_id") * 3600).alias("ts"),
    )
    return topics.synthesis_input(e).withColumn("material", F.md5("material"))


@reg.query("A30", """SELECT 'topics' AS part, CASE WHEN doc_id % 4 = 0 THEN 'dormant' ELSE 'active' END AS label, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'buffer', CASE WHEN user_id % 3 = 0 THEN 'none' ELSE CAST(user_id AS VARCHAR) END, count(*) FROM events GROUP BY 2""")
def topic_stats(t):
    tp = t.documents.select(F.when(F.col("doc_id") % 4 == 0, "dormant").otherwise("active").alias("status"))
    b = t.events.select(F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("topic_id"))
    return topics.topic_stats(tp, b)


# titles: the last word of every document, its letters a to o written as Han characters
TITLE_FROM, TITLE_TO = "abcdefghijklmno", "数据湖治理方案的完全不同标题名"
TITLE_SQL = f"tt AS (SELECT doc_id AS id, translate(lower(string_split(text, ' ')[-1]), '{TITLE_FROM}', '{TITLE_TO}') AS title FROM documents)"


@reg.query("C12", f"""WITH {TITLE_SQL}, u AS (SELECT title, min(id) AS id FROM tt WHERE length(title) <= 12 GROUP BY title),
c AS (SELECT *, regexp_replace(title, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g') AS z FROM u),
g AS (SELECT id, title, list_distinct(string_split(z, '')) AS ch, list_distinct(list_filter(list_transform(range(1, length(title)), lambda i: substr(title, i, 2)), lambda s: regexp_full_match(s, '[\\x{{4e00}}-\\x{{9fff}}]{{2}}'))) AS gr FROM c)
SELECT a.id, arg_max(b.id, (length(b.title), b.id)) AS folded_into FROM g a JOIN g b ON (length(b.title), b.id) > (length(a.title), a.id) AND len(list_intersect(a.gr, b.gr)) > 0 AND len(list_intersect(a.ch, b.ch)) >= 2 GROUP BY a.id""")
def title_merges(t):
    word = F.lower(F.element_at(F.split("text", " "), -1))
    return clusters.title_merges(t.documents.select(F.col("doc_id").alias("id"), F.translate(word, TITLE_FROM, TITLE_TO).alias("title")))


# notes mention topics; queries seed one or two topics
GRAPH_SQL = """mn AS (SELECT DISTINCT l_orderkey % 500 AS note, l_partkey % 120 AS topic FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 500 % 7 <> 0),
ob AS (SELECT DISTINCT l_orderkey % 500 AS note, 1000 + l_suppkey AS topic FROM lineitem WHERE l_linenumber = 1),
sd AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 4 = 0 THEN 1000 + c_custkey % 10 + 1 ELSE c_custkey % 120 END AS topic FROM customer UNION SELECT c_custkey, c_custkey * 7 % 120 FROM customer WHERE c_custkey % 4 = 1)"""


def _graph(t):
    li = t.lineitem
    note = (F.col("l_orderkey") % 500).alias("note")
    mn = li.filter("l_linenumber <= 2 and l_orderkey % 500 % 7 <> 0").select(note, (F.col("l_partkey") % 120).alias("topic")).distinct()
    ob = li.filter("l_linenumber = 1").select(note, (F.col("l_suppkey") + 1000).alias("topic")).distinct()
    c = F.col("c_custkey")
    sd = t.customer.select(c.alias("query_id"), F.when(c % 4 == 0, 1000 + c % 10 + 1).otherwise(c % 120).alias("topic")).unionByName(
        t.customer.filter("c_custkey % 4 = 1").select(c.alias("query_id"), (c * 7 % 120).alias("topic"))
    ).distinct()
    return sd, mn, ob


@reg.query("J16 D15", f"""WITH {GRAPH_SQL}, h1 AS (SELECT DISTINCT sd.query_id, b.topic AS related FROM sd JOIN mn a ON a.topic = sd.topic JOIN mn b ON b.note = a.note WHERE (sd.query_id, b.topic) NOT IN (SELECT query_id, topic FROM sd)),
k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY related) AS rank FROM h1 QUALIFY rank <= 5),
h2 AS (SELECT DISTINCT sd.query_id, b.topic AS related FROM sd JOIN ob a ON a.topic = sd.topic JOIN mn b ON b.note = a.note WHERE sd.query_id NOT IN (SELECT query_id FROM k1) AND (sd.query_id, b.topic) NOT IN (SELECT query_id, topic FROM sd)),
k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY related) AS rank FROM h2 QUALIFY rank <= 5)
SELECT query_id, related, rank, 'co_mention' AS hop FROM k1 UNION ALL SELECT query_id, related, rank, 'observed_in' FROM k2""")
def related_topics(t):
    sd, mn, ob = _graph(t)
    return graph.related_topics(sd, mn, ob, 5)


@reg.query("J17", """WITH e AS (SELECT l_partkey % 50 AS src, 50 + l_suppkey % 30 AS dst, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY 1, 2), b AS (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e),
k AS (SELECT src AS topic, dst AS neighbour, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM b) SELECT * FROM k WHERE rank <= 4""")
def weighted_neighbours(t):
    e = t.lineitem.groupBy((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 30 + 50).alias("dst")).agg(F.round(F.sum("l_quantity"), 2).alias("weight"))
    nodes = e.select(F.col("src").alias("topic")).unionByName(e.select(F.col("dst").alias("topic"))).distinct()
    return graph.weighted_neighbours(nodes, e, 4)


@reg.query("T14", f"""SELECT doc_id, '- [' || lang || '] ' || text[1:60] AS line FROM documents WHERE {E_} + doc_id * 3600 >= {E_} + 150 * 3600 - 14 * 86400 ORDER BY doc_id DESC LIMIT 20""")
def recent_records(t):
    from mnemolake.plans import context

    d = t.documents.select("doc_id", "lang", F.col("text").alias("title"), F.timestamp_seconds(F.lit(E_) + F.col("doc_id") * 3600).alias("ts"))
    return context.recent_records(d, "doc_id", F.timestamp_seconds(F.lit(E_ + 150 * 3600)))


@reg.query("T12", "SELECT topic_id, doc_id, rank FROM (SELECT doc_id % 25 AS topic_id, doc_id, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def first_entries(t):
    from mnemolake.plans import context

    return context.first_entries(t.documents.select((F.col("doc_id") % 25).alias("topic_id"), F.col("doc_id").alias("seq")), 5).withColumnRenamed("seq", "doc_id")


@reg.query("S11", """WITH l AS (SELECT doc_id, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) AS i FROM (SELECT doc_id, 'title' || chr(10) || 'user: ' || text || chr(10) || 'assistant:' || chr(10) || source || chr(10) || 'more' AS c FROM documents)),
f AS (SELECT *, sum(CASE WHEN starts_with(trim(line, ' ' || chr(9) || chr(13)), 'user:') OR starts_with(trim(line, ' ' || chr(9) || chr(13)), 'assistant:') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS b FROM l)
SELECT doc_id, CAST(b - 1 AS BIGINT) AS block_no, CASE WHEN b = 1 THEN 'user' ELSE 'assistant' END AS role, md5(trim(string_agg(CASE WHEN starts_with(line, 'user: ') AND b = 1 AND i = 2 THEN trim(substr(line, 7), ' ' || chr(9) || chr(13)) WHEN line = 'assistant:' THEN NULL ELSE line END, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13))) AS content FROM f WHERE b > 0 GROUP BY doc_id, b""")
def role_transcripts(t):
    from mnemolake.sources import markdown

    d = t.documents.select("doc_id", F.concat(F.lit("title\nuser: "), "text", F.lit("\nassistant:\n"), "source", F.lit("\nmore")).alias("c"))
    lines = d.select("doc_id", F.posexplode(F.split("c", "\n")).alias("line_no", "value"))
    return markdown.role_blocks(lines, ["doc_id"]).select("doc_id", "block_no", "role", F.md5("content").alias("content"))


@reg.query("S12 G5", """WITH c AS (SELECT doc_id, string_split('# First Part' || chr(10) || text || chr(10) || '## Second: x' || chr(10) || 'end', chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM c),
h AS (SELECT doc_id, i, n, regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*$', 2) AS title FROM l WHERE regexp_matches(line, '^#{1,6}\\s+\\S')),
s AS (SELECT doc_id, title, i + 1 AS line_start, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, n) AS line_end FROM h)
SELECT doc_id, title, regexp_replace(regexp_replace(lower(title), '\\s+', '-', 'g'), '[^a-z0-9._-]+', '', 'g') AS slug, line_start, line_end, md5(coalesce((SELECT string_agg(line, chr(10) ORDER BY i) FROM l WHERE l.doc_id = s.doc_id AND l.i BETWEEN line_start AND line_end), '')) AS body FROM s""")
def heading_sections(t):
    from mnemolake.sources import markdown

    d = t.documents.select("doc_id", F.concat(F.lit("# First Part\n"), "text", F.lit("\n## Second: x\nend")).alias("c"))
    lines = d.select("doc_id", F.posexplode(F.split("c", "\n")).alias("_p", "value")).withColumn("line_no", F.col("_p") + 1)
    s = markdown.heading_sections(lines, ["doc_id"])
    return s.select("doc_id", "title", "slug", "line_start", "line_end", F.md5("body").alias("body"))


@reg.query("S13", """WITH c AS (SELECT doc_id, '## A' || chr(10) || text || chr(10) || '## B' || chr(10) || 'short' || chr(10) || '## C ' || source || chr(10) || text AS c FROM documents),
p AS (SELECT doc_id, unnest(string_split(c, chr(10) || '## ')) AS sec, generate_subscripts(string_split(c, chr(10) || '## '), 1) AS i FROM c),
s AS (SELECT doc_id, i, trim(CASE WHEN i = 1 THEN sec ELSE '## ' || sec END, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM p)
SELECT doc_id, trim(regexp_extract(body, '^##\\s+([^\\n]+)', 1))[1:100] AS section, md5(body[1:6000]) AS content FROM s WHERE length(body) >= 30""")
def note_sections(t):
    from mnemolake.sources import markdown

    d = t.documents.select("doc_id", F.concat(F.lit("## A\n"), "text", F.lit("\n## B\nshort\n## C "), "source", F.lit("\n"), "text").alias("c"))
    return markdown.note_sections(d, ["doc_id"], "c").select("doc_id", "section", F.md5("content").alias("content"))
