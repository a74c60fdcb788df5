"""Registered queries: ranks, fusion, decay, promotion, reranking, selection, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.catalog.base import Registry, q
from mnemolake.operators import fusion, lineage

reg = Registry()

# candidate hits derived from documents: each names a query, a kind, one to three paths and scores
HITS_SQL = """hb AS (SELECT doc_id, doc_id % 23 AS query_id, CASE doc_id % 4 WHEN 0 THEN 'qa' WHEN 1 THEN 'topic' WHEN 2 THEN 'note' ELSE 'assistant_delivery' END AS kind,
  'i' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS source_id, round((n_chars % 1009) / 1009.0, 6)::DOUBLE AS s, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 200) END AS created_at FROM documents),
hits AS (SELECT query_id, kind, source_id, 'keyword' AS path, s AS raw_score, 0.0::DOUBLE AS cosine, created_at FROM hb WHERE doc_id % 3 <> 0
 UNION ALL SELECT query_id, kind, source_id, CASE kind WHEN 'qa' THEN 'qa_vector' WHEN 'topic' THEN 'topic_vector' WHEN 'note' THEN 'note_vector' ELSE 'vector' END, 1 - s, 1 - s, created_at FROM hb WHERE doc_id % 5 <> 1
 UNION ALL SELECT query_id, kind, source_id, 'qa_keyword', s, 0.0, created_at FROM hb WHERE kind = 'qa'),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY raw_score DESC, kind, source_id) AS raw_rank FROM hits),
fz AS (SELECT query_id, kind, source_id, round(sum(CASE path WHEN 'keyword' THEN 0.5 WHEN 'topic_vector' THEN 2.0 ELSE 1.0 END::DOUBLE / (60.0 + raw_rank)::DOUBLE), 6) AS rrf, max(cosine) AS cosine, max(created_at) AS created_at, count(*) AS votes FROM rk GROUP BY 1, 2, 3),
dc AS (SELECT *, CASE WHEN kind = 'qa' OR created_at IS NULL THEN rrf ELSE round(rrf * greatest(exp(-greatest(floor((epoch(TIMESTAMP '2024-06-01') - epoch(created_at)) / 86400), 0) / 30.0), 0.05), 6) END AS score FROM fz),
sg AS (SELECT query_id, source_id, doc_id % 7 AS min_freq, doc_id % 3 AS low_freq_terms FROM hb WHERE kind IN ('qa', 'assistant_delivery')),
rr AS (SELECT dc.* REPLACE (round(score + CASE WHEN kind = 'qa' AND source_id IN (SELECT source_id FROM hb WHERE doc_id % 16 = 4) THEN 0.08 ELSE 0 END, 6) AS score) FROM dc),
el AS (SELECT query_id, kind, source_id, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, source_id) AS rn FROM rr JOIN sg USING (query_id, source_id) WHERE min_freq <= 3 OR low_freq_terms >= 2),
pb AS (SELECT rr.* REPLACE (round(score + CASE WHEN el.rn IS NULL THEN 0 ELSE 0.5 END, 6) AS score), CASE WHEN el.rn IS NULL THEN 0 ELSE 1 END AS boosted FROM rr LEFT JOIN el ON el.query_id = rr.query_id AND el.kind = rr.kind AND el.source_id = rr.source_id AND el.rn <= CASE WHEN el.kind = 'qa' THEN 2 ELSE 1 END)"""


def base_hits(t):
    d = t.documents
    k = F.col("doc_id") % 4
    days = F.lit(1704067200) + (F.col("doc_id") % 200) * 86400
    hb = d.select(
        "doc_id", (F.col("doc_id") % 23).alias("query_id"),
        F.when(k == 0, "qa").when(k == 1, "topic").when(k == 2, "note").otherwise("assistant_delivery").alias("kind"),
        F.concat(F.lit("i"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("source_id"),
        F.round((F.col("n_chars") % 1009) / 1009.0, 6).alias("s"),
        F.when(F.col("doc_id") % 9 != 0, F.timestamp_seconds(days)).alias("created_at"),
    )
    cols = ["query_id", "kind", "source_id", "path", "raw_score", "cosine", "created_at"]
    vec_path = F.when(F.col("kind") == "qa", "qa_vector").when(F.col("kind") == "topic", "topic_vector").when(F.col("kind") == "note", "note_vector").otherwise("vector")
    zero = F.lit(0.0)
    lanes = [
        hb.filter("doc_id % 3 <> 0").withColumns({"path": F.lit("keyword"), "raw_score": F.col("s"), "cosine": zero}),
        hb.filter("doc_id % 5 <> 1").withColumns({"path": vec_path, "raw_score": 1 - F.col("s"), "cosine": 1 - F.col("s")}),
        hb.filter("kind = 'qa'").withColumns({"path": F.lit("qa_keyword"), "raw_score": F.col("s"), "cosine": zero}),
    ]
    hits = lanes[0].select(*cols).unionByName(lanes[1].select(*cols)).unionByName(lanes[2].select(*cols))
    return hb, hits


def _scored(t):
    hb, hits = base_hits(t)
    fused = fusion.fuse(fusion.ranked_paths(hits))
    return hb, hits, fusion.decayed(fused, F.lit("2024-06-01 00:00:00").cast("timestamp"))


def _promoted(t):
    hb, _, s = _scored(t)
    rare = hb.filter("doc_id % 16 = 4").select("query_id", "source_id")
    signals = hb.filter("kind in ('qa', 'assistant_delivery')").select(
        "query_id", "source_id", (F.col("doc_id") % 7).alias("min_freq"), (F.col("doc_id") % 3).alias("low_freq_terms")
    )
    return fusion.promote_exact(fusion.rare_bonus(s, rare), signals)


@reg.query("W4", f"WITH {HITS_SQL} SELECT query_id, kind, source_id, path, raw_rank FROM rk")
def path_ranks(t):
    return fusion.ranked_paths(base_hits(t)[1]).select("query_id", "kind", "source_id", "path", "raw_rank")


@reg.query("A8 U3", f"WITH {HITS_SQL} SELECT query_id, kind, source_id, rrf, votes, round(cosine, 6) AS cosine FROM fz")
def rank_fusion(t):
    f = fusion.fuse(fusion.ranked_paths(base_hits(t)[1]))
    return f.select("query_id", "kind", "source_id", "rrf", "votes", F.round("cosine", 6).alias("cosine"))


@reg.query("F7", f"WITH {HITS_SQL} SELECT query_id, kind, source_id, score FROM dc")
def time_decay(t):
    return _scored(t)[2].select("query_id", "kind", "source_id", "score")


@reg.query("T6 T7", f"WITH {HITS_SQL} SELECT query_id, kind, source_id, score, boosted FROM pb")
def exact_promotion(t):
    return _promoted(t).select("query_id", "kind", "source_id", "score", "boosted")


@reg.query("T8", f"""WITH {HITS_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, source_id) AS position FROM pb)
SELECT query_id, source_id, position, position <= 10 AS selected, CASE WHEN position > 10 THEN 'OUTSIDE_LIMIT' END AS drop_reason FROM z""")
def selection_trace(t):
    return fusion.select_hits(_promoted(t), 10).select("query_id", "source_id", "position", "selected", "drop_reason")


RERANK_SQL = f"""{HITS_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, source_id) AS fused_rank FROM pb),
sc AS (SELECT query_id, source_id, round((doc_id * 7919 % 1000) / 1000.0, 6)::DOUBLE AS rs FROM hb WHERE query_id % 5 <> 2 OR doc_id % 2 = 0),
fu AS (SELECT query_id, count(*) = count(rs) AS ok FROM w LEFT JOIN sc USING (query_id, source_id) WHERE fused_rank <= 6 GROUP BY 1),
nw AS (SELECT w.*, CASE WHEN ok AND fused_rank <= 6 THEN rs END AS ns FROM w LEFT JOIN sc USING (query_id, source_id) JOIN fu USING (query_id))"""


@reg.query("T9 G2", f"""WITH {RERANK_SQL} SELECT query_id, source_id, fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ns IS NULL THEN 1 ELSE 0 END, coalesce(ns, 0) DESC, fused_rank) AS position, coalesce(ns, score) AS final_score FROM nw""")
def rerank_window(t):
    hb, _ = base_hits(t)
    scores = hb.filter("query_id % 5 <> 2 or doc_id % 2 = 0").select(
        "query_id", "source_id", F.round((F.col("doc_id") * 7919 % 1000) / 1000.0, 6).alias("rerank_score")
    )
    return fusion.rerank(_promoted(t), scores, 6).select("query_id", "source_id", "fused_rank", "position", "final_score")


_LANE_SQL = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.LANE_OF_KIND.items()) + " ELSE 'vector' END"


@reg.query("A29 F13", f"WITH {HITS_SQL} SELECT query_id, {_LANE_SQL} AS lane, count(DISTINCT source_id) AS candidates, count(*) AS votes FROM rk GROUP BY 1, 2")
def lane_accounting(t):
    return fusion.lane_accounting(base_hits(t)[1])


@reg.query("P30", f"""WITH {HITS_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, source_id) AS position FROM pb),
tp AS (SELECT query_id, max(CASE WHEN position = 1 THEN cosine END) AS a, max(CASE WHEN position = 2 THEN cosine END) AS b FROM z GROUP BY 1),
qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 6 = 0 THEN '具体 ' || text ELSE text END AS text FROM benchmark)
SELECT query_id, contains(text, '具体') OR coalesce(a < 0.6, false) OR coalesce(abs(a - b) < 0.05, false) AS expand FROM qs LEFT JOIN tp USING (query_id)""")
def expand_decision(t):
    qs = t.benchmark.select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 6 == 0, F.concat(F.lit("具体 "), "text")).otherwise(F.col("text")).alias("text")
    )
    return fusion.should_expand(qs, fusion.select_hits(_promoted(t), 10))


@reg.query("P33", "SELECT doc_id, md5('- i' || doc_id || ' | ' || source || ' [' || lang || '] (score=' || printf('%.3f', (doc_id % 8) / 8.0) || ')' || chr(10) || '  ' || text) AS unit FROM documents")
def unit_rendering(t):
    u = fusion.unit_text(
        F.concat(F.lit("i"), "doc_id"), F.col("source"), F.col("lang"), (F.col("doc_id") % 8) / 8.0, F.col("text")
    )
    return t.documents.select("doc_id", F.md5(u).alias("unit"))


@reg.query("W15", f"""WITH RECURSIVE {HITS_SQL}, z AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, source_id) AS rank, 100 + CAST(floor(score * 1000000) AS BIGINT) % 400 AS n_chars FROM pb),
u AS (SELECT * FROM z WHERE rank <= 20),
f(query_id, rank, used, kept) AS (SELECT query_id, rank, CASE WHEN 50 + n_chars + 2 <= 1500 THEN 50 + n_chars + 2 ELSE 50 END, 50 + n_chars + 2 <= 1500 FROM u WHERE rank = 1
 UNION ALL SELECT u.query_id, u.rank, CASE WHEN used + n_chars + 2 <= 1500 THEN used + n_chars + 2 ELSE used END, used + n_chars + 2 <= 1500 FROM f JOIN u ON u.query_id = f.query_id AND u.rank = f.rank + 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, source_id, n_chars, CASE WHEN kept THEN 'injected' ELSE 'CHAR_BUDGET' END AS outcome FROM f JOIN u USING (query_id, rank)""")
def context_packing(t):
    sel = fusion.select_hits(_promoted(t), 20).filter("selected")
    units = sel.select(
        "query_id", F.col("position").alias("rank"), "source_id",
        (F.lit(100) + F.floor(F.col("score") * 1000000) % 400).alias("n_chars"),
    )
    return fusion.pack_context(units, 1500, 50)


@reg.query("J22", f"""WITH {HITS_SQL}, gone AS (SELECT kind, source_id FROM hb WHERE doc_id % 6 = 1) SELECT h.query_id, h.kind, h.source_id, h.path FROM hits h WHERE (h.kind, h.source_id) NOT IN (SELECT kind, source_id FROM gone)""")
def suppressed_hits(t):
    hb, hits = base_hits(t)
    ledger = hb.filter("doc_id % 6 = 1").select(F.col("kind").alias("derived_kind"), F.col("source_id").alias("derived_id"))
    return lineage.suppress(hits, ledger.unionByName(ledger)).select("query_id", "kind", "source_id", "path")


@reg.query("T1 A8 T6 T7 T8 J22 F7")
def recall_trace(t):
    """The whole retrieval over all benchmark queries (rows only: lanes mix text and vectors)."""
    from mnemolake.plans import recall

    v = t.embeddings.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    n = t.embeddings.agg(F.count("*").alias("n")).scalar()
    docs = t.documents.withColumn("vec_id", F.pmod(F.col("doc_id"), n)).join(v, "vec_id")
    k = F.col("doc_id") % 3
    items = docs.select(
        F.col("doc_id").alias("id"), F.when(k == 0, "qa").when(k == 1, "topic").otherwise("note").alias("kind"), "text", "vec",
        F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 200) * 86400).alias("created_at"),
    )
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text", F.pmod(F.col("item_id") * 7, n).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    ledger = items.filter("id % 11 = 1").select(F.col("kind").alias("derived_kind"), F.concat_ws("_", "kind", "id").alias("derived_id"))
    out = recall.recall(queries, items, ledger, F.lit("2024-08-01").cast("timestamp"), floor=0.1)
    return out.select("query_id", "kind", "source_id", "score", "position", "selected", "drop_reason")
