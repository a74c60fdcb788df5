"""Registered queries: retrieval evaluation, run comparison, provider hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.catalog.base import Registry
from mnemolake.functions import text as T
from mnemolake.operators import evaluation as E
from mnemolake.operators import providers

reg = Registry()

# every document is a case: a ranking of ten source ids, gold ids from its label
CASE_SQL = """cs AS (SELECT d.doc_id AS case_id, CASE d.doc_id % 5 WHEN 4 THEN '' ELSE d.lang END AS category, list_transform(range(0, 10), lambda i: (d.doc_id * 7 + i * (1 + d.doc_id % 3)) % 40) AS ranked,
 CASE WHEN l.quality = 1 THEN [d.n_chars % 40, (d.n_chars + 13) % 40] WHEN l.quality = 0 THEN [d.n_chars % 40] ELSE []::BIGINT[] END AS gold FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)),
sc AS (SELECT case_id, CASE WHEN category = '' THEN '__unlabelled__' ELSE category END AS category, len(gold) AS gold_count, list_min(list_filter(list_transform(gold, lambda g: list_position(ranked, g)), lambda p: p > 0)) AS rr FROM cs),
pc AS (SELECT *, CASE WHEN rr <= 1 THEN 1.0 ELSE 0 END AS h1, CASE WHEN rr <= 5 THEN 1.0 ELSE 0 END AS h5, CASE WHEN rr <= 8 THEN 1.0 ELSE 0 END AS hk, CASE WHEN rr <= 8 THEN 1.0 / rr ELSE 0 END AS m FROM sc)"""


def _cases(t):
    d = t.documents.join(t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    doc = F.col("doc_id")
    ranked = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (doc * 7 + i * (1 + doc % 3)) % 40)
    gold = F.when(F.col("quality") == 1, F.array(F.col("n_chars") % 40, (F.col("n_chars") + 13) % 40)).when(
        F.col("quality") == 0, F.array(F.col("n_chars") % 40)
    ).otherwise(F.array().cast("array<bigint>"))
    return d.select(doc.alias("case_id"), F.when(doc % 5 == 4, "").otherwise(F.col("lang")).alias("category"), ranked.alias("ranked"), gold.alias("gold"))


@reg.query("A25", f"WITH {CASE_SQL} SELECT case_id, category, gold_count::INTEGER AS gold_count, rr AS relevant_rank, h1::DOUBLE AS hit_at_1, h5::DOUBLE AS hit_at_5, hk::DOUBLE AS hit_at_k, round(m, 6)::DOUBLE AS mrr FROM pc")
def case_scores(t):
    return E.score_cases(_cases(t), 8, 8).drop("observed_k").withColumn("mrr", F.round("mrr", 6))


@reg.query("A25", f"""WITH {CASE_SQL} SELECT category, count(*) AS questions, count(*) FILTER (WHERE gold_count > 0) AS questions_with_evidence, round(avg(h1), 6)::DOUBLE AS hit_at_1, round(avg(h5), 6)::DOUBLE AS hit_at_5, round(avg(hk), 6)::DOUBLE AS hit_at_k, 'ok' AS hit_at_k_status,
 round(avg(m), 6)::DOUBLE AS mrr, round(coalesce(avg(CASE WHEN rr <= 8 THEN rr END), 0), 6)::DOUBLE AS mean_relevant_rank FROM pc GROUP BY category""")
def category_metrics(t):
    return E.category_metrics(E.score_cases(_cases(t), 8, 8), 8, 8)


@reg.query("A26", f"""WITH {CASE_SQL}, a AS (SELECT case_id, gold, ranked[1:6] AS ranked, ranked[1:3] AS sel, ranked AS cand, ranked[5:8] AS inj, CASE WHEN case_id % 20 = 3 THEN '' ELSE 't' || case_id // 2 END AS tid, CASE WHEN case_id % 15 = 7 THEN 'engine_error' ELSE 'ok' END AS st FROM cs)
SELECT count(*) AS questions_total, count(DISTINCT nullif(tid, '')) AS traces, sum(len(cand))::BIGINT AS candidates, sum(len(sel))::BIGINT AS selected, sum(len(inj))::BIGINT AS injection_outcomes, sum(len(list_distinct(gold)))::BIGINT AS gold_evidence,
 sum(len(list_intersect(list_distinct(gold), list_distinct(list_concat(list_concat(ranked, sel), inj)))))::BIGINT AS gold_evidence_retrieved, count(*) FILTER (WHERE tid = '' OR st <> 'ok') AS bypasses FROM a""")
def coverage_audit(t):
    c = _cases(t)
    return E.coverage_audit(c.select(
        F.when(F.col("case_id") % 20 == 3, "").otherwise(F.concat(F.lit("t"), F.floor(F.col("case_id") / 2))).alias("trace_id"),
        F.when(F.col("case_id") % 15 == 7, "engine_error").otherwise("ok").alias("status"),
        F.slice("ranked", 1, 6).alias("ranked"), F.slice("ranked", 1, 3).alias("selected"), F.col("ranked").alias("candidates"),
        F.slice("ranked", 5, 4).alias("injected"), F.array_distinct("gold").alias("gold"),
    ))


FAIL_SQL = f"""{CASE_SQL}, f0 AS (SELECT case_id, category, CASE WHEN case_id % 19 = 0 THEN 'boom' END AS err, CASE WHEN case_id % 17 = 1 THEN [1] ELSE []::INT[] END AS arch, case_id % 13 = 2 AS ee, CASE WHEN case_id % 26 = 2 THEN []::BIGINT[] ELSE ranked END AS ret, gold AS must, [case_id % 40] AS forbid FROM cs),
f1 AS (SELECT *, list_min(list_filter(list_transform(must, lambda g: list_position(ret, g)), lambda p: p > 0)) AS br FROM f0),
fl AS (SELECT *, CASE WHEN err IS NOT NULL THEN 'PIPELINE_ERROR' WHEN len(arch) > 0 THEN 'ARCHIVED_MEMORY_RETURNED' WHEN ee THEN CASE WHEN len(ret) > 0 THEN 'WRONG_MEMORY' ELSE 'PASS' END WHEN len(must) > 0 AND br IS NULL THEN 'NOT_RETRIEVED' WHEN len(must) > 0 AND br > 3 THEN 'RANKED_TOO_LOW' WHEN len(list_intersect(forbid, ret)) > 0 THEN 'WRONG_MEMORY' ELSE 'PASS' END AS label FROM f1),
fs AS (SELECT *, CASE WHEN label = 'PASS' THEN 'PASS' WHEN label = 'PIPELINE_ERROR' THEN 'ERROR' ELSE 'FAIL' END AS status, case_id % 16 = 5 AS unsup, (case_id * 37 % 1000)::DOUBLE AS ms, len(list_intersect(forbid, ret)) AS viol FROM fl)"""


def _labelled(t):
    c = _cases(t)
    k = F.col("case_id")
    q = c.select(
        "case_id", "category", F.when(k % 19 == 0, "boom").alias("raw_error"), F.lit("active").alias("expected_status"),
        F.when(k % 17 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("archived_returned"), (k % 13 == 2).alias("expect_empty"),
        F.when(k % 26 == 2, F.array().cast("array<bigint>")).otherwise(F.col("ranked")).alias("returned"), F.col("gold").alias("must_recall"),
        F.array(k % 40).alias("must_not_recall"), F.lit(3).alias("rank_max"),
    )
    l = E.query_failure(q)
    return l.withColumns({
        "status": F.when(F.col("label") == "PASS", "PASS").when(F.col("label") == "PIPELINE_ERROR", "ERROR").otherwise("FAIL"),
        "unsupported": k % 16 == 5, "elapsed_ms": (k * 37 % 1000).cast("double"),
        "violations": F.size(F.array_intersect("must_not_recall", "returned")),
    })


@reg.query("A33", f"WITH {FAIL_SQL} SELECT case_id, label, br AS best_rank FROM fl")
def query_failure_labels(t):
    return _labelled(t).select("case_id", "label", "best_rank")


@reg.query("A27", f"""WITH {FAIL_SQL} SELECT count(*) AS scenario_count, count(*) FILTER (WHERE unsup) AS unsupported_count, count(*) FILTER (WHERE status = 'PASS') AS pass_count, count(*) FILTER (WHERE status = 'FAIL') AS fail_count, count(*) FILTER (WHERE status = 'ERROR') AS error_count,
 round(count(*) FILTER (WHERE status = 'PASS') / (count(*) - count(*) FILTER (WHERE unsup)), 6) AS pass_rate, round(count(br) FILTER (WHERE len(must) > 0) / count(*) FILTER (WHERE len(must) > 0), 6) AS must_recall_hit_rate, round(count(*) FILTER (WHERE viol > 0) / count(*), 6) AS must_not_recall_violation_rate,
 round(count(*) FILTER (WHERE br <= 1) / count(*) FILTER (WHERE len(must) > 0), 6) AS hit_at_1, round(count(*) FILTER (WHERE br <= 3) / count(*) FILTER (WHERE len(must) > 0), 6) AS hit_at_3, round(count(*) FILTER (WHERE br <= 5) / count(*) FILTER (WHERE len(must) > 0), 6) AS hit_at_5,
 round(avg(1.0 / br), 6)::DOUBLE AS mrr, sum(viol)::BIGINT AS false_positives, count(*) FILTER (WHERE len(must) > 0 AND br IS NULL) AS misses, round(quantile_cont(ms, 0.5), 6) AS median_latency_ms, round(quantile_cont(ms, 0.95), 6) AS p95_latency_ms FROM fs""")
def scenario_metrics(t):
    l = _labelled(t)
    return E.scenario_metrics(l.select("status", "unsupported"), l)


@reg.query("A27", f"WITH {FAIL_SQL} SELECT category, count(*) AS n, round(avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS pass_rate FROM fs WHERE NOT unsup GROUP BY 1")
def category_pass_rates(t):
    return E.pass_rate_by(_labelled(t), "category")


RUN_SQL = f"""{FAIL_SQL}, rb AS (SELECT case_id, category, status, label FROM fs WHERE case_id % 25 <> 1), rc AS (SELECT case_id, category, CASE WHEN case_id % 6 = 0 THEN 'PASS' WHEN case_id % 7 = 0 THEN 'FAIL' ELSE status END AS status, CASE WHEN case_id % 6 = 0 THEN 'PASS' WHEN case_id % 7 = 0 THEN 'NOT_RETRIEVED' ELSE label END AS label FROM fs WHERE case_id % 25 <> 2),
rf AS (SELECT case_id, coalesce(b.category, c.category) AS category, b.status AS bs, c.status AS cs_, b.label AS bl, c.label AS cl FROM rb b FULL JOIN rc c USING (case_id)),
rg AS (SELECT *, CASE bs WHEN 'PASS' THEN 3 WHEN 'FAIL' THEN 2 WHEN 'ERROR' THEN 1 END AS br_, CASE cs_ WHEN 'PASS' THEN 3 WHEN 'FAIL' THEN 2 WHEN 'ERROR' THEN 1 END AS cr_,
 coalesce(bs = 'FAIL' AND bl IN ('NOT_RETRIEVED','RANKED_TOO_LOW','WRONG_MEMORY'), false) AS bm, coalesce(cs_ = 'FAIL' AND cl IN ('NOT_RETRIEVED','RANKED_TOO_LOW','WRONG_MEMORY'), false) AS cm, bs IS NOT NULL AND cs_ IS NOT NULL AS both_ FROM rf),
rh AS (SELECT case_id, category, CASE WHEN cs_ IS NULL THEN 'only_base' WHEN bs IS NULL THEN 'only_candidate' WHEN bs = cs_ AND bl = cl THEN 'unchanged' ELSE 'changed' END AS presence, CASE WHEN NOT both_ THEN NULL WHEN cr_ > br_ THEN 'improved' WHEN cr_ < br_ THEN 'regressed' ELSE 'unchanged' END AS direction, both_ AND cm AND NOT bm AS new_miss, both_ AND bm AND NOT cm AS fixed_miss, bs AS b_status, cs_ AS c_status FROM rg)"""


def _runs(t):
    l = _labelled(t).select("case_id", "category", "status", "label")
    k = F.col("case_id")
    cand = l.filter("case_id % 25 <> 2").withColumns({
        "status": F.when(k % 6 == 0, "PASS").when(k % 7 == 0, "FAIL").otherwise(F.col("status")),
        "label": F.when(k % 6 == 0, "PASS").when(k % 7 == 0, "NOT_RETRIEVED").otherwise(F.col("label")),
    })
    return l.filter("case_id % 25 <> 1"), cand


@reg.query("A28 J30 U4", f"WITH {RUN_SQL} SELECT * FROM rh")
def run_flips(t):
    return E.run_flips(*_runs(t))


@reg.query("A28", f"""WITH {RUN_SQL}, v AS (SELECT count(*) FILTER (WHERE direction = 'improved') AS improved, count(*) FILTER (WHERE direction = 'regressed') AS regressed, count(*) FILTER (WHERE new_miss) AS new_misses, count(*) FILTER (WHERE fixed_miss) AS fixed_misses,
 avg(CASE WHEN direction IS NOT NULL THEN CASE WHEN c_status = 'PASS' THEN 1.0 ELSE 0 END END) - avg(CASE WHEN direction IS NOT NULL THEN CASE WHEN b_status = 'PASS' THEN 1.0 ELSE 0 END END) AS d FROM rh)
SELECT improved, regressed, new_misses, fixed_misses, CASE WHEN d > 0.01 AND improved >= regressed THEN 'improved' WHEN d < -0.01 AND regressed > improved THEN 'regressed' WHEN improved <> regressed THEN 'mixed' ELSE 'unchanged' END AS verdict, round(d, 6)::DOUBLE AS pass_rate_delta FROM v""")
def run_verdict(t):
    return E.verdict(E.run_flips(*_runs(t)))


@reg.query("A28", f"""WITH {RUN_SQL}, b AS (SELECT category, round(avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0 END), 6) AS r FROM rb GROUP BY 1), c AS (SELECT category, round(avg(CASE WHEN status = 'PASS' THEN 1.0 ELSE 0 END), 6) AS r FROM rc GROUP BY 1)
SELECT category, coalesce(b.r, 0)::DOUBLE AS base_rate, coalesce(c.r, 0)::DOUBLE AS cand_rate, round(coalesce(c.r, 0) - coalesce(b.r, 0), 6)::DOUBLE AS delta FROM b FULL JOIN c USING (category)""")
def category_deltas(t):
    b, c = _runs(t)
    rate = lambda d: E.pass_rate_by(d.withColumn("unsupported", F.lit(False)), "category")
    return E.category_delta(rate(b), rate(c))


@reg.query("A34", f"""WITH {CASE_SQL}, a AS (SELECT case_id, hk AS h, m, (case_id * 37 % 1000)::DOUBLE AS ms FROM pc WHERE case_id % 25 <> 1), b AS (SELECT case_id, CASE WHEN case_id % 9 = 0 THEN 0 ELSE hk END AS h, m, (case_id * 41 % 1000)::DOUBLE AS ms FROM pc WHERE case_id % 25 <> 2)
SELECT count(*) AS cases, count(*) FILTER (WHERE a.h IS NOT NULL AND b.h IS NOT NULL) AS shared, round(max(abs(a.h - b.h)), 6)::DOUBLE AS hit_at_k_max, round(avg(abs(a.h - b.h)), 6)::DOUBLE AS hit_at_k_mean, round(max(abs(a.ms - b.ms)), 6) AS ms_max, round(avg(abs(a.ms - b.ms)), 6) AS ms_mean FROM a FULL JOIN b USING (case_id)""")
def repeatability(t):
    s = E.score_cases(_cases(t), 8, 8).select("case_id", "hit_at_k")
    k = F.col("case_id")
    a = s.filter("case_id % 25 <> 1").withColumn("ms", (k * 37 % 1000).cast("double"))
    b = s.filter("case_id % 25 <> 2").withColumn("hit_at_k", F.when(k % 9 == 0, 0.0).otherwise(F.col("hit_at_k"))).withColumn("ms", (k * 41 % 1000).cast("double"))
    return E.repeatability(a, b, ["hit_at_k", "ms"])


@reg.query("J28", """WITH p AS (SELECT 's' || conv_id AS session_id, 'D:' || turn AS message_id, conv_id || '-' || turn // 2 AS source_id FROM conversations),
c AS (SELECT conv_id AS case_id, 's' || conv_id AS session_id, ['D:' || conv_id % 9, 'D:' || conv_id % 5 + 3, 'D:999', 'D:1 D:2'] AS ev FROM (SELECT DISTINCT conv_id FROM conversations)),
e AS (SELECT DISTINCT case_id, session_id, unnest(ev) AS m FROM c), r AS (SELECT e.*, regexp_full_match(m, '[A-Za-z0-9_]+:[0-9]+') AS ok, coalesce((SELECT min(source_id) FROM p WHERE p.session_id = e.session_id AND message_id = m), (SELECT min(source_id) FROM p WHERE message_id = m)) AS s FROM e)
SELECT case_id, string_agg(DISTINCT CASE WHEN ok THEN s END, '|' ORDER BY CASE WHEN ok THEN s END) AS gold, count(*) FILTER (WHERE ok AND s IS NULL) AS unmapped, count(*) FILTER (WHERE NOT ok) AS unresolved FROM r GROUP BY 1""")
def gold_evidence(t):
    c = t.conversations
    pairs = c.select(
        F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(F.lit("D:"), "turn").alias("message_id"),
        F.concat("conv_id", F.lit("-"), F.floor(F.col("turn") / 2)).alias("source_id"),
    )
    k = F.col("conv_id")
    cases = c.select("conv_id").distinct().select(
        k.alias("case_id"), F.concat(F.lit("s"), k).alias("session_id"),
        F.array(F.concat(F.lit("D:"), k % 9), F.concat(F.lit("D:"), k % 5 + 3), F.lit("D:999"), F.lit("D:1 D:2")).alias("evidence"),
    )
    return E.resolve_evidence(cases, pairs).withColumn("gold", F.array_join("gold", "|"))


@reg.query("J29", """WITH r AS (SELECT l_orderkey AS case_id, l_linenumber AS rank, l_partkey AS cand FROM lineitem), m AS (SELECT p_partkey AS cand, 'src' || p_size AS s FROM part WHERE p_partkey % 6 <> 0),
o AS (SELECT case_id, coalesce(s, CAST(r.cand AS VARCHAR)) AS s, min(rank) AS rank FROM r LEFT JOIN m USING (cand) GROUP BY 1, 2) SELECT case_id, string_agg(s, '|' ORDER BY rank, s) AS ranked FROM o GROUP BY 1""")
def mapped_rankings(t):
    r = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").cast("string").alias("candidate_id"))
    m = t.part.filter("p_partkey % 6 <> 0").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.concat(F.lit("src"), F.col("p_size")).alias("source_id"))
    return E.map_ranking(r, m).withColumn("ranked", F.array_join("ranked", "|"))


@reg.query("G1 G6 F11")
def embedding_outcomes(t):
    """Every document through the embedding hook with the deterministic test embedder."""
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 50 == 7, " ").otherwise(F.col("text")).alias("text"))
    out = providers.embed(d, "doc_id", "text", lambda texts: [providers.deterministic_vector(x) for x in texts])
    return out.groupBy("outcome", "error_class").agg(F.count("*").alias("n"), F.countDistinct("sha").alias("texts"))


@reg.query("F11", "SELECT doc_id AS id FROM documents WHERE length(trim(text)) > 0")
def hashed_embeddings(t):
    v = providers.hashed_embedding(t.documents, "doc_id", T.tokenize(F.col("text")))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return v.filter(F.abs(length - 1) < 1e-9).select("id")


@reg.query("G3", "SELECT doc_id, 'seed_' || text[1:20] || '…' AS generated FROM documents")
def default_labels(t):
    return providers.generate_text(t.documents.select("doc_id", "text"), "doc_id", "text").select("doc_id", "generated")
