"""Retrieval evaluation: evidence mapping, per-case and per-category metrics, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.frames import side_by_side

STATUS_RANK = {"PASS": 3, "FAIL": 2, "ERROR": 1}
# fixed values: labels that mean recall itself failed
RECALL_FAILURES = ("NOT_RETRIEVED", "NOT_INDEXED", "NOT_STORED", "RANKED_TOO_LOW", "WRONG_MEMORY", "UNKNOWN")


def resolve_evidence(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Evidence message ids to source ids: same session first, then any session.

    ``cases``: case_id, session_id, evidence (array). ``pairs``: session_id,
    message_id, source_id. Malformed ids (several in one string) are unresolved,
    well-formed ids with no pair are unmapped; both stay counted.
    """
    ev = cases.select("case_id", "session_id", F.explode("evidence").alias("ev")).distinct()
    ok = F.col("ev").rlike(r"^[A-Za-z0-9_]+:[0-9]+$")
    good = ev.filter(ok)
    # one row per message before the joins: a message id that every session uses never meets all its sources in every case
    here = pairs.groupBy("session_id", F.col("message_id").alias("ev")).agg(F.min("source_id").alias("_s"))
    same = good.join(here, ["session_id", "ev"]).groupBy("case_id", "ev").agg(F.min("_s").alias("_s"))
    anywhere = here.groupBy("ev").agg(F.min("_s").alias("_a"))
    told = ev.join(same, ["case_id", "ev"], "left").join(anywhere, "ev", "left")
    mapped = told.withColumn("source_id", F.when(ok, F.coalesce("_s", "_a"))).withColumn(
        "state", F.when(~ok, "unresolved").when(F.col("source_id").isNull(), "unmapped").otherwise("mapped")
    )
    return cases.select("case_id").join(
        mapped.groupBy("case_id").agg(
            F.array_sort(F.collect_set("source_id")).alias("gold"),
            F.count_if(F.col("state") == "unmapped").alias("unmapped"),
            F.count_if(F.col("state") == "unresolved").alias("unresolved"),
        ),
        "case_id", "left",
    )


def map_ranking(rankings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Candidate ids of a ranking as source ids, order kept, first mention kept.

    ``rankings``: case_id, rank, candidate_id. ``mapping``: candidate_id, source_id.
    Ids without a mapping pass through.
    """
    j = rankings.join(mapping, "candidate_id", "left").withColumn("source_id", F.coalesce("source_id", "candidate_id"))
    one = j.groupBy("case_id", "source_id").agg(F.min("rank").alias("rank"))
    return one.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "source_id"))), lambda s: s["source_id"]).alias("ranked")
    )


def _first_rank(ranked: Column, gold: Column) -> Column:
    """1-based rank of the first gold id."""
    places = F.filter(F.transform(gold, lambda g: F.array_position(ranked, g)), lambda p: p > 0)
    return F.array_min(places)


def score_cases(cases: DataFrame, hit_at: int, depth: int) -> DataFrame:
    """A25 per case. ``cases``: case_id, category, ranked, gold (arrays)."""
    observed = max(0, min(hit_at, depth))
    rank = _first_rank(F.col("ranked"), F.col("gold"))
    at = lambda k: F.coalesce(F.col("relevant_rank") <= k, F.lit(False)).cast("double")
    return cases.withColumn("relevant_rank", rank).select(
        "case_id", F.when(F.coalesce("category", F.lit("")) == "", "__unlabelled__").otherwise(F.col("category")).alias("category"),
        "relevant_rank", F.size("gold").alias("gold_count"),
        at(1).alias("hit_at_1"), at(5).alias("hit_at_5"), at(observed).alias("hit_at_k"),
        F.when(F.col("relevant_rank") <= depth, 1.0 / F.col("relevant_rank")).otherwise(0.0).alias("mrr"),
        F.lit(observed).alias("observed_k"),
    )


def category_metrics(scored: DataFrame, hit_at: int, depth: int) -> DataFrame:
    """A25 per category; a metric deeper than the ranking is null, never a number."""
    na = lambda k, c: F.round(F.avg(c), 6) if k <= depth else F.lit(None).cast("double")
    observed = max(0, min(hit_at, depth))
    in_depth = F.when(F.col("relevant_rank") <= observed, F.col("relevant_rank").cast("double"))
    return scored.groupBy("category").agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("gold_count") > 0).alias("questions_with_evidence"),
        na(1, "hit_at_1").alias("hit_at_1"),
        na(5, "hit_at_5").alias("hit_at_5"),
        (F.round(F.avg("hit_at_k"), 6) if observed > 0 else F.lit(None).cast("double")).alias("hit_at_k"),
        F.lit("ok" if 0 < hit_at <= depth else "not_applicable").alias("hit_at_k_status"),
        F.round(F.avg("mrr"), 6).alias("mrr"),
        F.round(F.coalesce(F.avg(in_depth), F.lit(0.0)), 6).alias("mean_relevant_rank"),
    )


def coverage_audit(cases: DataFrame) -> DataFrame:
    """A26. ``cases``: trace_id, status, ranked, selected, candidates, injected, gold."""
    surfaces = F.array_union(F.array_union("ranked", "selected"), F.col("injected"))
    no_trace = F.coalesce("trace_id", F.lit("")) == ""
    bad = ~F.coalesce("status", F.lit("")).isin("", "ok")
    return cases.agg(
        F.count("*").alias("questions_total"),
        F.countDistinct(F.when(~no_trace, F.col("trace_id"))).alias("traces"),
        F.sum(F.size("candidates")).alias("candidates"),
        F.sum(F.size("selected")).alias("selected"),
        F.sum(F.size("injected")).alias("injection_outcomes"),
        F.sum(F.size("gold")).alias("gold_evidence"),
        F.sum(F.size(F.array_intersect("gold", surfaces))).alias("gold_evidence_retrieved"),
        F.count_if(no_trace | bad).alias("bypasses"),
    )


def query_failure(q: DataFrame) -> DataFrame:
    """One label per query, first rule that holds.

    Columns: raw_error, expected_status, archived_returned, expect_empty,
    returned, must_recall, must_not_recall (arrays), rank_max.
    """
    rank = _first_rank(F.col("returned"), F.col("must_recall"))
    wanted = F.size("must_recall") > 0
    label = (
        F.when(F.coalesce("raw_error", F.lit("")) != "", "PIPELINE_ERROR")
        .when((F.col("expected_status") == "active") & (F.size("archived_returned") > 0), "ARCHIVED_MEMORY_RETURNED")
        .when(F.col("expect_empty"), F.when(F.size("returned") > 0, "WRONG_MEMORY").otherwise("PASS"))
        .when(wanted & rank.isNull(), "NOT_RETRIEVED")
        .when(wanted & (rank > F.col("rank_max")), "RANKED_TOO_LOW")
        .when(F.arrays_overlap("must_not_recall", "returned"), "WRONG_MEMORY")
        .otherwise("PASS")
    )
    return q.withColumn("best_rank", rank).withColumn("label", label)


def scenario_metrics(scenarios: DataFrame, queries: DataFrame) -> DataFrame:
    """A27 headline row. ``scenarios``: status, unsupported. ``queries``: best_rank,
    must_recall, must_not_recall, violations, elapsed_ms, raw_error, archived_returned.
    """
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    s = scenarios.agg(
        F.count("*").alias("scenario_count"),
        F.count_if("unsupported").alias("unsupported_count"),
        F.count_if(F.col("status") == "PASS").alias("pass_count"),
        F.count_if(F.col("status") == "FAIL").alias("fail_count"),
        F.count_if(F.col("status") == "ERROR").alias("error_count"),
    ).withColumn("pass_rate", rate(F.col("pass_count"), F.col("scenario_count") - F.col("unsupported_count")))
    wanted = F.size("must_recall") > 0
    guarded = F.size("must_not_recall") > 0
    hit = lambda k: F.count_if(wanted & (F.col("best_rank") <= k))
    q = queries.agg(
        F.count_if(wanted).alias("_want"), F.count_if(guarded).alias("_guard"),
        F.count_if(wanted & F.col("best_rank").isNotNull()).alias("_hit"),
        F.count_if(guarded & (F.col("violations") > 0)).alias("_viol"),
        F.sum("violations").alias("false_positives"),
        hit(1).alias("_h1"), hit(3).alias("_h3"), hit(5).alias("_h5"),
        F.avg(F.when(wanted, 1.0 / F.col("best_rank"))).alias("_mrr"),
        F.round(F.percentile("elapsed_ms", F.lit(0.5)), 6).alias("median_latency_ms"),
        F.round(F.percentile("elapsed_ms", F.lit(0.95)), 6).alias("p95_latency_ms"),
    ).select(
        rate(F.col("_hit"), F.col("_want")).alias("must_recall_hit_rate"),
        rate(F.col("_viol"), F.col("_guard")).alias("must_not_recall_violation_rate"),
        rate(F.col("_h1"), F.col("_want")).alias("hit_at_1"), rate(F.col("_h3"), F.col("_want")).alias("hit_at_3"),
        rate(F.col("_h5"), F.col("_want")).alias("hit_at_5"), F.round(F.coalesce("_mrr", F.lit(0.0)), 6).alias("mrr"),
        "false_positives", (F.col("_want") - F.col("_hit")).alias("misses"), "median_latency_ms", "p95_latency_ms",
    )
    return side_by_side(s, q)


def pass_rate_by(scenarios: DataFrame, label: str) -> DataFrame:
    """A27 per category: supported scenarios and their pass rate."""
    return scenarios.filter(~F.col("unsupported")).groupBy(label).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("status") == "PASS").cast("double")), 6).alias("pass_rate")
    )


def status_rank(status: Column) -> Column:
    table = F.create_map(*[x for k, v in STATUS_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[status], F.lit(0))


def run_flips(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Scenario by scenario, what changed between two runs.

    Both: case_id, category, status, label.
    """
    b = base.select("case_id", F.col("category").alias("b_category"), F.col("status").alias("b_status"), F.col("label").alias("b_label"))
    c = cand.select("case_id", F.col("category").alias("c_category"), F.col("status").alias("c_status"), F.col("label").alias("c_label"))
    j = b.join(c, "case_id", "full_outer")
    miss = lambda s, l: (F.col(s) == "FAIL") & F.col(l).isin(*RECALL_FAILURES)
    bm, cm = F.coalesce(miss("b_status", "b_label"), F.lit(False)), F.coalesce(miss("c_status", "c_label"), F.lit(False))
    up = status_rank(F.col("c_status")) - status_rank(F.col("b_status"))
    both = F.col("b_status").isNotNull() & F.col("c_status").isNotNull()
    same = F.col("b_status").eqNullSafe(F.col("c_status")) & F.col("b_label").eqNullSafe(F.col("c_label"))
    return j.select(
        "case_id", F.coalesce("b_category", "c_category").alias("category"),
        F.when(F.col("c_status").isNull(), "only_base").when(F.col("b_status").isNull(), "only_candidate")
        .when(same, "unchanged").otherwise("changed").alias("presence"),
        F.when(~both, None).when(up > 0, "improved").when(up < 0, "regressed").otherwise("unchanged").alias("direction"),
        (both & cm & ~bm).alias("new_miss"), (both & bm & ~cm).alias("fixed_miss"),
        "b_status", "c_status",
    )


def category_delta(base: DataFrame, cand: DataFrame) -> DataFrame:
    b = base.select(F.col("category"), F.col("pass_rate").alias("base_rate"))
    c = cand.select(F.col("category"), F.col("pass_rate").alias("cand_rate"))
    return b.join(c, "category", "full_outer").select(
        "category", F.coalesce("base_rate", F.lit(0.0)).alias("base_rate"), F.coalesce("cand_rate", F.lit(0.0)).alias("cand_rate")
    ).withColumn("delta", F.round(F.col("cand_rate") - F.col("base_rate"), 6))


def verdict(flips: DataFrame) -> DataFrame:
    """Improved, regressed, mixed or unchanged; the headline needs more than one point."""
    passed = lambda c: F.avg(F.when(F.col("direction").isNotNull(), (F.col(c) == "PASS").cast("double")))
    t = flips.agg(
        F.count_if(F.col("direction") == "improved").alias("improved"),
        F.count_if(F.col("direction") == "regressed").alias("regressed"),
        F.count_if("new_miss").alias("new_misses"), F.count_if("fixed_miss").alias("fixed_misses"),
        (passed("c_status") - passed("b_status")).alias("_d"),
    )
    v = (
        F.when((F.col("_d") > 0.01) & (F.col("improved") >= F.col("regressed")), "improved")
        .when((F.col("_d") < -0.01) & (F.col("regressed") > F.col("improved")), "regressed")
        .when(F.col("improved") != F.col("regressed"), "mixed")
        .otherwise("unchanged")
    )
    return t.withColumn("verdict", v).withColumn("pass_rate_delta", F.round("_d", 6)).drop("_d")


def repeatability(run_a: DataFrame, run_b: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric the largest and mean absolute difference over shared cases."""
    a = run_a.select("case_id", *[F.col(m).alias(f"a_{m}") for m in metrics])
    b = run_b.select("case_id", *[F.col(m).alias(f"b_{m}") for m in metrics])
    j = a.join(b, "case_id", "full_outer")
    cols = []
    for m in metrics:
        d = F.abs(F.col(f"a_{m}") - F.col(f"b_{m}"))
        cols += [F.round(F.max(d), 6).alias(f"{m}_max"), F.round(F.avg(d), 6).alias(f"{m}_mean")]
    shared = F.col(f"a_{metrics[0]}").isNotNull() & F.col(f"b_{metrics[0]}").isNotNull()
    return j.agg(F.count("*").alias("cases"), F.count_if(shared).alias("shared"), *cols)
