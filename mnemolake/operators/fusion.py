"""Rank fusion, decay, promotions, reranking, the selection trace and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake import rules as R
from mnemolake.functions import vec as V

HIT = ["query_id", "kind", "source_id"]


def ranked_paths(hits: DataFrame) -> DataFrame:
    """Rank of each hit inside its (query, path): raw score, then kind and id."""
    order = W.partitionBy("query_id", "path").orderBy(F.desc("raw_score"), "kind", "source_id")
    return hits.withColumn("raw_rank", F.row_number().over(order))


def path_weight(path: Column) -> Column:
    table = F.create_map(*[x for k, v in R.PATH_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return table[path]


def lane_of(kind: Column) -> Column:
    """F13."""
    table = F.create_map(*[x for k, v in R.LANE_OF_KIND.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[kind], F.lit("vector"))


def fuse(ranked: DataFrame, k: int = R.RRF_K, path_k: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion; the best cosine of a candidate is kept. Ranks behind ``path_k`` add nothing and are no vote."""
    part = path_weight(F.col("path")) / (F.lit(float(k)) + F.col("raw_rank"))
    inside = F.lit(True) if path_k is None else F.col("raw_rank") <= path_k
    part = part if path_k is None else F.when(inside, part).otherwise(0.0)
    return ranked.withColumn("contribution", part).groupBy(*HIT).agg(
        V.rounded(F.sum("contribution")).alias("rrf"),
        F.max("cosine").alias("cosine"),
        F.max("created_at").alias("created_at"),
        F.count_if(inside).alias("votes"),
    )


def fuse_best(hits: DataFrame, path_k: int, k: int = R.RRF_K) -> DataFrame:
    """``fuse`` of unranked hits whose ranks behind ``path_k`` add nothing: only the best of a path are ranked and kept through a sort."""
    best = fuse(ranked_paths(hits).filter(F.col("raw_rank") <= path_k), k, path_k).select(*HIT, "rrf", "votes")
    every = hits.groupBy(*HIT).agg(F.max("cosine").alias("cosine"), F.max("created_at").alias("created_at"))
    # at most path_k rows a query and path
    return every.join(best, HIT, "left").select(*HIT, F.coalesce("rrf", F.lit(0.0)).alias("rrf"), "cosine", "created_at", F.coalesce("votes", F.lit(0)).cast("long").alias("votes"))


def decayed(fused: DataFrame, as_of: Column, days: float = R.DECAY_DAYS) -> DataFrame:
    """age decay by whole days; question/answer hits and undated hits keep their score."""
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("created_at")) / 86400)
    factor = V.time_decay(age, days, R.DECAY_FLOOR)
    exempt = (F.col("kind") == "qa") | F.col("created_at").isNull()
    return fused.withColumn(
        "score", F.when(exempt, F.col("rrf")).otherwise(V.rounded(F.col("rrf") * factor))
    )


def rare_bonus(scored: DataFrame, rare: DataFrame) -> DataFrame:
    """question/answer hits reached through a rare term gain at most 0.08."""
    flagged = rare.select("query_id", "source_id").distinct().withColumn("_rare", F.lit(1))
    j = scored.join(flagged, ["query_id", "source_id"], "left")
    gain = F.when((F.col("kind") == "qa") & (F.col("_rare") == 1), R.RARE_BONUS).otherwise(0.0)
    return j.withColumn("score", V.rounded(F.col("score") + gain)).drop("_rare")


def promote_exact(scored: DataFrame, signals: DataFrame) -> DataFrame:
    """The best two exact question/answer hits and the best delivery gain 0.5.

    ``signals``: (query_id, source_id, min_freq, low_freq_terms). Exact means a
    very rare term (<= 3) or two low-frequency terms together.
    """
    s = signals.filter((F.col("min_freq") <= 3) | (F.col("low_freq_terms") >= 2)).select("query_id", "source_id")
    eligible = scored.filter(F.col("kind").isin("qa", "assistant_delivery")).join(s, ["query_id", "source_id"], "left_semi")
    order = W.partitionBy("query_id", "kind").orderBy(F.desc("score"), "source_id")
    top = (
        eligible.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 2)
        .filter((F.col("kind") == "qa") | (F.col("_rn") == 1))
        .select(*HIT, F.lit(1).alias("_boost"))
    )
    j = scored.join(top, HIT, "left")
    return j.withColumn(
        "score", V.rounded(F.col("score") + F.when(F.col("_boost") == 1, R.EXACT_BOOST).otherwise(0.0))
    ).withColumn("boosted", F.coalesce("_boost", F.lit(0))).drop("_boost")


def rerank(scored: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` of a query take the scores given for them and are re-sorted,
    the tail follows. All or nothing: a query whose window is not fully scored
    keeps its fusion order.

    ``scores``: (query_id, source_id, rerank_score). Adds ``position``.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "kind", "source_id")
    window = scored.withColumn("fused_rank", F.row_number().over(order))
    head = window.filter(F.col("fused_rank") <= top_n).join(scores, ["query_id", "source_id"], "left")
    complete = head.groupBy("query_id").agg(
        (F.count("*") == F.count("rerank_score")).alias("_full")
    )
    joined = window.join(
        head.select(*HIT, "rerank_score"), HIT, "left"
    ).join(complete, "query_id", "left")
    new = F.when(F.col("_full") & (F.col("fused_rank") <= top_n), F.col("rerank_score"))
    final = W.partitionBy("query_id").orderBy(
        F.when(new.isNotNull(), 0).otherwise(1), F.desc(F.coalesce(new, F.lit(0.0))), "fused_rank"
    )
    return joined.withColumn("position", F.row_number().over(final)).withColumn(
        "final_score", F.coalesce(new, F.col("score"))
    ).drop("_full", "rerank_score")


def select_hits(scored: DataFrame, limit: int) -> DataFrame:
    """Final order; every row stays, the ones beyond the limit carry the reason."""
    if "position" in scored.columns:
        ranked = scored
    else:
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "kind", "source_id")
        ranked = scored.withColumn("position", F.row_number().over(order))
    return ranked.withColumns({
        "selected": F.col("position") <= limit,
        "drop_reason": F.when(F.col("position") > limit, "OUTSIDE_LIMIT"),
    })


def lane_accounting(ranked: DataFrame) -> DataFrame:
    """Candidates and votes per (query, lane)."""
    return ranked.withColumn("lane", lane_of(F.col("kind"))).groupBy("query_id", "lane").agg(
        F.countDistinct("kind", "source_id").alias("candidates"), F.count("*").alias("votes")
    )


def should_expand(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ask for detail when the query says so, the best match is weak, or two are close."""
    top = ranked.filter(F.col("position") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("position") == 1, F.col("cosine"))).alias("_first"),
        F.max(F.when(F.col("position") == 2, F.col("cosine"))).alias("_second"),
    )
    text = F.lower(F.coalesce("text", F.lit("")))
    said = F.lit(False)
    for w in R.DETAIL_TRIGGERS:
        said = said | text.contains(w)
    weak = F.coalesce(F.col("_first") < 0.6, F.lit(False))
    close = F.coalesce(F.abs(F.col("_first") - F.col("_second")) < 0.05, F.lit(False))
    return queries.join(top, "query_id", "left").withColumn(
        "expand", (text != "") & (said | weak | close)
    ).select("query_id", "expand")


def unit_text(source_id: Column, title: Column, category: Column, score: Column, body: Column) -> Column:
    """A header line and the whole body."""
    head = F.format_string("- %s | %s [%s] (score=%.3f)", source_id, title, category, score)
    full = F.coalesce(body, F.lit(""))
    return F.when(full != "", F.concat(head, F.lit("\n  "), full)).otherwise(head)


def pack_context(units: DataFrame, max_chars: int, preamble_chars: int = 0) -> DataFrame:
    """Take whole units in rank order while they fit, skip the ones that do not.

    ``units``: (query_id, rank, source_id, n_chars). A unit costs its text, the
    newline before it and an empty line after it. Units per query are bounded by
    the retrieval limit, so the fold runs over a short array.
    """
    ordered = units.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source_id", "n_chars"))).alias("_u")
    )
    init = F.struct(
        F.lit(preamble_chars).cast("long").alias("used"),
        F.array().cast("array<struct<rank:int,source_id:string,n_chars:bigint,kept:boolean>>").alias("log"),
    )

    def step(acc: Column, u: Column) -> Column:
        after = acc["used"] + u["n_chars"] + 2
        fits = after <= max_chars
        return F.struct(
            F.when(fits, after).otherwise(acc["used"]).alias("used"),
            F.array_append(
                acc["log"],
                F.struct(
                    u["rank"].cast("int").alias("rank"), u["source_id"].alias("source_id"),
                    u["n_chars"].cast("long").alias("n_chars"), fits.alias("kept"),
                ),
            ).alias("log"),
        )

    return ordered.select("query_id", F.explode(F.aggregate("_u", init, step)["log"]).alias("r")).select(
        "query_id", "r.rank", "r.source_id", "r.n_chars",
        F.when(F.col("r.kept"), "injected").otherwise("CHAR_BUDGET").alias("outcome"),
    )


def fill_with_keyword(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int) -> DataFrame:
    """Vector hits first, keyword hits (score 1.0) take the places left."""
    v = vector_hits.select("query_id", "id", "score", F.lit("vector").alias("matched_by"), F.lit(0).alias("_p"))
    k = keyword_hits.select("query_id", "id", F.lit(1.0).alias("score"), F.lit("keyword").alias("matched_by"), F.lit(1).alias("_p"))
    order = W.partitionBy("query_id").orderBy("_p", F.desc("score"), "id")
    return v.unionByName(k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("_p")
