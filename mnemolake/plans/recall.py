"""Batch recall: many queries against the stores at once, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemolake.functions import vec as V
from mnemolake.operators import fusion, lexical, lineage, vectors
from mnemolake.session import cut


def layered_chain(
    queries: DataFrame, topics: DataFrame, entries: DataFrame, premises: DataFrame,
    anchor_floor: float = 0.5, cards: int = 3, traces: int = 3, dims: int = 64,
) -> DataFrame:
    """Query -> nearest topics -> entries by each topic's own vector.

    A query whose best topic is under the floor is marked ``fallback`` and goes
    to the fused path instead. Topics named as premises stand before vector hits.
    ``premises``: (query_id, topic_id).
    """
    near = cut(vectors.top_k_cosine(queries, topics, cards, -1.0, dims=dims).select("query_id", "id", "cosine"))
    anchor = near.groupBy("query_id").agg(F.max("cosine").alias("_a"))
    named = (
        premises.select("query_id", F.col("topic_id").alias("id")).distinct()
        .join(queries.select("query_id", F.col("vec").alias("_qv")), "query_id").join(topics.select("id", "vec"), "id")
        .select("query_id", "id", F.round(V.cosine(F.col("_qv"), F.col("vec")), 6).alias("cosine"), F.lit(0).alias("_p"))
    )
    both = near.withColumn("_p", F.lit(1)).unionByName(named).groupBy("query_id", "id").agg(
        F.min("_p").alias("_p"), F.max("cosine").alias("cosine")
    )
    order = W.partitionBy("query_id").orderBy("_p", F.desc("cosine"), "id")
    chosen = (
        both.withColumn("card_rank", F.row_number().over(order)).filter(F.col("card_rank") <= cards)
        .select("query_id", F.col("id").alias("topic"), "card_rank")
    )
    used = topics.join(chosen.select(F.col("topic").alias("id")).distinct(), "id", "left_semi")
    traced = vectors.top_k_cosine(used.select(F.col("id").alias("query_id"), "vec"), entries, traces, -1.0, dims=dims).select(
        F.col("query_id").alias("topic"), F.col("id").alias("entry_id"), F.col("rank").alias("trace_rank")
    )
    q = queries.select("query_id").join(anchor, "query_id", "left").withColumn(
        "kind", F.when(F.col("_a") >= anchor_floor, "chain").otherwise("fallback")
    ).drop("_a")
    ok = chosen.join(q.filter("kind = 'chain'").select("query_id"), "query_id", "left_semi")
    return q.join(ok, "query_id", "left").join(traced, "topic", "left")


def recall(
    queries: DataFrame, items: DataFrame, ledger: DataFrame, as_of: Column, limit: int = 10, top_n: int = 20,
    rerank_scores: DataFrame | None = None, floor: float = 0.30, path_k: int = 50, dims: int = 64,
) -> DataFrame:
    """The whole retrieval: lexical and vector lanes, suppression, fusion, decay,
    promotions, reranking, selection. Returns every candidate with its trace.

    ``queries``: query_id, text, vec. ``items``: id, kind (qa, topic, note), text,
    vec, created_at. Suppressed items take no place in a lane. The best ``path_k`` rows
    per query and lane count in the fusion; rows behind them stay candidates for the promotions,
    and what no lane counts and nothing promotes ends as ``OUTSIDE_LANE`` without a position.
    Only vector rows under ``floor`` are no candidates.
    """
    named_items = items.withColumn("source_id", F.concat_ws("_", "kind", F.col("id").cast("string")))
    valid = lineage.suppress(named_items, ledger)
    qa = items.filter(F.col("kind") == "qa")
    terms = cut(lexical.query_terms(queries))
    signals, freq, matches = lexical.text_scores(terms, qa, "id", [F.col("text")])
    signals = cut(signals)
    lex = signals.select("query_id", "id", F.col("score").alias("raw_score"), F.lit(0.0).alias("cosine"))
    lanes = [lex.withColumn("path", F.lit("keyword")), lex.withColumn("path", F.lit("qa_keyword"))]
    for kind, path in (("qa", "qa_vector"), ("topic", "topic_vector"), ("note", "note_vector")):
        hits = vectors.top_k_cosine(queries, valid.filter(F.col("kind") == kind), None, floor, dims=dims)
        lanes.append(hits.select("query_id", "id", F.col("cosine").alias("raw_score"), "cosine", F.lit(path).alias("path")))
    union = lanes[0]
    for lane in lanes[1:]:
        union = union.unionByName(lane)
    hits = cut(union.join(valid.select("id", "kind", "created_at", "source_id"), "id"))
    scored = fusion.decayed(fusion.fuse_best(hits, path_k), as_of)
    named = lambda d: d.withColumn("source_id", F.concat(F.lit("qa_"), F.col("id").cast("string")))
    rare = named(
        terms.join(freq.filter("freq between 1 and 3"), "term").join(matches, "term").select("query_id", "id").distinct()
    )
    scored = fusion.rare_bonus(scored, rare)
    scored = cut(fusion.promote_exact(scored, named(signals)))
    # a vote or a promotion; without either the score is 0
    counted = (F.col("votes") > 0) | (F.col("score") > 0)
    outside = scored.filter(~counted).withColumns({"selected": F.lit(False), "drop_reason": F.lit("OUTSIDE_LANE")})
    scored = scored.filter(counted)
    if rerank_scores is not None:
        scored = fusion.rerank(scored, rerank_scores, top_n)
    return fusion.select_hits(scored, limit).unionByName(outside, allowMissingColumns=True)
