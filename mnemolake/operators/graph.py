"""Topic graphs: two-hop co-occurrence and weighted neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _distinct_topics(hop: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    own = seeds.select("query_id", F.col("topic").alias("related"))
    found = hop.select("query_id", "related").distinct().join(own, ["query_id", "related"], "left_anti")
    order = W.partitionBy("query_id").orderBy("related")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def related_topics(seeds: DataFrame, mentions: DataFrame, observed: DataFrame, limit: int) -> DataFrame:
    """Topics mentioned by a note that also mentions a seed; when a query has none,
    topics mentioned by a note in which a node observed the seed.

    ``seeds``: (query_id, topic). ``mentions``: (note, topic). ``observed``:
    (note, topic) edges of the fallback kind.

    The report keeps the ``limit`` smallest topics that are not seeds, so of a
    note only its ``limit`` plus (seeds per query) smallest topics can matter.
    Notes are cut to those first, and hops run per distinct seed topic, so a
    note or topic with very many edges never multiplies into its pairs.
    """
    most = seeds.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    keep = limit + most
    smallest = lambda d, key, col: d.withColumn(
        "_rn", F.row_number().over(W.partitionBy(key).orderBy(col))
    ).filter(F.col("_rn") <= keep).drop("_rn")
    heads = smallest(mentions.select("note", F.col("topic").alias("related")).distinct(), "note", "related")

    def hop(asked: DataFrame, edges: DataFrame) -> DataFrame:
        topics = asked.select("topic").distinct()
        near = topics.join(edges, "topic").join(heads, "note").select("topic", "related").distinct()
        return asked.join(smallest(near, "topic", "related"), "topic")

    first = _distinct_topics(hop(seeds, mentions), seeds, limit).withColumn("hop", F.lit("co_mention"))
    rest = seeds.join(first.select("query_id").distinct(), "query_id", "left_anti")
    second = _distinct_topics(hop(rest, observed), rest, limit).withColumn("hop", F.lit("observed_in"))
    return first.unionByName(second)


def weighted_neighbours(topics: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Heaviest ``k`` neighbours of each topic over undirected edges (src, dst, weight)."""
    both = edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    hits = topics.select(F.col("topic").alias("src")).join(both, "src")
    order = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return (
        hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(F.col("src").alias("topic"), F.col("dst").alias("neighbour"), "weight", "rank")
    )
