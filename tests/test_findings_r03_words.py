"""Findings of the third review on words and terms: what is counted in the task that reads a row is never shuffled."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import lexical


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [1024, 2])
def test_words_of_an_item_are_counted_where_it_is_read(spark, monkeypatch, rows):
    """no shuffle of words, ties by text, stop words in any case left out; an id on two rows is one item."""
    monkeypatch.setattr(lexical, "KEYWORD_ROWS", rows)
    texts = ["beta alpha beta The THE the gamma", None, "", "zed_1 zed_1 abc ABC abd", "数据湖数据", "one two three four"]
    df = spark.createDataFrame([(i, "ttl", x) for i, x in enumerate(texts)], "id long, title string, content string").coalesce(2)
    got = lexical.keywords(df, "id", F.col("title"), F.col("content"), 3)
    assert "Exchange" not in _plan(got)

    def want(words):
        return sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:3]

    found = {}
    for r in got.orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["keyword"], r["n"]))
    assert found == {
        0: want(["ttl", "beta", "alpha", "beta", "gamma"]), 1: want(["ttl"]), 2: want(["ttl"]), 3: want(["ttl", "zed_1", "zed_1", "abc", "ABC", "abd"]),
        4: want(["ttl", "数据", "据湖", "湖数", "数据"]), 5: want(["ttl", "one", "two", "three", "four"]),
    }
    twice = lexical.keywords(df.withColumn("id", F.when(F.col("id") > 2, 7).otherwise(F.col("id"))), "id", F.col("title"), F.col("content"), 3)
    seven = [(r["keyword"], r["n"], r["rank"]) for r in twice.filter("id = 7").orderBy("rank").collect()]
    assert seven == [("ttl", 3, 1), ("zed_1", 2, 2), ("数据", 2, 3)] and twice.filter("id = 0").count() == 3


def _texts(spark):
    texts = ["Alpha beta an", "alphabet beta beta xy", None, "", "xy only", "gamma alpha an an", "betagamma", "nothing here"]
    docs = spark.createDataFrame([(i, x, i % 3 or None) for i, x in enumerate(texts)], "id long, content string, created_at long")
    terms = spark.createDataFrame([(1, "alpha"), (1, "an"), (1, "beta"), (2, "xy"), (2, "gamma"), (2, "absent"), (3, "an")], "query_id long, term string")
    return docs.coalesce(2), terms


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture(params=[512, 2])
def both(request, monkeypatch):
    """Runs a query in the scanning tasks and by joins."""
    monkeypatch.setattr(lexical, "SCAN_ROWS", request.param)

    def run(query):
        scanned = query()
        found = _rows(scanned)
        with monkeypatch.context() as m:
            m.setattr(lexical, "_asked", lambda *_: None)
            joined = _rows(query())
        return scanned, found, joined

    return run


def test_scores_of_texts_are_counted_where_their_terms_are(spark, both):
    """pairs of query and text are no rows of a shuffle."""
    docs, terms = _texts(spark)
    plan, got, want = both(lambda: lexical.text_scores(terms, docs, "id", [F.col("content")])[0])
    assert got == want and len(got) > 5 and "Exchange" not in _plan(plan)
    twice = docs.unionByName(docs.filter("id = 1"))
    _, got, want = both(lambda: lexical.text_scores(terms, twice, "id", [F.col("content")])[0])
    assert got == want


def test_deliveries_leave_a_task_only_when_they_can_be_candidates(spark, both):
    """the pairs of a part that are behind its first ones by count, time and id are not sent."""
    docs, terms = _texts(spark)
    plan, got, want = both(lambda: lexical.delivery_candidates(terms, docs, 2))
    assert got == want and len(got) == 4 and "HashAggregate" not in _plan(plan)


def test_topics_are_scored_where_they_are_read(spark, both):
    """no shuffle of pairs of query and topic; keywords make a topic a hit, but do not count."""
    docs, terms = _texts(spark)
    topics = docs.select("id", F.substring("content", 1, 4).alias("title"), F.substring("content", 1, 8).alias("summary"), F.col("content").alias("body"), F.array(F.lit("absent")).alias("keywords"), F.when(F.col("id") == 5, "archived").otherwise("active").alias("status"))
    plan, got, want = both(lambda: lexical.topic_scores(terms, topics))
    assert got == want and "Exchange" not in _plan(plan)


def test_a_task_searches_few_texts_at_once(spark, monkeypatch):
    """a batch of texts is searched and returned in parts."""
    monkeypatch.setattr(lexical, "SCAN_ROWS", 3)
    docs, _ = _texts(spark)
    found = lexical.term_matches(spark.createDataFrame([("alpha",), ("an",)], "term string"), docs, "id", [F.col("content")])
    assert _rows(found) == sorted([(0, "alpha"), (0, "an"), (1, "alpha"), (5, "alpha"), (5, "an")], key=str)


def test_only_the_best_of_a_path_are_ranked(spark):
    """rows behind ``path_k`` stay candidates without being sorted."""
    from mnemolake.operators import fusion

    hits = spark.range(300).select(
        (F.col("id") % 2).alias("query_id"), F.lit("qa").alias("kind"), (F.col("id") % 37).cast("string").alias("source_id"), F.element_at(F.array(F.lit("keyword"), F.lit("qa_vector")), (F.col("id") % 5 % 2 + 1).cast("int")).alias("path"),
        (F.col("id") * 7 % 101 / 101.0).alias("raw_score"), (F.col("id") % 3 / 3.0).alias("cosine"), F.col("id").alias("created_at"),
    ).dropDuplicates(["query_id", "source_id", "path"])
    want = fusion.fuse(fusion.ranked_paths(hits), path_k=4)
    got = fusion.fuse_best(hits, 4)
    assert _rows(got) == _rows(want) and got.schema["votes"].dataType == want.schema["votes"].dataType and "WindowGroupLimit" in _plan(got)
