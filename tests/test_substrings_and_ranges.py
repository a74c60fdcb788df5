"""Substring matches by automaton and by join, and ranges over crowded numbers, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import lexical, lineage


@pytest.mark.parametrize("joined", [False, True])
def test_matches_by_automaton_and_by_join(spark, monkeypatch, joined):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abAB数据ß", k=rng.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12))), rng.choice([None, "", word(), "a, b"])) for i in range(60)]
    terms = sorted({rng.choice([word(), word() + " " + word(), word()[:1], word()[:2]]) for _ in range(80)} | {"", "  ", ",", "a, b", "%", "_"})
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    if joined:
        monkeypatch.setattr(lexical, "TERM_BYTES", 0)
    else:
        monkeypatch.setattr(lexical, "MOST_SHORT_TERMS", 3)
    texts = [F.col("title"), F.col("body")]
    for fold in (True, False):
        low = (lambda x: x.lower()) if fold else (lambda x: x)
        want = {(low(t), i) for t in terms if t.strip() for i, *parts in rows if any(low(t) in low(x) for x in parts if x)}
        got = lexical.term_matches(asked, docs, "id", texts, fold).collect()
        assert {(r["term"], r["id"]) for r in got} == want and len(got) == len(want)
    words = asked.filter(~F.col("term").rlike("[ ,%_]")).filter("term <> ''")
    plain = [t.lower() for t in terms if t and not set(t) & set(" ,%_")]
    want = {(t, i, t in title.lower()) for t in plain for i, title, body in rows if t in title.lower() or t in (body or "").lower()}
    assert {tuple(r) for r in lexical.term_matches_by_part(words, docs, "id", texts, 1).collect()} == want


def test_no_terms_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    none = spark.createDataFrame([], "term string")
    assert lexical.term_matches(none, docs, "id", [F.col("text")]).count() == 0
    assert lexical.term_matches(spark.createDataFrame([("a",)], "term string"), docs.limit(0), "id", [F.col("text")]).count() == 0


def test_ranges_over_crowded_numbers(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SALT_POINTS", 16)
    rng = random.Random(4)
    points = [(rng.choice([7, 7, 7, rng.randint(0, 500), 2**60 + rng.randint(0, 3), None]), i) for i in range(400)]
    ranges = [(i, lo, lo + rng.choice([0, 1, 5, 80, 2**61])) for i in range(40) for lo in [rng.randint(-5, 500)]] + [(99, None, 5), (98, 5, None)]
    p = spark.createDataFrame(points, "p long, pid int")
    r = spark.createDataFrame(ranges, "n int, lo long, hi long")
    for closed in (False, True):
        want = sorted((n, i) for n, lo, hi in ranges for x, i in points if None not in (x, lo, hi) and lo <= x and (x <= hi if closed else x < hi))
        got = lineage.contained_in_ranges(p, r, "p", "lo", "hi", closed_hi=closed, bucket=8)
        assert got.columns == ["p", "pid", "n", "lo", "hi"] and sorted((x["n"], x["pid"]) for x in got.collect()) == want
