"""Importance resampling against a plain version, its hashes and its table."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from mnemolake.llm import importance as im
from mnemolake.llm import queries

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words long, weight string, `_range` int"


def features(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)
    return [" ".join(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)], len(w)


def plain(docs, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw, aim = [0] * 10000, [0] * 10000
    for counts, texts in ((raw, docs), (aim, target)):
        for _, text in texts:
            for f in features(text)[0]:
                counts[bucket(f)] += 1
    s_all, t_all = sum(raw), sum(aim)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(raw, aim)]
    out = []
    for doc, text in docs:
        fs, n = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append((doc, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], -r[3]))
    take = percent * len(able) // 100
    rest = [(*r, None) for r in out if r[1] < 20] + [(*r, None) for r in able[take:]]
    return sorted([(*r, i + 1) for i, r in enumerate(able[:take])] + rest, key=str)


def found(spark, docs, target, **options):
    frame = lambda rows: spark.createDataFrame([(*r, -1, "clash", 3) for r in rows], DOCS)
    got = im.resample(frame(docs), frame(target), **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "The", "über", "ß", "数据", "x1", "long" * 12, "wörter" * 9] + [f"w{i}" for i in range(60)]
    return [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(n)]


def test_equal_to_the_plain_rule(spark):
    docs = made(300) + [(3, "w1 w2 " * 15), (3, "w1 w2 " * 15), (4, "w3 " * 30), (None, "w4 " * 25), (None, None), (900, None), (901, ""), (902, " .\n"), (903, "w1"), (904, "w1 w2")]
    docs += [(1000 + i, "the same passage of words in many documents " * 4) for i in range(150)]
    assert found(spark, docs, made(40, 2), percent=30) == plain(docs, made(40, 2), 30)


def test_long_texts_in_stretches(spark, monkeypatch):
    docs = [(1, "x" * 300_000), (2, " ".join(f"w{i % 701}" for i in range(40_000))), *made(30)]
    want = plain(docs, made(5, 2))
    assert found(spark, docs, made(5, 2)) == want
    monkeypatch.setattr(im, "SLAB_WORDS", 7)
    monkeypatch.setattr(im, "FEW", 2)
    assert found(spark, docs[2:], made(5, 2)) == plain(docs[2:], made(5, 2))


def test_empty_tables(spark):
    docs = made(30)
    assert found(spark, docs, []) == plain(docs, [])
    assert found(spark, [], docs) == []


def test_query_on_the_small_tables(spark):
    read = lambda name, i: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(i, "text").collect()]
    got = queries.queries()["op13_importance_resampling"](spark, SMALL)
    want = plain(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((d, f, w, s, r) for d, _, f, w, s, r in want), key=str)


def test_hashes_are_those_of_the_library():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    starts, sizes = rng.integers(0, 4900, 4000), rng.integers(0, 80, 4000)
    want = [xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(starts, sizes)]
    assert im.xxhash64(data + bytes(8), starts, sizes).tolist() == want


@pytest.mark.parametrize("hashes", ["own", "all equal", "few"])
def test_table_tells_equal_hashes_apart(monkeypatch, hashes):
    """Slots hold equal bytes only, whatever the hashes say."""
    if hashes != "own":
        monkeypatch.setattr(im, "xxhash64", lambda data, starts, sizes: (starts * 0 if hashes == "all equal" else sizes % 2).astype(np.uint64) << np.uint64(60))
    rng = random.Random(8)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(300)]
    data = b"".join(words) + bytes(8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    t = im.NgramTable(data, starts, sizes)
    slots = {}
    for w, s in zip(words, t.slot_of.tolist()):
        assert slots.setdefault(w, s) == s
    assert len(set(slots.values())) == len(slots)
    for w, s in slots.items():
        assert t.counts[s] == words.count(w) and t.buckets[s] == zlib.crc32(w) % 10000
    assert t.totals().sum() == 300
