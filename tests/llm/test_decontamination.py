"""Test-string search against plain search, with odd rows, short items and items in several groups."""

from __future__ import annotations

import random
import re

import pytest

from mnemolake.llm import decontamination as dc

DOCS = "doc_id long, text string, n_words long, spans string, items int"
ITEMS = "item_id long, text string, words string, piece int"


def words(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)


def plain(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                ids = wins.get(tuple(w[a : a + k]))
                if ids:
                    hit |= set(range(a, a + k))
                    found |= ids
        runs = [(a, next(b for b in range(a, len(w) + 1) if b not in hit)) for a in sorted(hit) if a - 1 not in hit]
        out.append((doc, len(w), tuple(runs), tuple(sorted(found))))
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "clash", 2) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "clash", 2) for r in items], ITEMS)
    got = dc.contaminations(d, i, **options)
    assert got.columns == ["doc_id", "n_words", "spans", "items"]
    return sorted(((r[0], r[1], tuple((s["start"], s["end"]) for s in r[2]), tuple(r[3])) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    vocabulary = ["a", "b", "ab", "ba", "über", "ß", "Straße", "ЖЖ", "数据", "x1", "9", "long" * 40] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 9, 10, 11, 25, 60])))) for i in range(40)]
    items = [(i, t) for i, t in items if len(words(t)) > 2] + [(900, "w1 w2"), (901, "ß 数据")]
    items += [(50, items[0][1]), (50, items[0][1]), (None, items[1][1]), (51, None), (52, ""), (53, " .,\x00\n"), (54, items[2][1].upper())]
    docs = []
    for n in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        if rng.random() < 0.6:
            own = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(own) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = own[a : a + rng.randint(5, 30)]
        docs.append((n, rng.choice([" ", "\n", ", ", "-\t_", "\x00"]).join(w).upper() if n % 3 else " ".join(w)))
    docs += [(7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1]), (500, None), (501, ""), (502, "\n\t.."), (503, "x" * 300_000)]
    docs += [(504, " ".join(rng.choices(vocabulary, k=3000)) + " " + items[3][1] * 2)]
    return docs, items


def test_equal_to_plain_search(spark, case):
    assert found(spark, *case) == plain(*case)


def test_groups_and_pieces_change_nothing(spark, case, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 7)
    monkeypatch.setattr(dc, "BATCH_BYTES", 500)
    monkeypatch.setattr(dc, "PAIRS", 3)
    assert found(spark, *case, table_bytes=1500) == plain(*case)


def test_empty_tables(spark, case):
    docs, items = case
    assert found(spark, docs[:20], []) == plain(docs[:20], [])
    assert found(spark, [], items) == []


def test_long_items_allow_long_moves():
    rng = random.Random(6)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4))).encode()
    strings = dc.TestStrings([(str(i), dc.joined([word() for _ in range(40)])) for i in range(100)] + [("short", b" he in ")])
    text = dc.joined([word() for _ in range(40_000)]) + bytes(8)
    for t in strings.tables:
        at = t.candidates(dc._eights(text), len(text) - 8)
        assert len(at) < len(text) / 30
    long_ = strings.tables[-1]
    assert long_.m > 30 and float(long_.moves.mean()) > 0.8 * long_.last


@pytest.mark.parametrize("seed", range(30))
def test_occurrences_of_few_letters(seed):
    rng = random.Random(seed)
    make = lambda n: dc.joined([bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(n)])
    pieces = [(str(i), make(rng.randint(1, 14))) for i in range(rng.randint(1, 30))]
    strings = dc.TestStrings(pieces, window=rng.randint(1, 12))
    text = make(rng.randint(1, 3000))
    place, number = strings.occurrences(text + bytes(8))
    want = set()
    for i, (a, n) in enumerate(zip(strings.starts.tolist(), strings.sizes.tolist())):
        want |= {(m.start(), i) for m in re.finditer(b"(?=" + re.escape(strings.data[a : a + n]) + b")", text)}
    assert set(zip(place.tolist(), number.tolist())) == want and len(place) == len(want)
