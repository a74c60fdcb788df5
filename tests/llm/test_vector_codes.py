"""Vector codes against a plain version of the rule, with odd rows, wide integers and pruning."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from mnemolake.llm import vector_codes as vc

VECTORS = "vec_id long, embedding array<double>, label int, stored string, error long, `_n` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", -1, 0) for r in rows], VECTORS)


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, code, error, label_error) rows, sorted, and the digest."""
    whole = lambda x: math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    sizes = defaultdict(int)
    for _, v, _ in kept:
        sizes[len(v)] += 1
    dims = min(sizes, key=lambda d: (-sizes[d], d))
    kept = sorted((r for r in kept if len(r[1]) == dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-dims // parts)
    cut = []
    for _, v, _ in kept:
        x = [whole(c) for c in v] + [0] * (parts * width - dims)
        cut.append([x[p * width : (p + 1) * width] for p in range(parts)])
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((apart(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[near(p, c[p])[1]].append(c[p])
            for e, xs in own.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, labels = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        best = [near(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        labels[label] += error
        found.append((i, "".join(f"{e:02x}" for _, e in best), error, label))
    fit = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fit(e), fit(labels[lab])) for i, c, e, lab in found), key=str), digest


def compressed(spark, rows, **options):
    stored, books = vc.learn(vc.usable_rows(table(spark, rows)), **options)
    out = vc.with_label_error(vc.encode(stored, books), hot_share=5)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=str), books.sha256()


def test_codes_equal_the_plain_rule(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(9, 64)) * 0.2
    rows = [(int(i) * 3, (centers[rng.integers(9)] + rng.normal(size=64) * 0.05).tolist(), int(rng.integers(4)) or None) for i in range(220)]
    same = rows[7][1]
    rows += [(1000 + i, same, 2) for i in range(150)]
    rows += [(5, None, 1), (6, [], 1), (7, [None] + [0.0] * 63, 1), (8, [float("nan")] + [0.0] * 63, 1), (9, [float("inf")] + [0.0] * 63, 1), (10, [0.5] * 10, 1)]
    rows += [rows[3], rows[3], (None, [0.25] * 64, None)]
    assert compressed(spark, rows) == plain(rows)


@pytest.mark.parametrize("top", [2.0**20, 2.0**40, 1e30, 1e306])
def test_wide_integers_stay_exact(spark, top):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.uniform(-1, 1, 6) * top * rng.choice([1, 1e-3])).tolist(), i % 2) for i in range(40)]
    assert compressed(spark, rows, parts=3, entries=4) == plain(rows, parts=3, entries=4)


def test_few_rows_and_uneven_parts(spark):
    rows = [(2, [0.1, -0.2, 0.3, 0.4, 0.5], None), (1, [0.1, -0.2, 0.3, 0.4, 0.5], 1), (3, [-1.0, 2.0, -3.0, 4.0, -5.0], 1)]
    assert compressed(spark, rows, parts=2) == plain(rows, parts=2)
    stored, books = vc.learn(vc.usable_rows(table(spark, [])))
    assert books is None and stored.count() == 0


def test_bounds_leave_out_most_entries():
    rng = np.random.default_rng(3)
    parts, book = rng.integers(-100, 100, (5000, 4)), rng.integers(-100, 100, (64, 4))
    pivots = vc.pick_pivots(book, 4)
    at, best, evaluated = vc.nearest(parts, vc.root_distances(parts, pivots).astype(np.float32), book, pivots)
    every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < 5000 * 64 * 0.2, evaluated / 5000 / 64
