"""Vector codes against a plain full comparison in Python's own whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillspark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, `a.b` string, `key` int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            got: dict = {}
            for c in cut:
                got.setdefault(nearest(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(col) // len(got[k]) for col in zip(*got[k])] if k in got else e for k, e in enumerate(book)]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    most = vector_codes.MOST
    errors = [min(sum(s for s, _ in c), most) for c in codes]
    sums: dict = {}
    for (_, _, label), e in zip(kept, errors):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), e, min(sums[label], most), digest) for (i, _, label), c, e in zip(kept, codes, errors)), key=str)


def compare(spark, rows):
    got = vector_codes.report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def rest(rows):
    return [(*r, "clash", "dot", 7) for r in rows]


def test_equals_full_comparison(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)], rng.choice([1, 2, None])) for i in range(200)]
    rows += [(300 + i, rows[7][1], 1) for i in range(60)] + [(400, None, 1), (401, [0.0] * 64, 3), (402, [float("nan")] + [0.0] * 63, 1), (403, [None] + [1.0] * 63, 1), (404, [float("-inf")] * 64, 1), (None, rows[3][1], None), (7, rows[9][1], 2), (7, rows[9][1], 2)]
    compare(spark, rest(rows))


def test_ties_lengths_and_sizes(spark):
    rng = random.Random(6)
    compare(spark, rest([(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(rng.choice([0, 5, 16, 21]))], i % 2) for i in range(90)]))  # equal entries, ragged
    compare(spark, rest([(i, [rng.choice([1e9, -3e9, 2e308 / 4, 1.5]) for _ in range(16)], 1) for i in range(12)]))  # beyond longs, fewer rows than entries
    compare(spark, rest([(1, None, 1)]))
    assert vector_codes.report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [1, 2, 4, 9])
def test_tree_is_exact(width):
    rng = np.random.default_rng(width)
    for spread in (2, 40, 1 << 23):
        entries, x = rng.integers(-spread, spread, (64, width)), rng.integers(-spread, spread, (3000, width))
        entries[40:] = entries[:24]  # ties
        square = vector_codes.squares(x[:, None, :], entries[None])
        found, best = vector_codes.Tree(entries).nearest(x)
        assert (found == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()


def test_tree_visits_fewer():
    rng = np.random.default_rng(1)
    entries, x, seen = rng.integers(-99, 99, (64, 4)), rng.integers(-99, 99, (500, 4)), []
    plain, vector_codes.squares = vector_codes.squares, lambda a, b: seen.append(np.broadcast(a, b).size // 4) or plain(a, b)
    try:
        vector_codes.Tree(entries).nearest(x)
    finally:
        vector_codes.squares = plain
    assert sum(seen) < 0.75 * 500 * 64
