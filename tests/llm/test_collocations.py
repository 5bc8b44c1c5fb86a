"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import collocations

SCHEMA = "doc_id long, lang string, text string, phrase string, `a.b` string, N long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, most=3, least=10, share=50, top=2000):
    f: dict = {}
    n: Counter = Counter()
    for _, lang, text, *_ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = "the of New york city straße 東京 été É a I b c x\x00y -- naïve".split(" ")
    rows = [(i, rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  ", "\x0b"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(500, "en", "new york city " * 30), (501, "en", "la la la la la la la la la la la la la"), (502, "en", None), (503, "en", ""), (None, "de", " .,; "), (504, "xx", "word"), (505, "en", "q" * 5000 + " end")]
    rows += [(600 + i, "de", "ein fester ausdruck Hier") for i in range(12)] + [(600, "de", "ein fester ausdruck Hier")] * 2
    return [(*r, "clash", "dot", 1) for r in rows]


@pytest.mark.parametrize("how", [{}, {"most_words": 4, "least": 5, "share": 30}, {"most_words": 2, "top": 3}])
def test_equals_plain_counting(spark, how):
    rows = corpus()
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    want = brute(rows, **{{"most_words": "most"}.get(k, k): v for k, v in how.items()})
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5


def test_small_slices_and_flushes_count_alike(spark, monkeypatch):
    docs = [r[:3] for r in corpus()]
    want = [{r["phrase"]: r["f"] for r in t.where("lang = 'en'").collect()} for t in collocations.levels(spark.createDataFrame(docs, "doc_id long, lang string, text string"))[1]]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": t} for _, lang, t in docs if lang == "en"])
    for size, tokens in ((7, 5), (50, 1), (1 << 20, 40)):
        monkeypatch.setattr(collocations, "SLICE", size)
        monkeypatch.setattr(collocations, "TOKENS", tokens)
        for k in (1, 2, 3):
            known = None
            if k > 1:
                words = [p.encode().split(b" ") for p in want[k - 2]]
                h = [[np.uint64(collocations.xxhash.xxh64_intdigest(w, collocations.xxhash.xxh64_intdigest(b"en", 42))) for w in p] for p in words]
                one = lambda hs: hs[0] if len(hs) == 1 else collocations.joined(np.array(hs[:1]), np.array(hs[1:]))[0]
                known = type("B", (), {"value": collocations.Frequent(np.unique(np.array([one(x) for x in h], np.uint64)))})
            got: Counter = Counter()
            for b in collocations._count(k, known)(iter([batch])):
                for r in b.to_pylist():
                    got[r["phrase"]] += r["n"]
            assert {p: n for p, n in got.items() if n >= 10} == want[k - 1]


def test_bitmap_in_place_of_hashes(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(collocations, "EXACT", 3)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_long_piece_and_empty_table(spark):
    rows = [(1, "en", "one two three " * 200_000, "", "", 1)]
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["n"]) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["one two three"] == (200_000, 200_000, 200_000, 600_000)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
