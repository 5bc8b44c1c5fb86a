"""Documents without a key are entries of the index like others."""

import random

from test_operators import brute_fingerprint

from quillspark.llm import simhash


def chain():
    """Three texts: the second is within 4 bits of both others, which are further apart."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    first = brute_fingerprint(" ".join(words))
    steps = [(words, first)]
    for at in rng.sample(range(600), 600):
        words = [*words[:at], "x", *words[at + 1 :]]
        steps.append((words, brute_fingerprint(" ".join(words))))
        far = (steps[-1][1] ^ first).bit_count()
        if 4 < far <= 8:
            mid = [w for w, f in steps if (f ^ first).bit_count() <= 4 and (f ^ steps[-1][1]).bit_count() <= 4]
            if mid:
                return [" ".join(w) for w in (steps[0][0], mid[-1], words)]
    raise AssertionError


def test_null_keys_link_and_one_row_a_group_stays(spark):
    a, b, c = chain()
    rows = [(7, a, 1), (None, b, 2), (3, c, 3), (3, c, 4), (None, "nothing like it at all", 5), (None, "nothing like it at all", 6), (9, "quite another text", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 3), (None, 3), (3, 3), (3, 3), (None, None), (None, None), (9, 9)], key=str)
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).where("doc_id is not null").collect())
    assert kept == [(3, c), (9, "quite another text")]
    assert [r["text"] for r in simhash.drop_near_duplicates(df).where("doc_id is null").collect()] == ["nothing like it at all"]
