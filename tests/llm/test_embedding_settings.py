"""Settings of the sign hashes by the number of vectors, and links under settings for larger tables."""

import numpy as np
import pytest

from quillspark.llm import embedding_dedup


@pytest.mark.parametrize("n", [0, 1, 500, 65_536, 65_537, 10**6, 10**9])
def test_settings_keep_chance_and_buckets(n):
    bits, tables = embedding_dedup.settings(n, 0.9)
    found = 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables
    assert 0.9655 < found < 0.975 and n / 2**bits <= 16
    assert n > 65_536 or (bits, tables) == (12, 20)


def test_links_under_larger_settings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 24))
    rows = [(i * 10 + k, (base[i] + 0.02 * k * rng.standard_normal(24)).tolist()) for i in range(40) for k in range(4)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), bits=16, tables=39).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = {i: int(near[k].sum()) - 1 for k, (i, _) in enumerate(rows)}
    have = {r["vec_id"]: r["n_links"] for r in got}
    assert all(have[i] <= n for i, n in want.items()) and sum(have.values()) >= 0.99 * sum(want.values())
