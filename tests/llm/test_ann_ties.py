"""Nearest neighbours where very many are equally near."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_nearest

from quillspark.llm import ann


def test_ties_go_to_the_smaller_key(spark):
    rng = np.random.default_rng(3)
    pairs = rng.permutation(list(combinations(range(30), 2)))[:400]
    vs = [(int(i), [1.0 if k in pair else 0.0 for k in range(32)]) for i, pair in zip(rng.permutation(400), pairs.tolist())]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect()}
    want = brute_nearest(vs, 10)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
