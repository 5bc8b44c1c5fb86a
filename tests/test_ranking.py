"""Rankings that tasks make for all questions at once, beside those over all scores."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from quillspark.operators import bm25, vectors
from quillspark.plans import retrieval


def test_best_is_the_top_of_all_scores(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(names, rng.integers(0, 40)))) for i in range(300)] + [(400, None), (401, "the of"), (402, "")]
    rows += [(i + 1000, t) for i, t in rows[:150]] + [(i + 2000, " ".join(reversed((t or "").split()))) for i, t in rows[:150]]  # copies tie, the smaller key first
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asks = spark.createDataFrame([(q, " ".join(rng.choice([*names, "nobody"], 12))) for q in range(9)] + [(20, None), (21, "nobody")], "query_id long, query string")
    want = sorted(map(tuple, bm25.top(bm25.scores(docs, asks), 7).collect()))
    monkeypatch.setattr(bm25, "SLAB", 50)
    assert len(want) == 63 and sorted(map(tuple, bm25.best(docs, asks, 7).collect())) == want
    assert sorted(map(tuple, bm25.best(docs, asks, 7, held=30).collect())) == want
    bm25.save(docs, f"{tmp_path}/i", window=16)
    saved = bm25.load(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, bm25.best_saved(*saved, asks, 7).collect())) == sorted(map(tuple, bm25.best_saved(*saved, asks, 7, held=30).collect())) == want
    everything = bm25.best(docs, asks, 1000).collect()
    assert len(everything) == bm25.scores(docs, asks).where("score > 0").count()
    same = {r["doc_id"]: r["score"] for r in everything if r["query_id"] == 0}
    assert all(same[i] == same[i + 1000] == same[i + 2000] for i in range(150) if i in same)
    assert bm25.best(docs.limit(0), asks, 3).count() == bm25.best(docs, asks.limit(0), 3).count() == 0


def test_copies_of_a_vector_tie_wherever_they_lie(spark):
    rng = np.random.default_rng(3)
    own = rng.normal(size=(7, 61)).astype("f4")
    rows = [(i, own[i % 7].tolist()) for i in range(997)]
    asks = [(q, rng.normal(size=61).tolist()) for q in range(37)]
    near = vectors.knn(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), spark.createDataFrame(asks, "query_id long, query_vector array<double>"), 300).collect()
    for q in range(37):
        found = [r["vec_id"] for r in sorted((r for r in near if r["query_id"] == q), key=lambda r: r["rank"])]
        order = list(dict.fromkeys(i % 7 for i in found))
        assert found == [i for m in order for i in range(m, 997, 7)][:300]


def test_best_reads_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = [(i, f"everywhere w{i % 7} w{i % 5}") for i in range(100)]
    docs, asks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "everywhere w3"), (2, "w4")], "query_id long, query string")
    got = bm25.best(docs.withColumn("text", counted("text")), asks, 5).collect()  # a term of every document needs the mean idf of all terms
    assert seen.value == 100 and sorted(map(tuple, got)) == sorted(map(tuple, bm25.top(bm25.scores(docs, asks), 5).collect()))


def test_a_task_counts_a_term_once():
    rows = pa.record_batch([pa.array(range(3 * bm25.DOCS + 5)), pa.array([f"everywhere w{i % 7} own{i}" if i % 9 else None for i in range(3 * bm25.DOCS + 5)])], names=["key", "text"])
    made = pa.Table.from_batches(bm25._postings(["everywhere", "nobody", "w3"])(iter([rows])))
    counts = made.filter(pc.is_null(made["dl"]))
    df = dict(zip(counts["term"].to_pylist(), counts["df"].to_pylist()))
    texts = [t for t in rows.column("text").to_pylist() if t]
    assert counts.num_rows == len(df) == 1 + 7 + 1 + len(texts) and df[""] == rows.num_rows and df["everywhere"] == len(texts) and df["w3"] == sum(" w3 " in t for t in texts)
    held = made.filter(pc.is_valid(made["dl"]))
    assert held["key"].to_pylist() == list(range(rows.num_rows))
    assert held["places"].to_pylist() == [[] if not t else [0, 2] if " w3 " in t else [0] for t in rows.column("text").to_pylist()]


def test_counts_that_are_added_up_stay_bounded():
    rng = np.random.default_rng(2)
    batches = [bm25._counted(pa.array([f"t{i}" for i in ids]), np.ones(40, int), 40, 99) for ids in (rng.choice(300, 40, False) for _ in range(50))]
    for most in (10, 100, 400, 10**6):
        met, out = bm25.Met(most), []
        for b in batches:
            out += met.add(b)
            assert met.rows <= most
        whole = pa.Table.from_batches(out + list(met.rest())).group_by("term").aggregate([("df", "sum"), ("total", "sum")])
        want = pa.Table.from_batches(batches).group_by("term").aggregate([("df", "sum"), ("total", "sum")])
        assert sorted(map(str, whole.to_pylist())) == sorted(map(str, want.to_pylist()))


def test_what_is_ranked_does_not_grow_with_the_documents(spark, monkeypatch):
    top, passed = bm25.top, []

    def counted(scored, *how, **more):
        passed.append(scored.count())
        return top(scored, *how, **more)

    monkeypatch.setattr(bm25, "top", counted)
    asks = spark.createDataFrame([(q, f"everywhere w{q}", [1.0, float(q)]) for q in range(5)], "query_id long, query string, query_vector array<double>")
    for n in (200, 1600):
        chunks = spark.range(n).selectExpr("id as chunk_id", "concat('everywhere w', id % 7, ' own', id) as text", "'a' as journal", "2000 as pub_year").coalesce(1)
        vectors_ = spark.range(50).selectExpr("id as chunk_id", "array(1d, cast(id as double)) as embedding")
        assert retrieval.retrieve(chunks, vectors_, asks, 2026).count() == 50
    assert passed == [100, 100]  # the 20 best of each question, where every document holds a term of all
