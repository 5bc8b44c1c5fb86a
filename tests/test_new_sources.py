"""Vector files, the bucketed index, resumable embedding, dictionary lookup, block-max ranking, nearest neighbours by matrices, JSON repair, ROUGE, merging."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bm25, chunking, dictionary, embedding, evaluate, vectors
from quillspark.plans import retrieval
from quillspark.sources import buckets, vectorfiles
from quillspark.streaming import embedding as streamed

# Vector files


def test_pairs_round_trip_and_short_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"b{i % 3}", f"text {i}", [float(i), -1.5]) for i in range(60)], "chunk_id long, batch string, text string, embedding array<float>")
    path = str(tmp_path / "pairs")
    vectorfiles.write_pairs(rows, path, "batch", "chunk_id")
    assert sorted(p.name for p in (tmp_path / "pairs").iterdir()) == sorted(f"b{i}{s}" for i in range(3) for s in (".parquet", "_emb.npy"))
    np.save(tmp_path / "pairs" / "b1_emb.npy", np.zeros((19, 2), np.float16))
    np.save(tmp_path / "pairs" / "alone_emb.npy", np.zeros((2, 2)))
    got, report = vectorfiles.read_pairs(spark, path)
    assert {(r["chunk_id"], r["text"], tuple(r["embedding"])) for r in got.collect()} == {(i, f"text {i}", (float(i), -1.5)) for i in range(60) if i % 3 != 1}
    assert sorted(map(tuple, report.collect())) == [("alone", 0, 2, False), ("b0", 20, 20, True), ("b1", 20, 19, False), ("b2", 20, 20, True)]


@pytest.mark.parametrize("kind", ["<f2", "<f4", ">f8"])
def test_matrices_by_row_ranges(spark, tmp_path, kind):
    x = np.arange(700).reshape(100, 7).astype(kind)
    np.save(tmp_path / "m_emb.npy", x)
    np.save(tmp_path / "none_emb.npy", x[:0])
    found = vectorfiles.read_matrices(spark, str(tmp_path), rows=30)
    assert found.rdd.getNumPartitions() == 5
    rows = sorted((r["pos"], r["n"], tuple(r["embedding"])) for r in found.collect())
    assert rows == [(i, 100, tuple(map(float, v))) for i, v in enumerate(x)]
    (tmp_path / "m_emb.npy").write_bytes((tmp_path / "m_emb.npy").read_bytes()[:-7 * x.itemsize * 2 - 1])  # cut off
    assert vectorfiles.read_matrices(spark, str(tmp_path)).count() == 97
    np.save(tmp_path / "m_emb.npy", np.zeros(3, int))
    with pytest.raises(Exception, match="matrices"):
        vectorfiles.read_matrices(spark, str(tmp_path)).count()


# Buckets


def test_upserts_write_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id long, text string")
    with pytest.raises(ValueError):
        buckets.read(spark, path, "id")
    buckets.upsert(rows, path, "id", buckets=8)
    want = {i: f"t{i}" for i in range(200)}
    of = {r["id"]: r["bucket"] for r in buckets.read(spark, path, "id", bucket=True).collect()}
    some = [i for i in of if of[i] == of[0]][:5]
    step = buckets.upsert(spark.createDataFrame([(i, "new") for i in some] * 2, "id long, text string"), path, "id", buckets=8)
    assert [p.name for p in (tmp_path / "index" / step).iterdir() if p.is_dir()] == [f"bucket={of[0]}"]
    want |= {i: "new" for i in some}
    state = lambda: {r["id"]: r["text"] for r in buckets.read(spark, path, "id").collect()}
    assert state() == want
    stopped = tmp_path / "index" / buckets.upsert(spark.createDataFrame([(0, "lost")], "id long, text string"), path, "id", buckets=8)
    (stopped / "_SUCCESS").unlink()  # as if the call had stopped half-way
    assert state() == want
    step = buckets.upsert(spark.createDataFrame([(1, "more", 7)], "id long, text string, extra int"), path, "id", buckets=8)
    assert step > stopped.name and state() == want | {1: "more"}
    assert buckets.compact(spark, path, "id") == len({of[0], of[1]}) and buckets.compact(spark, path, "id") == 0
    assert state() == want | {1: "more"} and buckets.clean(spark, path) > 0 and state() == want | {1: "more"}
    assert {r["id"]: r["extra"] for r in buckets.read(spark, path, "id").collect()}[1] == 7
    for n in range(4):
        buckets.upsert(spark.createDataFrame([(0, f"n{n}")], "id long, text string"), path, "id", buckets=8, compact_at=3)
    assert state()[0] == "n3" and max(map(len, buckets.steps(spark, path)[0].values())) < 3


# Embedding


def test_embedding_hook(spark):
    rows = spark.createDataFrame([(1, "Aspirin, aspirin and stroke"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in embedding.embed_documents(rows, kind="double").collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-12 and not got[2].any() and not got[3].any()
    assert embedding.embed_documents(rows.limit(0)).count() == 0
    asks = rows.select("id", F.col("text").alias("query"))
    with pytest.raises(Exception, match="blank"):
        embedding.embed_queries(asks).collect()
    kept = {r["id"]: r["query_vector"] for r in embedding.embed_queries(asks, blank="null", kind="double").collect()}
    assert kept[2] is None and kept[3] is None
    same = embedding.embed_documents(spark.createDataFrame([(1, embedding.INSTRUCTION + rows.first()["text"])], "id long, text string"), kind="double").first()["embedding"]
    assert kept[1] == same


def test_own_model_and_search(spark):
    class Counted:
        """A model that says how long texts are, beside a constant that makes longer ones nearer to long questions."""

        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    rows = spark.createDataFrame([(i, "x" * (i + 1), 2000 + i, "en" if i % 2 else "de") for i in range(40)], "chunk_id long, text string, year int, lang string")
    rows = embedding.embed_documents(rows, model=Counted)
    asks = spark.createDataFrame([(1, "y"), (2, "  "), (3, None)], "query_id long, query string")
    hits = embedding.search(rows, asks, 5, model=Counted).orderBy("rank").collect()
    assert [r["chunk_id"] for r in hits] == [39, 38, 37, 36, 35] and hits[0]["text_preview"] == "x" * 40 and abs(hits[0]["distance"] + hits[0]["similarity"] - 1) < 1e-6
    assert [r["chunk_id"] for r in embedding.search(rows, asks, 3, where=F.col("lang") == "de", model=Counted).orderBy("rank").collect()] == [38, 36, 34]
    late = embedding.search(rows, asks, 3, ranges=F.col("year") < 2005, model=Counted).orderBy("rank").collect()
    assert [(r["rank"], r["chunk_id"]) for r in late] == [(1, 4), (2, 3), (3, 2)]
    assert [vectors.pool_size(*a) for a in ((3, 1000), (10, 1000), (10, 60), (500, 9000))] == [50, 100, 60, 2000]


def test_resumable_embedding(spark, tmp_path):
    source, staged, index = (str(tmp_path / n) for n in ("source", "staged", "index"))
    first = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "chunk_id long, text string")
    first.repartition(3).write.parquet(source)

    def run():
        streamed.embed_stream(spark, source, first.schema, staged, str(tmp_path / "c1"), files=1).awaitTermination()
        schema = embedding.embed_documents(first).schema
        streamed.load_stream(spark, staged, schema, index, str(tmp_path / "c2")).awaitTermination()
        return {r["chunk_id"]: tuple(r["embedding"]) for r in buckets.read(spark, index).collect()}

    want = {r["chunk_id"]: tuple(r["embedding"]) for r in embedding.embed_documents(first).collect()}
    assert run() == want and run() == want
    more = spark.createDataFrame([(i, f"other {i}") for i in range(15, 30)], "chunk_id long, text string")
    more.write.mode("append").parquet(source)
    # as if it had stopped after writing the next batch and before the checkpoint knew
    number = max(int(p.name) for p in (tmp_path / "c1" / "commits").iterdir() if p.name.isdigit()) + 1
    spark.range(3).select(F.col("id").alias("chunk_id"), F.lit("torn").alias("text"), F.array(F.lit(9.0).cast("float")).alias("embedding")).write.parquet(f"{staged}/batch={number}")
    streamed.embed_stream(spark, source, first.schema, staged, str(tmp_path / "c1")).awaitTermination()
    new = {r["chunk_id"]: tuple(r["embedding"]) for r in embedding.embed_documents(more.where("chunk_id >= 20")).collect()}
    assert run() == want | new


# Dictionary


def test_dictionary_matches(spark, monkeypatch):
    rng = random.Random(3)
    terms = ["heart", "heart failure", "art", "mi", "a b", "ß", "糖尿", "Failure", ""] + ["".join(rng.choices("ab c", k=rng.randint(1, 4))) for _ in range(60)]
    texts = [None, "", "Heart failure, MI; smart art", "mit mi_x mi", "糖尿病 ß"] + ["".join(rng.choices("ab cd", k=rng.randint(0, 40))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
    low = {t.lower() for t in terms if t}
    for size in (1 << 25, 40):  # one block, and several
        monkeypatch.setattr(dictionary, "BLOCK_BYTES", size)
        got = sorted((r["id"], r["term"]) for r in dictionary.matches(rows, vocabulary, "id", "text").collect())
        assert got == sorted((i, t) for i, x in enumerate(texts) for t in low if t in (x or "").lower())
        every = {(r["id"], r["term"], r["start"]) for r in dictionary.matches(rows, vocabulary, "id", "text", words=True, places=True).collect()}
        want = {(i, t, s) for i, x in enumerate(texts) for t in low for s in range(len(x or "")) if (x.lower()).startswith(t, s) and dictionary.edge(x, s - 1) and dictionary.edge(x, s + len(t))}
        assert every == want
        best = {(r["id"], r["term"], r["start"]) for r in dictionary.longest_matches(rows, vocabulary, "id", "text").collect()}
        assert (2, "heart failure", 0) in best and (2, "heart", 0) not in best and (2, "art", 25) in best
        assert best == {(i, t, s) for i in range(len(texts)) for s, _, t in dictionary.longest([(s, s + len(t), t) for j, t, s in want if j == i])}


# Ranking


def test_block_max_skips_and_agrees(spark, tmp_path):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (i + 3) for i in range(400)], k=rng.randint(1, 80)))) for i in range(1500)]
    docs += [(5000 + i, "rare word300 word20 rare") for i in range(12)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asks = spark.createDataFrame([(1, "rare word300"), (2, "word20 word31 word200"), (3, "unknown"), (4, "word0 word0 word5")], "query_id long, query string")
    bm25.save(rows, f"{tmp_path}/i", window=32)
    blocks, stats = bm25.load(spark, f"{tmp_path}/i")
    for k in (1, 5, 10):
        for lead in (1, 4):
            got = sorted(map(tuple, bm25.rank_top(blocks, stats, asks, k, lead).collect()))
            assert got == sorted(map(tuple, bm25.top(bm25.scores(rows, asks), k).collect())) and len(got) == 3 * k
    assert blocks.where("most < array_max(parts) or n <> size(keys)").count() == 0
    seen = bm25.windows(blocks, bm25.weights(stats, asks), 5, 2).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.expr("bound >= floor")).alias("open")).collect()
    assert {r["query_id"]: r["open"] < r["n"] / 2 for r in seen}[1]


def test_text_tokens_as_columns_have_them(spark):
    texts = ["The İstanbul Köln K-1 heart-failure of A b2 x", "", None, "ΣΑΣ Straße ﬁne don't", "Kelvin K-ﬀ IL-6; COVID-19"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", T.tokens(F.col("text")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in rows} == {i: T.text_tokens(t) for i, t in enumerate(texts)}


# Nearest neighbours


def brute_knn(rows, asks, k, ok=lambda r: True, pool=None, post=lambda r: True, within=lambda r, a: True):
    out = []
    for a in asks:
        near = []
        for r in rows:
            v, q = r[1], a[1]
            if v and q and len(v) == len(q) and all(x is not None and np.isfinite(x) for x in v) and any(v) and any(q) and ok(r) and within(r, a):
                v, q = np.array(v), np.array(q)
                near.append((-round(float(v @ q / np.sqrt((v @ v) * (q @ q))), 12), r[0], r))
        near.sort(key=lambda n: n[:2])
        near = [n for n in near[:pool] if post(n[2])] if pool else near
        out += [(a[0], n[1], round(-n[0], 6), i) for i, n in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_knn_by_matrices(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    monkeypatch.setattr(vectors, "SLAB", 64)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)], i % 4, 2000 + i % 10) for i in range(150)]  # many ties
    rows += [(200, None, 1, 2001), (201, [0.0] * 3, 1, 2001), (202, [None, 1.0, 2.0], 1, 2001), (203, [float("nan"), 1.0, 2.0], 1, 2001), (204, [1.0, 2.0], 1, None), (205, [1e200, 1e200, 0.0], 1, None)]
    asks = [(i, rows[i][1], *lohi) for i, lohi in zip(range(0, 60, 7), [(None, None), (2003, 2005), (2009, 2001)] * 3)] + [(900, None, None, None), (901, [0.0] * 3, None, None), (902, [1.0, 1.0], None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, year int").repartition(3)
    queries = spark.createDataFrame(asks, "query_id long, query_vector array<double>, lo int, hi int")
    got = lambda *a, **how: sorted(map(tuple, vectors.knn(table, queries, *a, **how).collect()))
    assert got(4) == brute_knn(rows, asks, 4)
    assert got(4, F.col("label") == 2) == brute_knn(rows, asks, 4, ok=lambda r: r[2] == 2)
    assert got(4, F.col("label") == 2, 9) == brute_knn(rows, asks, 4, pool=9, post=lambda r: r[2] == 2)
    assert got(4, within=("year", "lo", "hi")) == brute_knn(rows, asks, 4, within=lambda r, a: a[2] is None or r[3] is not None and a[2] <= r[3] <= a[3])
    one = spark.createDataFrame([(7, [1.0, 0.5, 0.0])], "query_id long, query_vector array<double>")
    assert sorted(map(tuple, vectors.knn(table, one, 3, number=1).collect())) == brute_knn(rows, [(7, [1.0, 0.5, 0.0])], 3)
    assert vectors.knn(table, queries.limit(0), 3).count() == vectors.knn(table.limit(0), queries, 3).count() == 0


def test_few_rows_need_no_job(spark):
    rows = [("a", 'q"u\\o\nte', None, 0.1), ("é", "", 5, None)]
    table = spark.createDataFrame(rows, "k string, t string, n int, x double")
    assert list(map(tuple, retrieval.few(spark, table.collect(), table.schema).collect())) == rows
    assert retrieval.few(spark, [], table.schema).count() == 0


# JSON


@pytest.mark.parametrize("raw, want", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('Here: {"a": "x, }"} done', {"a": "x, }"}), ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}),
    ('{"a": {"b": [1, 2}, "c": 3}', {"a": {"b": [1, 2]}, "c": 3}), ('{"a": "open\\"} ', {"a": 'open"}'}), ('{"a": 1]}', {"a": 1}), ("no braces", None), (None, None), ("}{", None), ('{"a": "[", "b": ["x"', None),
    ('{"b": 1, "a": {"c": "}"}, ', {"b": 1, "a": {"c": "}"}}), ('{"a": 1} and {"b": 2}', {"a": 1}), ("{}", {}), ('{"a": "back\\\\"}', {"a": "back\\"}),
])
def test_repaired_json(raw, want):
    got = evaluate.repaired_json(raw)
    assert (json.loads(got) if got else None) == want
    assert got is None or got == json.dumps(want, ensure_ascii=False, sort_keys=True)


def test_valid_json_stays():
    rng = random.Random(9)

    def value(depth):
        return rng.choice([lambda: rng.randint(-5, 5), lambda: "".join(rng.choices('{}[],:"\\ x```\n', k=6)), lambda: None, lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))], lambda: {str(i): value(depth - 1) for i in range(rng.randint(0, 3))}][: 5 if depth else 3])()

    for _ in range(300):
        own = {"k": value(3)}
        for raw in (json.dumps(own), f"```json\n{json.dumps(own)}\n```", "answer " + json.dumps(own)):
            assert json.loads(evaluate.repaired_json(raw)) == own


# ROUGE


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(400):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert evaluate.common_length(a, b) == brute_lcs(a, b)
    long = [str(i % 997) for i in range(20_000)]
    began = time.time()
    assert evaluate.common_length(long, long) == 20_000 and time.time() - began < 20


# Merging


def test_merging_is_linear_and_streams(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("one").alias("doc_id"), F.col("id").alias("pos"), F.concat(F.lit("p"), F.col("id")).alias("text"), F.lit(1).alias("token_count"))
    rows = rows.unionByName(spark.createDataFrame([("two", 0, "long", 900), ("two", 1, None, None), ("two", 2, "b", 5), (None, 5, "x", 299), (None, 6, "y", 1), (None, 7, "z", 1)], "doc_id string, pos long, text string, token_count int"))
    began = time.time()
    got = chunking.merge_paragraphs(rows).orderBy("doc_id", "chunk_index").collect()
    assert time.time() - began < 60
    assert [tuple(r) for r in got if r["doc_id"] != "one"] == [(None, 0, "x\n\ny", 300), (None, 1, "z", 1), ("two", 0, "long", 900), ("two", 1, "b", 5)]
    own = [r for r in got if r["doc_id"] == "one"]
    assert [r["chunk_index"] for r in own] == list(range(n // 300)) and own[1]["text"].startswith("p300\n\np301") and all(r["token_count"] == 300 for r in own)
