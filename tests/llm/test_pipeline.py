"""The corpus pipeline against the same stages by hand."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import secrets, toxicity
from test_operators import BYTES, brute_fingerprint, brute_lines, texts, toxic_rows, union_find

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows, labels = toxic_rows(400)
    plain = [(i + 1000, t) for i, t in enumerate(texts())]
    more = [(2000 + i, f"{plain[20][1]} token = abcdef{i} " + "and words that all of these share " * 9) for i in range(5)] + [(2010, None), (2011, None)]
    every = [(i, t, "en", f"src{rng.integers(3)}", len(t or "")) for i, t in [*rows, *plain, *more]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, every


def test_stages(spark, tables):
    d, every = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    kept = [r[:2] for r in every if model.score(r[1] or "", {}) < 0.3]
    assert 300 < len(kept) < len(every) - 40
    kept = [(i, t) for i, _, _, t in brute_lines(kept)]
    prints = {i: brute_fingerprint(t, 5) for i, t in kept}
    links = [(i, j) for i, f in prints.items() for j, g in prints.items() if i < j and (f ^ g).bit_count() <= 4]
    root = union_find(prints, links)
    kept = [(i, t) for i, t in kept if root[i] == i]
    kept = [(i, secrets.redacted(t)) for i, t in kept]
    assert any("[secret]" in t for _, t in kept)
    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter()
    for i, t in kept:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        starts = [0] if len(ids) <= 2048 else [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    got = corpus_pipeline.run(spark, d)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == want


def test_all_stages_but_the_last_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).dtypes == docs.dtypes


def test_empty_table(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).count() == 0
