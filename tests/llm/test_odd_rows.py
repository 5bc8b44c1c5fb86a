"""Every stage on odd names and rows, megabytes for every operator on texts, and how few rows a new shard moves."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import packing, secrets, sentencepiece_codec, sharding, suffix_dedup, toxicity

NAMES = ["a.b", "N_LINES", "n_dropped", "score", "row", "Text length", "c0_", "key", "sp`ace"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    shared = "a shared line that is long enough"
    rows = [(1, f"{shared}\nown one"), (2, f"{shared}\nown two of this"), (3, f"{shared}\nsomething else here"), (None, "a null key, its text"), (None, None), (5, ""), (6, "six words that are not elsewhere"), (6, "six words that are not elsewhere")]
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, 0) for i in range(7)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame([(*r, *(f"{n} of {r[0]}" for n in NAMES)) for r in rows]).toDF("doc_id", "text", *(f"x{i}" for i in range(len(NAMES)))).toDF("doc_id", "text", *NAMES)
    return d, docs


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_odd_columns(spark, odd, stage):
    d, docs = odd
    got = corpus_pipeline.STAGES[stage][1](spark, docs, d)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) >= 5 and all(r[i] == f"{n} of {r[0]}" for r in rows for i, n in enumerate(NAMES, 2))


def test_all_stages_in_a_row(spark, odd):
    docs = odd[1]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, odd[0])
    assert {r["doc_id"] for r in docs.collect()} >= {1, 2, 3, 6}


LONG = {"spaces": " " * 1_000_000, "lines": "\n" * 1_000_000, "letters": "a" * 1_000_000, "marks": "!" * 1_000_000, "mixed": "word" + " " * 600_000 + "next\t" + "　" * 20_001 + "<|endoftext|>" + "\n" * 30_000 + "."}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_encode_as_the_library_does(name):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        encode = packing.tokenizer(f.read())
    assert encode(LONG[name]).tolist() == Tokenizer.from_file(path).encode(LONG[name], add_special_tokens=False).ids


def test_megabytes_in_the_other_operators(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LONG.values())], "doc_id long, text string").repartition(2)
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces)
    got = {r["doc_id"]: r["n_tokens"] for r in sentencepiece_codec.digests(docs, pieces).collect()}
    assert got == {i: len(library.encode(t, add_bos=True, add_eos=True)) for i, t in enumerate(LONG.values())}
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert packed.select("doc_id").distinct().count() == len(LONG)
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.report(docs).collect()}[0] == 1_000_000 - 1
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.report(docs, labels).count() == secrets.report(docs).count() == len(LONG)


def test_a_new_shard_moves_few_rows(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(4)
    at = [{r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, shards=n).collect()} for n in (16, 17)]
    moved = np.mean([at[0][k] != at[1][k] for k in at[0]])
    assert moved < 0.15, moved
