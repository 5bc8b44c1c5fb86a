"""Texts become pieces a few at a time."""

from quillspark.operators import chunking


def test_pieces_leave_a_task_by_characters(spark, monkeypatch):
    rows = [(i, f"t{i}", None if i == 3 else " ".join(f"w{i}x{j}" for j in range(40 * (i % 5)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").repartition(1)
    monkeypatch.setattr(chunking, "CHARS", 500)
    cut = chunking.split_texts(docs, "text", 30, 5, "chunk_index", "piece")
    want = sorted((i, t, n, p) for i, t, x in rows for n, p in enumerate(chunking.split_recursively(x or "", 30, 5)))
    assert sorted(map(tuple, cut.collect())) == want
    batch = docs.toArrow().to_batches()
    out = list(chunking._pieces(2, 30, 5, ["doc_id", "title", "chunk_index", "piece"])(iter(batch)))
    assert len(out) > 10 and all(sum(map(len, b.column("piece").to_pylist())) < 500 + 2000 for b in out) and sum(b.num_rows for b in out) == len(want)
    assert chunking.split_texts(docs.limit(0), "text", 30, 5, "chunk_index", "piece").count() == 0
