"""Columns whose names an operator uses inside, and texts of megabytes."""

from quillspark.llm import linededup, packing, secrets, shingles, simhash, toxicity

NAMES = "row nth id component did rid raw rest kept keep lines dropped at n n_lines h1 h2 fp key cls _row _nth _text _length _part length score _score own known label to of first none".split()


def table(spark, names, texts=None):
    texts = texts or ["a shared line that is long enough\nown one", "a shared line that is long enough\nown two", "a shared line that is long enough\nown three", None, "", "one two three four five six", "one two three four five six"]
    return spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))


def whole(rows, names):
    return bool(rows) and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_line_and_near_dedup_keep_columns(spark):
    docs = table(spark, NAMES)
    lines = linededup.dedup_lines(docs).collect()
    assert len(lines) == 7 and whole(lines, [n for n in NAMES if n != "n_lines"])  # that one is the operator's own result
    assert whole(simhash.drop_near_duplicates(docs).collect(), NAMES)
    assert whole(shingles.drop_near_duplicates(docs).collect(), NAMES)


def test_packing_keeps_columns(spark):
    names = ["row", "_row", "_length", "_part", "closed", "own", "piece"]
    rows = spark.createDataFrame([(i, 1 + 37 * i % 900, *(f"{n}{i}" for n in names)) for i in range(50)], ", ".join(["doc_id long", "length long", *(f"`{n}` string" for n in names)]))
    got = packing.pack(rows, capacity=1000).collect()
    assert len(got) == 50 and whole(got, names)


def test_toxicity_and_secrets_keep_columns(spark):
    docs = table(spark, NAMES)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    clean = toxicity.drop_toxic(docs, labels, threshold=1.1)
    assert clean.columns == docs.columns and whole(clean.collect(), NAMES)
    assert whole(secrets.redact(docs).collect(), NAMES)


def test_megabytes(spark):
    long = "\n".join(f"line {i} of a very long text, with words of its own" for i in range(40_000))
    docs = table(spark, ["extra"], [long, long, long + " end", "short", None])
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(docs).collect()}
    assert got[0][0] == 40_000 and got[0][1] == 39_999 and got[1][1] == 39_999 and got[2][1] == 0 and got[4] == (1, 0)
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near[0] == near[1] == near[2] == 0 and near[3] != 0
    assert {r["doc_id"] for r in shingles.drop_near_duplicates(docs).collect()} == {0, 3, 4}
