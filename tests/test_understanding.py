"""Queries understood whole, and retrieval with what is understood."""

from quillspark import catalog
from quillspark.operators import understanding
from quillspark.plans import retrieval

KIND = "term string, expansions array<string>"


def understood(spark, asks):
    short = spark.createDataFrame([("hbp", ["high blood pressure"]), ("ldl", ["low density lipoprotein"])], KIND)
    alike = spark.createDataFrame([("stroke", ["apoplexy"]), ("high blood pressure", ["hypertension"])], KIND)
    return understanding.understand(asks, short, alike, 2026, [("中风", "stroke")], {"disease": "stroke", "biomarker": "LDL"})


def test_understand(spark):
    asks = spark.createDataFrame([(1, "LDL result after HBP，since 2019"), (2, " 中风 in 2020 "), (3, "nothing")], "query_id long, query string")
    got = {r["query_id"]: r for r in understood(spark, asks).collect()}
    a, b, c = got[1], got[2], got[3]
    assert a["cleaned"] == "LDL result after HBP since 2019" and a["language"] == "en" and a["section"] == "results"
    assert a["entities"] == {"biomarker": ["ldl"]} and a["abbreviations"] == {"ldl": ["low density lipoprotein"], "hbp": ["high blood pressure"]}
    assert a["synonyms"] == {"high blood pressure": ["hypertension"]}  # of an abbreviation's full form
    assert a["expanded_terms"] == ["low density lipoprotein", "high blood pressure", "hypertension"] and (a["lo"], a["hi"]) == (2019, 2026)
    assert a["keyword_query"] == "LDL result after HBP since 2019 low density lipoprotein high blood pressure hypertension"
    assert b["cleaned"] == "stroke in 2020" and b["language"] == "zh" and b["keyword_query"] == "stroke in 2020 apoplexy" and (b["lo"], b["hi"]) == (2020, 2020)
    assert b["vector_query"] == understanding.PREFIX + " 中风 in 2020 " and b["entities"] == {"disease": ["stroke"]}
    assert c["keyword_query"] == "nothing" and c["lo"] is None and c["section"] is None and c["synonyms"] == c["abbreviations"] == c["entities"] == {}


def test_retrieval_uses_what_is_understood(spark):
    texts = {1: "low density lipoprotein values", 2: "apoplexy patients", 3: "other words", 4: "more other words", 5: "still others"}
    chunks = spark.createDataFrame([(i, t, "j", 2015 + i, "src0") for i, t in texts.items()], "chunk_id long, text string, journal string, pub_year long, source string")
    embeddings = spark.createDataFrame([(i, [1.0, float(i)]) for i in texts], "chunk_id long, embedding array<float>")
    asks = spark.createDataFrame([(1, "LDL", None), (2, "中风", None), (3, "unknown since 2019", [1.0, 1.0])], "query_id long, query string, query_vector array<float>")
    hits = lambda **how: {(r["query_id"], r["chunk_id"]) for r in retrieval.retrieve(chunks, embeddings, asks, 2026, **how).collect()}
    every = {(3, i) for i in texts}
    known = understood(spark, asks.select("query_id", "query"))
    assert hits() == every
    assert hits(understood=known) == {(1, 1), (2, 2), (3, 4), (3, 5)}
    assert hits(understood=known, where=chunks["pub_year"] > 0) == {(1, 1), (2, 2)} | every
    assert hits(understood=known, filter_keywords=True) == {(1, 1), (2, 2), (3, 4), (3, 5)}
    assert {"query_understand", "hybrid_understood"} <= catalog.queries().keys()
