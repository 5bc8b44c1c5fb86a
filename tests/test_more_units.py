"""Generation in stages, ingest, batches, samples, vocabularies, models of pairs, sketches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context, evaluate, fusion, profile, sketches, understanding
from quillspark.plans import generation, ingest, retrieval
from quillspark.sources import tables


def asks(spark):
    blocks = "blocks array<struct<citation_id: int, block: string>>"
    return spark.createDataFrame([(i, f"question {i}", [(1, "one"), (2, "two")]) for i in range(4)] + [(4, "问题", None)], f"query_id long, query string, {blocks}")


def test_only_failing_rows_go_round_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(stage, f):
        seen.add(1)
        n = int(f["key"])
        if n == 3:
            raise RuntimeError("no answer")
        return "fine [来源 2]" if n == 0 or (n == 1 and "no source" in f["note"]) else "wrong [来源 9] and [来源 1]"

    out = {r["query_id"]: r for r in generation.staged(asks(spark), counted, judge=False, review=False).collect()}
    assert seen.value == 5 + 3 + 2  # 0 and 3 are done after the first round, 1 after the second
    assert [(out[i]["attempts"], out[i]["passes"], out[i]["answer"]) for i in range(5)] == [(0, True, "fine [来源 2]"), (1, True, "fine [来源 2]"), (3, False, "wrong  and [来源 1]"), (0, False, None), (3, False, "wrong  and ")]
    assert out[3]["error"] == "no answer" and out[0]["stages"][0]["stage"] == "answer_generation" and out[0]["evaluation"] is out[0]["review"] is None


def test_judgement_never_leaves_nothing(spark):
    def model(stage, f):
        if stage == "evaluate":
            return json.dumps({"irrelevant": [1, 2] if f["key"] == 0 else [2]})
        assert stage != "answer" or ("two" in f["context"]) == (f["key"] == 0)
        return {"answer": "a [来源 1]", "review": "not JSON"}[stage]

    out = {r["query_id"]: r for r in generation.staged(asks(spark).where("query_id < 2"), model).collect()}
    assert out[0]["valid_ids"] == [1, 2] and out[1]["valid_ids"] == [1] and out[1]["answer"] == "a [来源 1]"
    assert [(s["stage"], s["ok"]) for s in out[0]["stages"]] == [("evidence_evaluation", True), ("answer_generation", True), ("critical_review", False), ("final_assembly", False)]


def test_boundary_answers_need_no_citation(spark):
    out = generation.staged(asks(spark).where("query_id = 4 or query_id = 0"), lambda stage, f: generation.BOUNDARY["zh" if f["key"] == 4 else "en"], judge=False, review=False)
    assert all(r["passes"] and r["attempts"] == 0 for r in out.collect())
    assert "Core Answer" in generation.directives("en") and "核心答案" in generation.directives("fr")


def test_order_is_kept(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    assert [r["index"] for r in generation.indexed(rows, "k").orderBy("k").collect()] == list(range(1000))
    assert generation.indexed(rows.limit(0), "k").count() == 0


def test_citations_by_list(spark):
    rows = spark.createDataFrame([("x [来源 2] [来源 5]", [2, 7]), ("none", []), ("none", [1])], "text string, ids array<int>")
    got = evaluate.check_citations(rows, F.col("ids"), F.lit(False)).collect()
    assert [(r["invalid_ids"], r["missing_citations"]) for r in got] == [([5], False), ([], False), ([], True)]


def test_ingest(spark, tmp_path):
    article = lambda body, kind="research-article", ids="": f'<article article-type="{kind}"><front>{ids}<abstract>{"An abstract of its own, with words enough to stay. "}</abstract></front><body><sec><title>1. Results</title>{body}</sec></body></article>'
    files = [("P1", article(f"<p>{'word ' * 700}</p>", ids='<article-id pub-id-type="pmid">5</article-id>')), ("P2", article("<p>A paragraph that is long enough to count.</p>")), ("P3", "<broken"), ("P4", article("", "editorial")), ("P9", article(""))]
    files = spark.createDataFrame([(s, f"/f/{s}.xml", x) for s, x in files], "stem string, path string, content string")
    manifest = spark.createDataFrame([("P1", "8"), ("P2", " 42 "), ("P3", None), ("P4", "1"), ("P5", "2")], "pmc_id string, pmid_csv string")
    got = ingest.run(manifest, files, str(tmp_path)).first().asDict()
    assert {k: got[k] for k in ("n", "skipped_no_file", "skipped_no_parse", "skipped_type", "n_parsed", "n_with_pmid", "n_a", "n_b", "n_c", "n_split_bodies")} == {"n": 5, "skipped_no_file": 1, "skipped_no_parse": 1, "skipped_type": 1, "n_parsed": 2, "n_with_pmid": 2, "n_a": 2, "n_b": 0, "n_c": 1, "n_split_bodies": 1}
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    assert {(r["doc_id"], r["pmid"], r["source_url"]) for r in chunks.collect()} == {("P1", "5", "https://pubmed.ncbi.nlm.nih.gov/5/"), ("P2", "42", "https://pubmed.ncbi.nlm.nih.gov/42/")}
    assert chunks.where("split_strategy = 'D_body_recursive'").count() == got["n_d"] >= 2


def test_batches_by_the_first_schema_and_samples(spark, tmp_path):
    a, b, whole = (str(tmp_path / n) for n in "abw")
    spark.createDataFrame([("1", 5), ("2", 6)], "chunk_id string, n long").write.parquet(a)
    spark.createDataFrame([("2", 9, "x"), ("3", None, "y")], "chunk_id string, n int, more string").write.parquet(b)
    got = tables.merge_batches(spark, [a, b])
    assert got.dtypes == [("chunk_id", "string"), ("n", "bigint")] and sorted(map(tuple, got.collect())) == [("1", 5), ("2", 6), ("3", None)]
    assert tables.sample_chunks(spark, whole, [a, b], 1).count() == 1
    got.write.parquet(whole)
    assert tables.sample_chunks(spark, whole, [a, b], 9).count() == 3
    with pytest.raises(ValueError):
        tables.sample_chunks(spark, str(tmp_path / "x"), [], 1)
    assert sorted((r["chunk_id"], r["place"]) for r in tables.lookup(got, ["3", "9", "1", "3"], "chunk_id").collect()) == [("1", 2), ("3", 0)]


def test_vocabulary_from_fetched_json(spark, tmp_path):
    lines = [{"term": " MI ", "synonyms": [{"name": "Heart attack", "source": "A"}, {"name": "mi", "source": "A"}, {"name": "other", "source": "B"}, {"name": "Heart attack", "source": "A"}]}, {"term": "mi", "synonyms": []}, {"term": "", "synonyms": None}, {"term": "none", "synonyms": None}]
    (tmp_path / "v.json").write_text("\n".join(map(json.dumps, lines)))
    assert {r["term"]: r["expansions"] for r in tables.read_vocabulary(spark, str(tmp_path), ["A"]).collect()} == {"mi": ["Heart attack"], "none": []}
    assert tables.read_vocabulary(spark, str(tmp_path), None, 1).where("term = 'mi'").first()["expansions"] == ["Heart attack"]


def test_model_of_pairs(spark):
    class Model:
        def predict(self, pairs):
            return [len(set(q.split()) & set(t.split())) - 1.0 for q, t in pairs]

    rows = spark.createDataFrame([("a b", "b a c"), ("a", "z"), (None, None), ("late", "w " * 5 + "late")], "q string, t string")
    got = [r[0] for r in rows.select(F.round(fusion.scored(F.col("q"), F.col("t"), Model, most=5), 4)).collect()]
    assert got == [0.7311, 0.2689, 0.2689, 0.2689]
    chunks = spark.createDataFrame([(1, "alpha beta", "J", 2020), (2, "alpha", "J", 2020)], "chunk_id long, text string, journal string, pub_year int")
    vectors_ = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    question = retrieval.question(spark, 0, "alpha gamma", [1.0, 0.2])
    hits = retrieval.retrieve(chunks, vectors_, question, 2026, scorer=lambda q, t: F.length(t).cast("double"))
    assert [r["relevance_score"] for r in hits.orderBy("final_rank").collect()] == [10.0, 5.0]


def test_merged_hits_say_where_they_are_from(spark):
    near = spark.createDataFrame([(0, 1, 0.9, 1, "preview"), (0, 2, 0.8, 2, "seen")], "query_id long, chunk_id long, similarity double, rank int, text string")
    words = spark.createDataFrame([(0, 2, 3.0, 1, "whole"), (0, 3, 1.0, 2, "word")], "query_id long, chunk_id long, score double, rank int, text string")
    got = {r["chunk_id"]: (r["sources"], r["hit_text"]) for r in fusion.merge(near, words).collect()}
    assert got == {1: (["vector"], "preview"), 2: (["vector", "keyword"], "whole"), 3: (["keyword"], "word")}


def test_sketches_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("b"), F.col("id").alias("v"), (F.col("id") % 900).cast("string").alias("m"))
    one = sketches.merged(sketches.batches(rows, "b", "v", "m"))
    for r in sketches.quantiles(one, [0.1, 0.5, 0.99]).collect():
        assert abs(r["value"] / 20_000 - r["share"]) <= sketches.RANK_ERROR
    assert abs(sketches.distinct(one).first()[0] - 900) <= 900 * sketches.COUNT_ERROR
    assert abs(sketches.ranks(one, F.lit(5000).cast("long")).first()[0] - 0.25) <= sketches.RANK_ERROR
    assert sketches.merged(sketches.batches(rows.limit(0), "b", "v", "m")).first()["n"] is None


def test_histogram_and_tops(spark):
    rows = spark.createDataFrame([(0, "a"), (10, "b"), (11, "b"), (99, None), (5000, "a")], "v int, k string")
    assert [tuple(r) for r in profile.histogram_to(rows, "v", [0, 10, 20, 100], 100).orderBy("bucket").collect()] == [(0, 0, 10, 1), (1, 10, 20, 1), (2, 20, 100, 2)]
    assert sorted(map(tuple, profile.tops(rows, {"k": 1, "v": None}).collect()))[:2] == [("k", "a", 2, 1), ("v", "0", 1, 1)]
    assert understanding.time_filter(F.lit(1), F.lit(1)) is not None


def test_abbreviations_and_entities_by_dictionary(spark):
    short = {"mi": ["Myocardial infarction", "heart attack"], "bp": ["blood pressure"], "or": ["odds ratio"], "x-1": []}
    vocabulary = spark.createDataFrame(list(short.items()), "term string, expansions array<string>")
    texts = ["MI and BP: myocardial Infarction", "or", None, "", "X-1 it's BP, blood pressure", "HEART ATTACK", "mi mi"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = rows.select("doc_id", evaluate.check_abbreviations(F.col("text"), {k: v for k, v in short.items() if v}).alias("c")).select("doc_id", "c.*")
    got = {r["doc_id"]: (r["found"], r["missing"], r["passes"]) for r in evaluate.abbreviation_report(rows, vocabulary.where("size(expansions) > 0")).collect()}
    assert got == {r["doc_id"]: (r["found"], r["missing"], r["passes"]) for r in one.collect()} and got[0] == (["bp", "mi"], ["bp"], False)
    assert {r["doc_id"]: r["missing"] for r in evaluate.abbreviation_report(rows, vocabulary).collect()}[4] == ["x-1"]
    classes = spark.createDataFrame([("heart", "organ"), ("heart failure", "disease"), ("Aspirin", "drug"), ("aspirin", "acid")], "term string, class string")
    asks = spark.createDataFrame([(1, "Heart failure and aspirin; heart"), (2, "hearts"), (3, None)], "query_id long, query string")
    assert {r["query_id"]: r["entities"] for r in understanding.find_entities(asks, classes).collect()} == {1: {"acid": ["aspirin"], "disease": ["heart failure"], "drug": ["aspirin"], "organ": ["heart"]}}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.85, 1.0])
def test_near_duplicates_by_links(spark, least):
    rng = random.Random(int(least * 100))
    rows = [(q, i, round(rng.random(), 2), " ".join(rng.choices([f"w{j}" for j in range(9)], k=rng.randint(0, 7)))) for q in range(3) for i in range(70)] + [(9, 1, 0.5, None), (9, 2, 0.5, "")]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, final_score double, text string")
    sets = {(q, i): set((t or "").split()) for q, i, _, t in rows}
    alike = lambda a, b: round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) if sets[a] and sets[b] else 0
    got = {(r["query_id"], r["chunk_id"], r["other_id"]): r["similarity"] for r in context.similar_pairs(hits, least).collect()}
    assert got == {(q, i, j): s for q, i in sets for p, j in sets if p == q and i < j and (s := alike((q, i), (p, j))) >= least}
    kept: list = []
    for q, i, _, _ in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if not any(p == q and alike((q, i), (p, j)) >= least for p, j in kept):
            kept.append((q, i))
    pick = lambda f: sorted((r["query_id"], r["chunk_id"]) for r in f(hits, least).collect())
    assert pick(context.drop_near_duplicates_by_links) == pick(context.drop_near_duplicates) == sorted(kept)
