"""Rules that the tables don't exercise."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bm25, chunking, context, evaluate, filters, fusion, profile, sessions, vectors
from quillspark.plans import retrieval, service
from quillspark.sources import markup, tables
from quillspark.streaming import ingest


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("spec, safe, ranges", [
    (None, None, []),
    ({}, {}, []),
    ({"a": 1}, {"a": 1}, []),
    ({"y": {"$gte": 3}}, None, [("y", "$gte", 3)]),
    ({"$and": [{"a": {"$eq": 1}}, {"y": {"$gte": 3, "$lt": 9}}], "ignored": 5}, {"a": 1}, [("y", "$gte", 3), ("y", "$lt", 9)]),
    ({"$and": [{"a": {"$in": [1]}}, {"b": {"$ne": 2}}]}, {"$and": [{"a": {"$in": [1]}}, {"b": {"$ne": 2}}]}, []),
])
def test_filter_split(spec, safe, ranges):
    assert filters.split(spec) == (safe, ranges)


def test_filter_compiled(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, y int")
    keep = lambda spec: [r["id"] for r in df.where(filters.compile_filter(spec)).orderBy("id").collect()]
    assert keep({"y": {"$gte": 5}}) == [1, 3] and keep({"y": {"$ne": 5}}) == [3] and keep(None) == [1, 2, 3] and keep({"y": 7}) == [3]
    with pytest.raises(ValueError):
        filters.compile_filter({"y": {"$regex": "x"}})


def test_retracted_and_types(spark):
    df = spark.createDataFrame([("no", "Letter"), ("YES", None), (None, "review-article")], "r string, t string")
    assert [r["r"] for r in df.where(T.not_retracted(F.col("r"))).collect()] == ["no", None]
    assert [r["r"] for r in df.where(T.kept_type(F.col("t"))).collect()] == ["YES", None]


def test_titles_and_journals(spark):
    assert one(spark, T.clean_title(F.lit("2.1. Study Design"))) == "Study Design" and one(spark, T.clean_title(F.lit("3 "))) == "3 "
    assert one(spark, T.journal_name(F.lit("PLOS ONE"))) == "PLoS ONE" and one(spark, T.journal_name(F.lit("Cell"))) == "Cell"


def test_recency_and_authority(spark):
    got = [one(spark, fusion.recency(F.lit(y).cast("int"), 2024)) for y in (2024, 2016, 2030, 0, None)]
    assert got == [1.0, 0.5, 1.0, 0.5, 0.5]
    assert one(spark, fusion.authority(F.lit(" The Lancet "))) == 1.0 and one(spark, fusion.authority(F.lit(None).cast("string"))) == 0.5


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        fusion.fuse(None, "best")


def test_greedy_dedup_compares_with_kept_only(spark):
    rows = [(1, "a", 3.0, "w1 w2 w3 w4"), (1, "b", 2.0, "w1 w2 w3 w9"), (1, "c", 1.0, "w1 w2 w9 w8"), (1, "d", 0.5, ""), (1, "e", 0.4, "")]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, final_score double, text string")
    kept = context.drop_near_duplicates(df, 0.6)
    assert sorted(r["chunk_id"] for r in kept.collect()) == ["a", "c", "d", "e"]  # c is near b, but b is gone; empty texts are no duplicates


def test_budget_cuts_once(spark):
    rows = [(1, i, " ".join(["w"] * 100)) for i in range(1, 6)]
    got = context.within_budget(spark.createDataFrame(rows, "query_id int, place int, text string"), 260).orderBy("place").collect()
    assert [(r["place"], r["is_cut"]) for r in got] == [(1, False), (2, False), (3, True)]


def test_recursive_split_keeps_words_and_size():
    text = "\n\n".join(". ".join(f"s{i} " + " ".join(f"w{i}_{j}" for j in range(30)) for i in range(k, k + 9)) for k in range(0, 40, 9))
    pieces = chunking.split_recursively(text, 100, 20)
    assert all(len(p.split()) <= 100 for p in pieces)
    assert set(" ".join(pieces).replace(".", " ").split()) == set(text.replace(".", " ").split())
    assert chunking.split_recursively("short", 100, 20) == ["short"] and chunking.split_recursively("", 100, 20) == []


ARTICLE = """<article article-type="research-article"><front><article-id pub-id-type="pmc">PMC1</article-id><article-id pub-id-type="pmid">42</article-id>
<article-title>A <i>mixed</i> title</article-title><journal-title>PLOS ONE</journal-title><pub-date pub-type="ppub"><year>2019</year></pub-date><pub-date pub-type="epub"><year>2018</year></pub-date>
<abstract>short</abstract></front><body><sec><title>1 Introduction</title><p>A paragraph that is long enough to be kept here.</p><p>tiny</p>
<sec><title>Inner</title><p>Another paragraph, inside, that is long enough to stay.</p></sec><p>And the outer section goes on after the inner one ended.</p></sec>
<sec><title>Funding</title><p>Money that came from somewhere and isn't content at all.</p></sec><fig><caption>A caption that is long enough to keep.</caption></fig></body></article>"""


def test_articles(spark):
    files = spark.createDataFrame([("a", ARTICLE.encode()), ("b", b"<broken"), ("c", b"<article><front/></article>")], "path string, content binary")
    (row,) = markup.read_articles(files).collect()
    assert (row["pmc_id"], row["title"], row["pub_year"], row["abstract_source"]) == ("PMC1", "A mixed title", 2018, "body_fallback")
    assert [(p["section_title"], p["section_path"]) for p in row["paragraphs"]] == [("Introduction", "Introduction"), ("Inner", "Introduction > Inner"), ("Introduction", "Introduction"), ("", "")]
    assert (row["journal"], row["pmid"], row["source_url"]) == ("PLoS ONE", "42", "https://pubmed.ncbi.nlm.nih.gov/42/")
    assert row["paragraphs"][-1]["text"].startswith("[Figure] ")


def test_html(spark):
    pages = spark.createDataFrame([(1, "<p>one <b>two<p>three<script>x()</script><br>four")], "page_id int, html string")
    assert [r["text"] for r in markup.html_paragraphs(pages).orderBy("pos").collect()][:1] == ["one two"]


def test_json_repair():
    assert json.loads(evaluate.repaired_json('```json\n{"a": [1, 2,], "b": 3,}\n``` end')) == {"a": [1, 2], "b": 3}
    assert evaluate.repaired_json('x {"a": [1, 2') is None and evaluate.repaired_json("none") is None and evaluate.repaired_json(None) is None
    for valid in ({"a": "x,]"}, {"a": "see ```json here"}, {"a": ",}", "b": [{}]}):  # what is valid stays
        assert json.loads(evaluate.repaired_json(f"so: {json.dumps(valid)}.")) == valid


def test_generator_failures_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "good", "h\nbody"), (2, "bad", "c")], "query_id long, query string, context string")

    def generator(q, c):
        if q == "bad":
            raise RuntimeError("no answer")
        return c.upper()

    got = {r["query_id"]: (r["answer"], r["error"]) for r in retrieval.generate(rows, generator).collect()}
    assert got == {1: ("H\nBODY", None), 2: (None, "no answer")}


def test_pages_and_termination(spark):
    with pytest.raises(ValueError):
        profile.page(spark.range(3), ["id"], 0, 10)
    assert one(spark, sessions.terminated(F.lit(70), 60, F.lit(9), 5)) == "timeout" and one(spark, sessions.terminated(F.lit(1), 60, F.lit(1), 5)) is None


def test_file_sources_and_sinks(spark, tmp_path):
    for folder, name in (("x", "A1"), ("y", "A1"), ("y", "B2")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.xml").write_text(ARTICLE)
    got = {r["stem"]: r["path"] for r in tables.file_index(spark, str(tmp_path)).collect()}
    assert set(got) == {"A1", "B2"} and got["A1"].endswith("y/A1.xml")
    assert tables.checksums(spark, str(tmp_path / "x")).count() == 1
    (tmp_path / "m.csv").write_text("AccessionID,PMID,Article File,LastUpdated,Retracted\nA1,1,a,2020,no\nA2,2,b,2020,yes\nA3,3,c,2020,\n")
    assert [r["pmc_id"] for r in tables.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("pmc_id").collect()] == ["A1", "A3"]
    rows = spark.createDataFrame([("c1", "t"), ("c1", "t")], "chunk_id string, text string")
    tables.write_index(rows, str(tmp_path / "index"))
    tables.write_index(spark.createDataFrame([("c2", "u"), ("c1", "new")], "chunk_id string, text string"), str(tmp_path / "index"))
    assert {tuple(r) for r in tables.read_index(spark, str(tmp_path / "index")).collect()} == {("c1", "new"), ("c2", "u")}
    tables.write_lines(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double"), str(tmp_path / "lines"))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "lines")).select("i", "x").collect()} == {(1, None), (2, 0.5)}
    tables.write_chunks(rows.limit(1), str(tmp_path / "more"))
    files = spark.createDataFrame([("A1", "p/A1.xml")], "stem string, path string")
    listed = spark.createDataFrame([("A1", "x/A1.tar.gz"), ("A2", ""), ("A1", None)], "pmc_id string, article_file string")
    assert sorted((r["pmc_id"], r["path"] or "") for r in tables.manifest_files(listed, files).collect()) == [("A1", "p/A1.xml"), ("A1", "p/A1.xml"), ("A2", "")]
    tables.write_chunks(rows, str(tmp_path / "chunks"))
    tables.append_log(rows, str(tmp_path / "log"))
    assert tables.merge_batches(spark, [str(tmp_path / "more"), str(tmp_path / "chunks")]).count() == 1
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2 and spark.read.json(str(tmp_path / "log")).count() == 2


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "chunk_id string, n int")
    rows.coalesce(1).write.parquet(source)
    for _ in range(2):
        ingest.ingest(spark, source, rows.schema, target, mark).awaitTermination(120)
    assert spark.read.parquet(target).count() == 2
    rows.where("n = 2").withColumn("chunk_id", F.lit("c")).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, rows.schema, target, mark).awaitTermination(120)
    assert spark.read.parquet(target).count() == 3


def test_session_gap_of_exactly_the_limit(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    df = spark.createDataFrame([(1, at(0)), (1, at(29)), (1, at(70))], "u int, ts timestamp")
    assert sorted(r["n_events"] for r in ingest.sessions(df, "ts", "u", "30 minutes").collect()) == [1, 2]


def test_chunk_ids(spark):
    docs = spark.createDataFrame([(1, "T", "short text"), (2, "T", "\n\n".join(" ".join(["w"] * 90) for _ in range(9)))], "doc_id long, title string, text string")
    got = chunking.strategy_chunks(docs).orderBy("doc_id", "chunk_index").collect()
    assert (got[0]["chunk_id"], got[0]["split_strategy"], got[0]["text"]) == ("1", "A_no_split", "T\n\nshort text")
    assert got[1]["chunk_id"] == "2_chunk_0000" and all(r["total_chunks"] == len(got) - 1 and r["text"].startswith("T\n\n") for r in got[1:])


def test_tools_retry_and_stop(spark):
    from quillspark.plans import agent

    waits, tries = [], []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise agent.RetryableError("again")
        return x

    registry = agent.Registry(sleep=waits.append)
    registry.add("flaky", agent.Tool(flaky, ("x",)))
    registry.add("broken", agent.Tool(lambda: 1 / 0))
    assert registry.call("flaky", x=5) == {"success": True, "result": 5, "error": None, "retryable": False, "retries": 2} and waits == [0.5, 1.0]
    assert not registry.call("flaky")["success"] and not registry.call("unknown")["success"]
    tries.clear()
    trace, results = agent.run_steps(registry, [("flaky", {"x": 1}), ("broken", {}), ("flaky", {"x": 2})], 60, 9)
    assert [t[:2] for t in trace] == [("flaky", "ok"), ("broken", "failed")] and results == [1, None]
    assert agent.run_steps(registry, [("broken", {})], 60, 0)[0][0][1] == "max_iterations"
    assert agent.trace_table(spark, trace).count() == 2


def test_answer_with_references(spark):
    entries = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit("T").alias("title"), F.lit("Cell").alias("journal"), F.lit(2020).alias("pub_year"), F.lit("c9").alias("chunk_id")))
    text = one(spark, evaluate.with_references(F.lit("Yes [来源1]"), entries, "No advice."))
    assert text == "Yes [来源1]\n\nReferences\n[1] T — Cell (2020), c9\n\nNo advice."
    assert one(spark, evaluate.references(F.lit(text)))["passes"]


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def served(spark, clock, answer=None):
    docs = spark.createDataFrame([(i, 2 * i) for i in range(1, 6)], "doc_id long, first_seen long")
    return service.Service(answer or (lambda ask, context: {"answer": f"{ask.query}|{context}"}), docs, clock=clock)


@pytest.mark.parametrize("request_", [{}, {"query": ""}, {"query": "x" * 2001}, {"query": "x", "top_k": 0}, {"query": "x", "top_k": 21}, {"query": "x", "fusion_strategy": "best"}, {"query": "x", "other": 1}])
def test_bad_requests(spark, request_):
    got = served(spark, Clock()).ask(request_, "r1")
    assert got["code"] == 1001 and got["data"] is None and got["request_id"] == "r1"


def test_service_sessions_and_statistics(spark):
    clock = Clock()
    s = served(spark, clock)
    key = s.create_session()["data"]["session_id"]
    assert s.ask({"query": "a", "session_id": key})["data"]["answer"] == "a|"
    assert s.ask({"query": "b", "session_id": key})["data"]["answer"] == "b|Q: a\nA: a|"
    for i in range(25):
        s.ask({"query": str(i), "session_id": key})
    assert s.get_session(key)["data"]["turn_count"] == 20 and s.stats()["data"]["active_sessions"] == 1
    clock.now += 3600
    assert s.get_session(key)["code"] == 0
    clock.now += 0.5
    assert s.get_session(key)["code"] == 3002 and s.delete_session(key)["code"] == 3002
    assert s.stats()["data"]["total_calls"] == 27 and s.stats()["data"]["success_rate"] == 1.0


def test_service_streams(spark):
    s = served(spark, Clock())
    events = [json.loads(e.removeprefix("data: ")) for e in s.ask_stream({"query": "a", "session_id": "k"}, "r")]
    assert [e["event"] for e in events] == ["status", "token", "done"] and events[-1]["data"]["answer"] == "a|" and s.get_session("k")["data"]["turn_count"] == 1

    def broken(ask, context):
        raise OSError("no model")

    s = served(spark, Clock(), broken)
    assert json.loads(list(s.ask_stream({"query": "a"}))[-1].removeprefix("data: "))["event"] == "error"
    assert s.ask({"query": "a"})["code"] == 4001 and s.stats()["data"]["failure_count"] == 2


def test_service_documents_and_health(spark):
    s = served(spark, Clock())
    got = s.list_documents(2, 2)["data"]
    assert [r["doc_id"] for r in got["items"]] == [3, 4] and got["page_info"] == {"page": 2, "page_size": 2, "total": 5, "total_pages": 3}
    assert s.get_document(5)["data"]["first_seen"] == 10 and s.get_document(9)["code"] == 3001 and s.list_documents(0)["code"] == 1001
    assert [s.health(c)["data"]["status"] for c in (None, {"a": lambda: True, "b": lambda: 1 / 0}, {"a": lambda: False})] == ["ok", "degraded", "down"]


def test_truncation_at_sentences(spark):
    cut = lambda t: one(spark, evaluate.truncate_at_sentence(F.lit(t)))
    assert cut("a" * 95 + ". bcd") == "a" * 95 + "." and cut("a" * 50 + ". " + "b" * 50) == "a" * 50 + ". " + "b" * 50
    assert cut("") == "" and cut("中" * 97 + "。文") == "中" * 97 + "。"


def test_flat_sections_count_nested_text_twice(spark):
    xml = "<article><body><sec><title>A</title><p>one</p><sec><title>B</title><p>two</p></sec></sec></body></article>"
    files = spark.createDataFrame([("p", bytearray(xml.encode())), ("bad", bytearray(b"<article>")), ("none", None)], "path string, content binary")
    got = [(r["pos"], r["title"], r["text"]) for r in markup.flat_sections(files).orderBy("pos").collect()]
    assert got == [(0, "A", "AoneBtwo"), (1, "B", "Btwo")]


def test_memory_slides(spark):
    calls = spark.createDataFrame([(1, "k", 0), (2, "k", 10), (3, "k", 20), (4, "k", 31)], "id int, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sessions.memo_hits(calls, ["key"], ["id"], "ts", 10)
    assert [r["hit"] for r in got.orderBy("id").collect()] == [False, True, True, False]
    assert sessions.hit_rate(got.where("id > 9")).first()["hit_rate"] == 0.0


def test_evidence_stays_if_nothing_else_would(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True), (2, 4, True), (3, 5, None)], "query_id int, chunk_id int, bad boolean")
    assert sorted(r["chunk_id"] for r in evaluate.keep_evidence(rows, F.col("bad")).collect()) == [2, 3, 4, 5]


def test_frequencies_match_postings(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (3, None), (4, "")], "doc_id long, text string")
    postings, lengths = bm25.index(docs)
    assert sorted(map(tuple, bm25.frequencies(docs).collect())) == [("alpha", 1), ("beta", 2), ("gamma", 1)]
    rows = lambda stats: sorted(tuple(r) for r in stats.collect())
    assert rows(bm25.term_stats(postings, lengths)) == rows(bm25.term_stats(postings, lengths, bm25.frequencies(docs)))


def test_long_numbers_do_not_fail(spark):
    from quillspark.functions import text as T
    from quillspark.operators import understanding

    assert one(spark, T.citations(F.lit("[来源99999999999999999999] [来源2]"))) == [2**63 - 1, 2]
    rows = spark.createDataFrame([("x [来源99999999999999999999]",)], "text string")
    assert evaluate.check_citations(rows, F.lit(3), F.lit(False)).first()["has_invalid"]
    got = one(spark, understanding.time_range(F.lit("last 99999999999999999999 years"), 2026))
    assert got["hi"] == 2026
    frame = spark.createDataFrame([("-3",), ("12345678901234",), ("x",), (None,)], "n string")
    assert [r["n"] for r in profile.sanitize(frame, [], ["n"]).collect()] == [-3, 12345678901234, 0, 0]


def test_contexts_stay_within_their_budget(spark):
    rows = [(1, i, 1.0 - i / 10, f"s{i}", " ".join(f"w{i}_{j}" for j in range(90)) + ". end", "J", 2020, "Results") for i in range(4)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, final_score double, source string, text string, journal string, pub_year int, section string")
    for budget in (50, 120, 160, 250, 1000):
        (row,) = retrieval.contexts(hits, budget).collect() or [None] if budget > 50 else [None]
        assert row is None or len(row["context"].split()) <= budget
    assert retrieval.contexts(hits, 160).first()["n_selected"] == 2 and "[来源 2 | J 2020 | Results]" in retrieval.contexts(hits, 160).first()["context"]


def test_body_chunks_and_articles(spark):
    rows = [("d", i, t, s, p) for i, (t, s, p) in enumerate([("a " * 200, "M", "Methods > M"), ("b " * 90, "M", "Methods > M"), ("c " * 20, "M", "Methods > M"), ("e " * 700, "", ""), ("f", "M", "Methods > M")])]
    got = chunking.body_chunks(spark.createDataFrame(rows, "doc_id string, pos int, text string, section_title string, section_path string")).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == [f"d_body_{i:05d}" for i in range(len(got))] and {r["total_chunks"] for r in got} == {len(got)}
    assert [(r["split_strategy"][0], r["token_count"], r["imrad_type"]) for r in got[:2]] == [("C", 291, "methods"), ("C", 21, "methods")]
    assert all(r["split_strategy"] == "D_body_recursive" and r["token_count"] <= 400 and r["imrad_type"] == "other" for r in got[2:-1]) and got[-1]["text"] == "M\n\nf"
    files = spark.createDataFrame([("a", ARTICLE.encode())], "path string, content binary")
    chunks = chunking.article_chunks(markup.read_articles(files)).collect()
    assert {r["split_strategy"] for r in chunks} == {"A_no_split", "C_body_merged"} and {r["journal"] for r in chunks} == {"PLoS ONE"}


def test_evaluation(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat ran"), ("糖尿病 药", "糖尿病"), ("risk 5%", None)], "a string, r string")
    a, b, c = evaluate.evaluation(rows, "a", "r").collect()
    assert round(a["rouge_1"]["f1"], 4) == 0.6667 and a["rouge_2"]["f1"] == 0.5 and b["rouge_1"]["recall"] == 1 and b["rouge_1"]["precision"] == 0.75
    assert c["rouge_1"] is None and c["key_info_recall"] is None and c["readability"]["n_sentences"] == 1


def test_seen_registry_and_temperature(spark):
    seen = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "session_id string, chunk_id string")
    assert {r["session_id"]: r["seen"] for r in sessions.seen_ids(seen).collect()} == {"s": ["a", "b"], "t": ["a"]}
    assert sessions.clear_seen(seen, seen.where("session_id = 's'")).count() == 1 and sessions.clear_seen(seen).count() == 0
    assert [one(spark, sessions.cacheable(F.lit(x).cast("double"))) for x in (0.2, 0.3, None)] == [True, False, False]


def test_saved_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, ""), (5, "alpha alpha delta")], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "beta delta beta"), (2, "nothing known"), (3, None)], "query_id long, query string")
    bm25.save(docs, f"{tmp_path}/index")
    saved = bm25.load(spark, f"{tmp_path}/index")
    want = sorted(map(tuple, bm25.scores(docs, asks).collect()))
    assert want and sorted(map(tuple, bm25.rank(*saved, asks).collect())) == want
    assert sorted(map(tuple, bm25.rank(*bm25.only(saved, ["beta", "delta"]), asks).collect())) == want
    assert "In(term, [beta,delta])" in bm25.only(saved, ["beta", "delta"])[0]._jdf.queryExecution().executedPlan().toString()
    bm25.save(docs.where("doc_id = 2"), f"{tmp_path}/index")  # replaces the first
    assert {r["doc_id"] for r in bm25.rank(*bm25.load(spark, f"{tmp_path}/index"), asks).collect()} == {2}
    bm25.save(docs.limit(0), f"{tmp_path}/none")
    assert bm25.rank(*bm25.load(spark, f"{tmp_path}/none"), asks).count() == 0


def test_ask_one_question(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"alpha word{i} beta", "j", 2000 + i, "s") for i in range(6)], "chunk_id long, text string, journal string, pub_year int, section string")
    embeddings = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "chunk_id long, embedding array<float>")
    bm25.save(chunks, f"{tmp_path}/index", key="chunk_id")
    index = bm25.load(spark, f"{tmp_path}/index")
    for text, vector in (("word3 alpha", [1.0, 3.0]), ("word3", None), ("", [1.0, 0.0]), ("unknown", None)):
        own = retrieval.question(spark, 0, text, vector)
        want = retrieval.retrieve(chunks, embeddings, own, 2026).orderBy("final_rank").collect()
        assert retrieval.ask(chunks, embeddings, index, 2026, text, vector).orderBy("final_rank").collect() == want
        assert bool(want) == (text != "unknown")


def test_asking_more_than_once(spark, tmp_path):
    """One prepared object serves all strategies' questions; a hit whose chunk is gone stays, with nulls."""
    chunks = spark.createDataFrame([(i, f"alpha word{i} beta", "nature" if i % 2 else None, 2000 + i, "it's", i) for i in range(8)], "chunk_id long, text string, journal string, pub_year int, section string, `a.b` int")
    embeddings = spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(9)], "chunk_id long, embedding array<float>")
    bm25.save(chunks, f"{tmp_path}/index", key="chunk_id")
    index = bm25.load(spark, f"{tmp_path}/index")
    for strategy in ("simple", "rrf", "weighted"):
        desk = retrieval.Asking(chunks, embeddings, index, 2026, strategy=strategy, k_vector=4)
        for text, vector in (("word3 alpha word3", [1.0, 3.0]), ("beta", [0.0, 1.0])):
            want = retrieval.retrieve(chunks, embeddings, retrieval.question(spark, 0, text, vector), 2026, strategy=strategy, k_vector=4).orderBy("final_rank").collect()
            got = desk(text, vector).orderBy("final_rank").collect()
            assert got == want and [list(r.asDict()) for r in got] == [list(r.asDict()) for r in want]
    lone = retrieval.Asking(chunks, embeddings.where("chunk_id = 8"), index, 2026)("", [1.0, 3.0]).collect()
    assert [(r["chunk_id"], r["text"], r["sources"]) for r in lone] == [(8, None, ["vector"])]
    filtered = retrieval.Asking(chunks, embeddings, index, 2026, where=F.col("pub_year") >= 2006)("", [1.0, 1.0]).collect()
    assert sorted(r["chunk_id"] for r in filtered) == [6, 7]


def test_few_questions_as_arrow(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, -float(i % 3)]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = [[1.0, 0.5, 0.0], None, [0.0, 0.0, 0.0], [-1.0, 2.0, 1.0]]
    table = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_vector array<double>")
    for where in (None, F.col("vec_id") % 2 == 0):
        want = sorted(map(tuple, vectors.knn(rows, table, 3, where).collect()))
        assert len(want) == 6 and sorted(map(tuple, vectors.knn(rows, vectors.asking(asked), 3, where).collect())) == want
        assert sorted(map(tuple, vectors.knn(rows, vectors.asking(asked[:1]), 3, where).collect())) == [r for r in want if r[0] == 0]


def test_terms_as_a_filter(spark):
    table = spark.createDataFrame([("it's",), ("a-b",), ("ü\\",), ("other",)], "term string")
    assert {r[0] for r in table.where(bm25.among(["it's", "ü\\", "a-b", "a-b"])).collect()} == {"it's", "ü\\", "a-b"} and table.where(bm25.among([])).count() == 0


def test_both_ways_to_gather_scores(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 11}" for j in range(i % 9)) or None) for i in range(300)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "word3 word4 word3"), (2, "word1 nothing"), (3, None), (None, "word5")], "query_id long, query string")
    bm25.save(docs, f"{tmp_path}/index", window=16)
    blocks, stats = bm25.load(spark, f"{tmp_path}/index")
    want = sorted(map(repr, bm25.scores(docs, asks).collect()))
    weighed = bm25.weights(stats, asks)
    few, many = (bm25.gathered(blocks, weighed, "doc_id", "query_id", held) for held in (100, 1))
    assert want and sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) == want
    plan = few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning(window" in plan and "Exchange" not in plan.split("Generate")[0]  # what is summed isn't shuffled
    assert bm25.gathered(blocks, weighed.limit(0), "doc_id", "query_id").count() == bm25.gathered(blocks.limit(0), weighed, "doc_id", "query_id").count() == 0
