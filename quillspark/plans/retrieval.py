"""Retrieval end to end: both paths, fusion, reranking, context, and an answer by a pluggable generator."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import text_tokens, tokens
from ..operators import bm25, context, fusion, vectors
from ..sources import tables


def overlap(query: Column, text: Column) -> Column:
    """The default relevance: the share of a query's distinct terms that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(text))), F.size(q)), F.lit(0.0))


def retrieve(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, now: int, k: int = 10, k_vector: int = 20, k_keyword: int = 20, strategy: str = "rrf", where: Column | None = None, filter_keywords: bool = False, weights: dict | None = None, authority: dict | None = None, understood: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None, scorer: Callable[[Column, Column], Column] = overlap, lead: int | None = None) -> DataFrame:
    """The k best chunks for each query.

    chunks: chunk_id, text, journal, pub_year and what ``where`` names; embeddings: chunk_id, embedding; queries: query_id, query,
    query_vector.  The filter holds for the vector path; for the keyword path only if asked for.
    understood: query_id, keyword_query, lo, hi, as ``understanding.understand`` gives them; then the keyword path asks for keyword_query, and
    without ``where`` each query's own range of pub_year is the filter.  A hit without a chunk row stays, its columns null.
    index: postings and statistics by chunk_id of all chunks, as ``bm25.load`` gives them; without it, or where ``filter_keywords`` asks for those
    of the filtered chunks only, they are built on the way.
    lead: with an index, how many windows ``bm25.rank_top`` scores before it leaves out those that can't hold any of the best.  That pays for large indexes and short
    questions; without it every posting of the questions' terms is scored, in one pass over the windows.
    scorer: relevance of a text for a query, as a Column; ``fusion.scored`` makes one of a model.
    """
    asks, own = queries, understood is not None and where is None
    if understood is not None:
        asks = queries.select("query_id", "query_vector").join(understood.select("query_id", F.col("keyword_query").alias("query"), "lo", "hi"), "query_id")
    range_ = ["lo", "hi"] if own else []
    within = ("pub_year", "lo", "hi") if own else None
    rows = embeddings.join(chunks.drop("text"), "chunk_id") if own or where is not None else embeddings
    near = vectors.knn(rows, asks.where("query_vector is not null").select("query_id", "query_vector", *range_), k_vector, where, key="chunk_id", within=within, digits=vectors.GUARD)
    text = chunks.where(where) if filter_keywords and where is not None else chunks
    ready = index is not None and text is chunks
    if lead and ready and not (own and filter_keywords):
        ranked = bm25.rank_top(*index, asks, k_keyword, lead, key="chunk_id", digits=bm25.GUARD)
    elif own and filter_keywords:
        scored = bm25.rank(*index, asks, key="chunk_id") if ready else bm25.scores(text, asks, key="chunk_id")
        scored = scored.join(chunks.select("chunk_id", "pub_year"), "chunk_id").join(asks.select("query_id", "lo", "hi"), "query_id").where(F.col("lo").isNull() | F.col("pub_year").between(F.col("lo"), F.col("hi")))
        ranked = bm25.top(scored.select("query_id", "chunk_id", "score"), k_keyword, key="chunk_id", digits=bm25.GUARD)
    elif ready:
        ranked = bm25.best_saved(*index, asks, k_keyword, key="chunk_id", digits=bm25.GUARD)
    else:
        ranked = bm25.best(text, asks, k_keyword, key="chunk_id", digits=bm25.GUARD)
    fused = tables.written(fusion.fuse(fusion.merge(near, ranked), strategy), "fused")  # however often the result is read, the search runs once
    full = fused.join(tables.fetched(chunks, fused, "chunk_id", bm25.HELD), "chunk_id", "left").join(queries.select("query_id", "query"), "query_id")
    return fusion.rerank(full, now, scorer(F.col("query"), F.col("text")), weights, authority, k=k)


def question(spark: SparkSession, query_id: int, query: str, vector: list[float] | None = None) -> DataFrame:
    """One question as a table that needs no job: query_id, query, query_vector."""
    own = F.array(*map(F.lit, vector)) if vector else F.lit(None)
    return spark.sql("select 1").select(F.lit(query_id).cast("long").alias("query_id"), F.lit(query).alias("query"), own.cast("array<float>").alias("query_vector"))


def few(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A handful of rows as one partition that needs no job and no shuffle: they stand in the plan."""
    kind = ArrayType(schema)
    text = json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, default=str)
    return spark.sql("select 1").select(F.inline(F.from_json(F.lit(text), kind)))


class Asking:
    """``retrieve`` for single questions on a saved index, with few jobs.  What doesn't depend on the question is made once.

    The two paths run side by side, then the chunks they found are fetched by their keys.  At most ``k_vector`` and ``k_keyword`` hits and their
    chunks come to the driver; fusion and reranking then run on one partition without a shuffle.  The filter holds for the vector path.
    """

    def __init__(self, chunks: DataFrame, embeddings: DataFrame, index: tuple[DataFrame, DataFrame], now: int, k: int = 10, k_vector: int = 20, k_keyword: int = 20, strategy: str = "rrf", where: Column | None = None, weights: dict | None = None, authority: dict | None = None, scorer: Callable[[Column, Column], Column] = overlap):
        self.spark, self.chunks, self.k_vector, self.k_keyword = chunks.sparkSession, chunks, k_vector, k_keyword
        rows = embeddings if where is None else embeddings.join(chunks.drop("text"), "chunk_id").where(where)
        self.rows = rows.select("chunk_id", "embedding")
        self.blocks, self.terms = index[0], index[1].select("term", "idf")
        own = chunks.schema
        kinds = [("query_id", LongType()), ("chunk_id", own["chunk_id"].dataType), ("vector_score", DoubleType()), ("vector_rank", IntegerType()), ("keyword_score", DoubleType()), ("keyword_rank", IntegerType()), ("query", StringType()), ("chunk", own)]
        self.kind = StructType([StructField(*x) for x in kinds])
        self.fusing = [fusion.paths(), *fusion.fusing(strategy)]
        columns = [*(n for n, _ in kinds[:6]), *fusion.paths(), "fused_score", "fused_rank"]
        self.columns = [*map(F.col, columns), *(F.col(f"chunk.`{c}`") for c in own.names if c != "chunk_id"), F.col("query")]
        self.reranking = fusion.reranking(now, scorer(F.col("query"), F.col("text")), weights, authority)
        self.best, self.positive = F.col("final_rank") <= k, F.col("score") > 0
        self.order, self.query_id = [F.desc("score"), F.col("chunk_id")], F.lit(0).cast("long")
        self.pool = ThreadPoolExecutor(2)

    def by_vector(self, vector: list[float] | None) -> list[Row]:
        return vectors.knn(self.rows, vectors.asking([vector]), self.k_vector, key="chunk_id", digits=vectors.GUARD).collect() if vector else []

    def by_words(self, terms: list[str]) -> list[Row]:
        """The best chunks by the question's terms: chunk_id, score, best first."""
        idf = {r["term"]: r["idf"] for r in self.terms.where(bm25.among(terms)).collect()} if terms else {}
        if not idf:
            return []
        weight = F.from_json(F.lit(json.dumps({t: v * terms.count(t) for t, v in idf.items()})), "map<string, double>")
        asked = self.blocks.where(bm25.among(list(idf))).withColumns({"query_id": self.query_id, "weight": weight[F.col("term")]})
        return bm25.summed(asked, "chunk_id", "query_id").where(self.positive).orderBy(*self.order).limit(self.k_keyword).collect()

    def __call__(self, query: str, vector: list[float] | None = None) -> DataFrame:
        """The k best chunks for one question, as ``retrieve`` gives them for query_id 0."""
        tasks = [(self.by_vector, vector), (self.by_words, text_tokens(query))]
        near, words = (f.result() for f in [self.pool.submit(inheritable_thread_target(self.spark)(run), x) for run, x in tasks])
        hits: dict = {}
        for r in near:
            hits[r["chunk_id"]] = {"vector_score": r["similarity"], "vector_rank": r["rank"]}
        for i, r in enumerate(words, 1):
            hits.setdefault(r["chunk_id"], {}).update(keyword_score=r["score"], keyword_rank=i)
        found = {r["chunk_id"]: r for r in self.chunks.where(F.col("chunk_id").isin(sorted(hits))).collect()} if hits else {}
        rows = [Row(query_id=0, chunk_id=c, query=query, chunk=found.get(c), **hit) for c, hit in hits.items()]
        fused = fusion.steps(few(self.spark, rows, self.kind), self.fusing).select(*self.columns)
        return fusion.steps(fused, self.reranking).where(self.best)


def ask(chunks: DataFrame, embeddings: DataFrame, index: tuple[DataFrame, DataFrame], now: int, query: str, vector: list[float] | None = None, **how) -> DataFrame:
    """One question by ``Asking``, which those who ask more often should keep."""
    return Asking(chunks, embeddings, index, now, **how)(query, vector)


def contexts(hits: DataFrame, budget: int = 3000, most_per_source: int = 2, source: str = "source", least_left: int = 50) -> DataFrame:
    """One context a query: numbered blocks without near duplicates.  Headers count, and the block that overflows is cut at a sentence,
    so no context holds more than ``budget`` words."""
    kept = context.diversify(context.drop_near_duplicates(hits), most_per_source, source=source)
    head = F.format_string("[来源 %d | %s %s | %s]\n", F.col("place"), F.coalesce("journal", F.lit("?")), F.coalesce(F.col("pub_year").cast("string"), F.lit("?")), F.coalesce("section", F.lit("?")))
    blocks = kept.withColumn("block", F.concat(head, F.trim(F.coalesce("text", F.lit("")))))  # what fits is a prefix, so places number it
    fit = context.within_budget(blocks, budget, least_left, text="block")
    block = F.when(F.col("is_cut"), context.cut(F.col("block"), F.col("tokens"), F.lit(budget) - F.col("used"))).otherwise(F.col("block"))
    out = fit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_id", block.alias("block")))).alias("b"), F.count("*").alias("n_selected"))
    return out.select("query_id", "n_selected", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("context"))


def extract(query: str, text: str) -> str:
    """The default generator: the first block of the context, cited."""
    return f"{text.splitlines()[1][:300]} [来源1]" if "\n" in (text or "") else ""


def generate(rows: DataFrame, generator: Callable[[str, str], str] = extract) -> DataFrame:
    """query_id, query, context and an answer for each row; a row that fails carries its error, the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(q, c):
            try:
                return generator(q, c), None
            except Exception as e:  # any generator's failure is the row's result
                return None, str(e)

        for f in frames:
            got = [one(q, c) for q, c in zip(f["query"], f["context"])]
            yield f.assign(answer=[a for a, _ in got], error=[e for _, e in got])

    return rows.select("query_id", "query", "context").mapInPandas(run, "query_id long, query string, context string, answer string, error string")
