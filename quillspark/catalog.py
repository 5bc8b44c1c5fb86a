"""All queries of the library, and the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import bm25, chunking, context, embedding, evaluate, filters, fusion, profile, sessions, sketches, understanding, vectors
from .plans import generation, retrieval
from .plans import ingest as plan_ingest
from .sources import markup, tables, vectorfiles
from .streaming import embedding as streamed
from .streaming import ingest

NOW = 2026
STANDING = {"src0": 1.0, "src1": 0.9, "src2": 0.55}
ASKED = [
    (1, "  Recent  trials of aspirin  in heart failure since 2019？"), (2, "last 5 years: HbA1c outcome and LDL result or CRP finding"), (3, "metformin mechanism, how to procedure between 2010 and 2015"),
    (4, "after 2018 stroke review"), (5, "before 2012 discussion of MI and BP"), (6, "糖尿病 血压 treatment in 2020"), (7, "nothing special here"), (8, "past 3 years implication of high blood pressure"), (9, "糖尿病足"),
]
SHORT = [("mi", ["myocardial infarction", "heart attack"]), ("bp", ["blood pressure"]), ("ldl", ["low density lipoprotein"]), ("or", ["odds ratio"])]
ALIKE = [("heart failure", ["cardiac failure"]), ("stroke", ["cerebrovascular accident"]), ("high blood pressure", ["hypertension"]), ("aspirin", ["acetylsalicylic acid"])]
CHINESE = [("糖尿病", "diabetes"), ("血压", "blood pressure"), ("糖尿病足", "diabetic foot")]
CLASSES = {"drug": "aspirin|metformin", "disease": "stroke|heart.?failure|diabetes", "biomarker": "HbA1c|LDL|CRP"}
TITLES = ["1. Introduction", "2.1 Study Design", "Results and findings", "4 Discussion", "References", "Preface", "Funding sources"]
SPEC = {"$and": [{"lang": {"$in": ["en", "fr"]}}, {"n_chars": {"$gte": 500, "$lt": 5000}}, {"source": {"$ne": "src3"}}]}
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.spread(spark.read.parquet(f"{d}/{name}.parquet"))


def chunk_table(spark, d):
    """Documents as chunks: journal is the source, the year and the section follow from the key."""
    section = F.element_at(T.strings(TITLES), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source", F.col("source").alias("journal"), (2000 + F.col("doc_id") % 25).alias("pub_year"), section.alias("section"))


def asked(spark, d):
    """The questions above, which meet every rule, and all texts of benchmark."""
    own = table(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), F.col("text").alias("query"))
    return spark.createDataFrame(ASKED, "query_id long, query string").unionByName(own)


def hybrid_queries(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vector"))
    return table(spark, d, "benchmark").join(own, "item_id", "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "query_vector")


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _vector_queries(spark, d):
    return _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def lst(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def rows(names: str, values) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else lst(v) if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return f"(select * from (values {', '.join('(' + ', '.join(cell(x) for x in v) + ')' for v in values)}) as t({names}))"


def tok(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-zA-Z][a-zA-Z0-9\\-]{{1,}}'), lambda t: not list_contains({lst(T.STOPWORDS)}, t))"


def wrd(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '')"


def wset(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+'))"


POSTINGS = f"""tk as (select doc_id, {tok('text')} as ts from documents), dl as (select doc_id, len(ts) as dl from tk),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from tk) group by all),
sz as (select count(*) as n, avg(dl) as avgdl from dl),
st0 as (select term, count(*) as df, any_value(n) as n, any_value(avgdl) as avgdl, ln(any_value(n) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as raw from p, sz group by term),
st as (select term, df, n, avgdl, case when raw < 0 then 0.25::double * (select avg(raw) from st0) else raw end as idf from st0)"""
BM25 = f"""{POSTINGS},
q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({tok('text')}) as term from benchmark) group by all),
sc as (select query_id, doc_id as chunk_id, round(sum(times * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 10) as score from q join p using (term) join st using (term) join dl using (doc_id) group by all),
kw as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc where score > 0) where rank <= 20)"""
MEAN = "((2 * sum(round(value * 1000000)::hugeint) + 100 * count(value)) // (200 * count(value)))::double / 10000"  # of values that aren't negative, by whole numbers
DOT = "list_dot_product(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))"
COS = "round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 12)"
VEC = "v as (select *, list_transform(embedding, lambda x: x::double) as v from embeddings)"
HYBRID = f"""{BM25}, {VEC},
vs as (select * from (select a.item_id as query_id, b.vec_id as chunk_id, {COS} as similarity, row_number() over (partition by a.item_id order by {COS} desc, b.vec_id) as rank from (select item_id, v from benchmark join v on vec_id = item_id) a, v b) where rank <= 20),
m as (select coalesce(vs.query_id, kw.query_id) as query_id, coalesce(vs.chunk_id, kw.chunk_id) as chunk_id, similarity as vector_score, vs.rank as vector_rank, score as keyword_score, kw.rank as keyword_rank,
 (vs.rank is not null)::int + (kw.rank is not null)::int as n_sources, coalesce(vs.rank, 1000000 + kw.rank) as place from vs full outer join kw on vs.query_id = kw.query_id and vs.chunk_id = kw.chunk_id)"""
RRF = """f as (select * exclude (fs), round(fs, 6) as fused_score, row_number() over (partition by query_id order by fs desc, place, chunk_id) as fused_rank from (select *, round(coalesce(1.0::double / (60 + vector_rank), 0) + coalesce(1.0::double / (60 + keyword_rank), 0), 10) as fs from m))"""
SECTION = lst(TITLES) + f"[(doc_id % {len(TITLES)} + 1)::int]"
CHUNKS = f"c as (select doc_id as chunk_id, text, source, source as journal, 2000 + doc_id % 25 as pub_year, {SECTION} as section from documents)"
FINAL = f"""{HYBRID}, {RRF}, {CHUNKS},
r as (select f.query_id, f.chunk_id, f.fused_rank, c.source, c.text, qt, case when len(qt) = 0 then 0.0::double else len(list_intersect(qt, {tok('c.text')})) / len(qt)::double end as rel,
 case when pub_year > 0 then pow(0.5::double, greatest(0, {NOW} - pub_year) / 8.0::double) else 0.5 end as rec, case source when 'src0' then 1.0::double when 'src1' then 0.9 when 'src2' then 0.55 else 0.5 end as auth
 from f join c on f.chunk_id = c.chunk_id join (select item_id as query_id, list_distinct({tok('text')}) as qt from benchmark) b on b.query_id = f.query_id),
fin as (select * exclude (fs), round(fs, 6) as final_score, row_number() over (partition by query_id order by fs desc, fused_rank) as final_rank from (select *, round(0.6::double * rel + 0.25::double * rec + 0.15::double * auth, 10) as fs from r))"""


# Ranking and retrieval


@query(f"with {BM25} select query_id, chunk_id as doc_id, round(score, 6) as score, rank from kw where rank <= 10")
def bm25_topk(spark, d):
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.best(table(spark, d, "documents"), asks, 10)


@query(f"with {BM25} select query_id, chunk_id as doc_id, round(score, 6) as score, rank from kw where rank <= 10")
def bm25_saved_topk(spark, d):
    path = tables.workspace(spark, "bm25")
    bm25.save(table(spark, d, "documents"), path)
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return bm25.best_saved(*bm25.load(spark, path), asks, 10)


@query(f"with {POSTINGS} select term, df, round(idf, 6) as idf from st")
def bm25_term_stats(spark, d):
    return bm25.term_stats(*bm25.index(table(spark, d, "documents"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"select doc_id, len({tok('text')}) as n_tokens, len(list_distinct({tok('text')})) as n_distinct from documents")
def tokenize_counts(spark, d):
    terms = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(terms).alias("n_tokens"), F.size(F.array_distinct(terms)).alias("n_distinct"))


def knn_sql(where: str = "true", pool: str = "true") -> str:
    return f"with {VEC}, s as (select a.vec_id as query_id, b.vec_id, b.label, {COS} as similarity from v a, v b where a.vec_id % 100 = 0), p as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as pl from s) select query_id, vec_id, round(similarity, 6) as similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from p where ({where}) and ({pool})) where rank <= 10"


@query(knn_sql())
def knn_exact(spark, d):
    return vectors.knn(_vectors(spark, d), _vector_queries(spark, d), 10)


@query(knn_sql("label in (1, 3, 5)"))
def knn_prefilter(spark, d):
    return vectors.knn(_vectors(spark, d), _vector_queries(spark, d), 10, F.col("label").isin(1, 3, 5))


@query(knn_sql("label in (1, 3, 5)", "pl <= 50"))
def knn_pool_postfilter(spark, d):
    return vectors.knn(_vectors(spark, d), _vector_queries(spark, d), 10, F.col("label").isin(1, 3, 5), pool=50)


@query(f"with {VEC}, s as (select a.vec_id as q, b.vec_id as i, {COS} as c, row_number() over (partition by a.vec_id order by {COS} desc, b.vec_id) as r from v a, v b where a.vec_id % 100 = 0) select count(*) as n, count(*) filter (where q = i) as hits, round(count(*) filter (where q = i) / count(*)::double, 4) as recall, round(avg(1 - c), 4) as mean_distance, round(max(1 - c), 4) as max_distance from s where r = 1")
def self_recall(spark, d):
    top = vectors.knn(_vectors(spark, d), _vector_queries(spark, d), 1, digits=vectors.GUARD)
    hit = F.col("query_id") == F.col("vec_id")
    return top.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 4).alias("recall"), F.round(F.avg(1 - F.col("similarity")), 4).alias("mean_distance"), F.round(F.max(1 - F.col("similarity")), 4).alias("max_distance"))


def _merged(spark, d):
    queries = hybrid_queries(spark, d)
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    near = vectors.knn(_vectors(spark, d).withColumnRenamed("vec_id", "chunk_id"), queries.where("query_vector is not null").select("query_id", "query_vector"), 20, key="chunk_id", digits=vectors.GUARD)
    return fusion.merge(near, bm25.best(chunks, queries, 20, key="chunk_id", digits=bm25.GUARD))


FUSED = ["query_id", "chunk_id", "n_sources", "fused_score", "fused_rank"]


@query(f"with {HYBRID} select query_id, chunk_id, n_sources, n_sources::double as fused_score, row_number() over (partition by query_id order by n_sources desc, coalesce(vector_score, 0) desc, coalesce(keyword_score, 0) desc, place, chunk_id) as fused_rank from m")
def fusion_simple(spark, d):
    return fusion.fuse(_merged(spark, d), "simple").select(FUSED)


@query(f"with {HYBRID}, {RRF} select query_id, chunk_id, n_sources, fused_score, fused_rank from f")
def fusion_rrf(spark, d):
    return fusion.fuse(_merged(spark, d), "rrf").select(FUSED)


@query(f"""with {HYBRID}, w as (select *, min(keyword_score) over (partition by query_id) as lo, max(keyword_score) over (partition by query_id) as hi from m),
 x as (select *, round(0.7::double * coalesce(vector_score, 0) + 0.3::double * coalesce((keyword_score - lo) / nullif(hi - lo, 0), 0), 10) as fs from w)
 select query_id, chunk_id, n_sources, round(fs, 6) as fused_score, row_number() over (partition by query_id order by fs desc, place, chunk_id) as fused_rank from x""")
def fusion_weighted(spark, d):
    return fusion.fuse(_merged(spark, d), "weighted").select(FUSED)


def _hits(spark, d, k=10):
    embeddings = _vectors(spark, d).select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.retrieve(chunk_table(spark, d), embeddings, hybrid_queries(spark, d), NOW, k=k, authority=STANDING)


@query(f"with {FINAL} select query_id, chunk_id, final_score, final_rank from fin where final_rank <= 10")
def hybrid_rrf_rerank(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "final_score", "final_rank")


@query(f"with {FINAL} select query_id, chunk_id, round(rel, 6) as relevance_score, round(rec, 6) as recency_score, round(auth, 6) as authority_score, final_score, final_rank from fin")
def rerank_multicriteria(spark, d):
    return _hits(spark, d, None).select("query_id", "chunk_id", "relevance_score", "recency_score", "authority_score", "final_score", "final_rank")


@query("select lang, count(*) as n, sum(n_chars) as chars from documents where lang in ('en', 'fr') and n_chars >= 500 and n_chars < 5000 and source <> 'src3' group by lang")
def filter_and_mixed(spark, d):
    return table(spark, d, "documents").where(filters.compile_filter(SPEC)).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


# Contexts

SIM = f"case when len(a.w) > 0 and len(b.w) > 0 then round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double, 6) else 0 end"


@query(f"with {FINAL}, h as (select query_id, chunk_id, {wset('text')} as w from fin where final_rank <= 10) select a.query_id, a.chunk_id, b.chunk_id as other_id, {SIM} as similarity from h a join h b on a.query_id = b.query_id and a.chunk_id < b.chunk_id where {SIM} >= 0.2")
def context_jaccard_pairs(spark, d):
    return context.similar_pairs(_hits(spark, d), 0.2)


DIVERSE = f"""{FINAL}, h as (select *, row_number() over (partition by query_id, source order by final_score desc, chunk_id) as source_rank from fin where final_rank <= 10),
dv as (select *, row_number() over (partition by query_id order by (source_rank > 2)::int, final_score desc, chunk_id) as place from h)"""


@query(f"with {DIVERSE} select query_id, chunk_id, source_rank, place from dv")
def context_diversity(spark, d):
    return context.diversify(_hits(spark, d)).select("query_id", "chunk_id", "source_rank", "place")


@query(f"""with {DIVERSE}, s as (select *, len({wrd('text')}) as tokens from dv), u as (select *, coalesce(sum(tokens) over (partition by query_id order by place rows between unbounded preceding and 1 preceding), 0)::bigint as used from s)
select query_id, chunk_id, tokens, used, used + tokens > 1500 as is_cut, row_number() over (partition by query_id order by place) as citation_id from u where used + tokens <= 1500 or (used <= 1500 and 1500 - used > 50)""")
def context_budget(spark, d):
    return context.within_budget(context.diversify(_hits(spark, d)), 1500).select("query_id", "chunk_id", "tokens", "used", "is_cut", "citation_id")


@query()
def context_greedy_dedup(spark, d):
    return context.drop_near_duplicates(_hits(spark, d), 0.3).select("query_id", "chunk_id")


@query()
def generate_answers(spark, d):
    made = retrieval.contexts(_hits(spark, d)).join(hybrid_queries(spark, d).select("query_id", "query"), "query_id")
    return retrieval.generate(made)


# Understanding queries

Q = f"(select * from {rows('query_id, query', ASKED)} union all select item_id + 1000, text from benchmark)"
ENTITIES = [(k, rf"\b(?:{p.lower()})\b") for k, p in CLASSES.items()]
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(query, '\s+', ' ', 'g'), '[。？！，、；：]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select query_id, {CLEAN} as cleaned from {Q}")
def query_clean(spark, d):
    return asked(spark, d).select("query_id", understanding.clean(F.col("query")).alias("cleaned"))


@query(f"select query_id, replace(replace(replace(query, '糖尿病', 'diabetes'), '血压', 'blood pressure'), '糖尿病足', 'diabetic foot') as english, case when regexp_matches(query, '[一-鿿]') then 'zh' else 'en' end as language from {Q}")
def query_translate(spark, d):
    return asked(spark, d).select("query_id", understanding.translate(F.col("query"), CHINESE).alias("english"), T.language(F.col("query")).alias("language"))


@query(f"select query_id, kind, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(query), pattern))), ',') as found from {Q}, {rows('kind, pattern', ENTITIES)} where len(regexp_extract_all(lower(query), pattern)) > 0")
def query_entities(spark, d):
    found = asked(spark, d).select("query_id", F.explode(understanding.entities(F.col("query"), CLASSES)).alias("kind", "f"))
    return found.select("query_id", "kind", F.array_join(F.array_sort("f"), ",").alias("found"))


@query(f"select distinct query_id, term, array_to_string(expansions, '|') as expansions from (select query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_''-]+')) as term from {Q}) join {rows('term, expansions', SHORT)} using (term)")
def query_abbrev(spark, d):
    out = understanding.abbreviations(asked(spark, d), spark.createDataFrame(SHORT, "term string, expansions array<string>"))
    return out.withColumn("expansions", F.array_join("expansions", "|"))


@query(f"select query_id, term, array_to_string(expansions, '|') as expansions from {Q}, {rows('term, expansions', ALIKE)} where contains(lower(query), term)")
def query_synonyms(spark, d):
    out = understanding.synonyms(asked(spark, d), spark.createDataFrame(ALIKE, "term string, expansions array<string>"))
    return out.withColumn("expansions", F.array_join("expansions", "|"))


@query(f"""with q as (select *, lower(query) as l from {Q}), r as (select query_id, case
 when regexp_matches(l, 'last\\s+(\\d+)\\s+years?') then [{NOW} - regexp_extract(l, 'last\\s+(\\d+)\\s+years?', 1)::int, {NOW}]
 when regexp_matches(l, 'past\\s+(\\d+)\\s+years?') then [{NOW} - regexp_extract(l, 'past\\s+(\\d+)\\s+years?', 1)::int, {NOW}]
 when regexp_matches(l, 'since\\s+(20\\d{{2}})') then [regexp_extract(l, 'since\\s+(20\\d{{2}})', 1)::int, {NOW}]
 when regexp_matches(l, 'after\\s+(20\\d{{2}})') then [regexp_extract(l, 'after\\s+(20\\d{{2}})', 1)::int + 1, {NOW}]
 when regexp_matches(l, 'before\\s+(20\\d{{2}})') then [1900, regexp_extract(l, 'before\\s+(20\\d{{2}})', 1)::int - 1]
 when regexp_matches(l, 'between\\s+(20\\d{{2}})\\s+and\\s+(20\\d{{2}})') then [regexp_extract(l, 'between\\s+(20\\d{{2}})\\s+and', 1)::int, regexp_extract(l, 'and\\s+(20\\d{{2}})', 1)::int]
 when regexp_matches(l, 'in\\s+(20\\d{{2}})') then [regexp_extract(l, 'in\\s+(20\\d{{2}})', 1)::int, regexp_extract(l, 'in\\s+(20\\d{{2}})', 1)::int]
 when regexp_matches(l, 'recent(?:ly)?') then [{NOW} - 5, {NOW}] end as t from q) select query_id, t[1] as lo, t[2] as hi from r""")
def query_time_filter(spark, d):
    return asked(spark, d).select("query_id", understanding.time_range(F.col("query"), NOW).alias("t")).select("query_id", "t.lo", "t.hi")


@query(f"""with h as (select query_id, section, count(*) as votes, min(ord) as ord from {Q}, {rows('word, section, ord', [(w, s, i) for i, (w, s) in enumerate(understanding.HINTS.items())])} where contains(lower(query), word) group by all)
select query_id, section, votes from (select *, row_number() over (partition by query_id order by votes desc, ord) as n from h) where n = 1""")
def query_imrad_vote(spark, d):
    return understanding.section_votes(asked(spark, d))


@query(f"""with q as (select query_id, {CLEAN} as c from {Q}), e as (select query_id, flatten(list(expansions order by term)) as x from {Q}, {rows('term, expansions', ALIKE)} where contains(lower(query), term) group by query_id)
select q.query_id, case when len(coalesce(list_filter(x, lambda v: not contains(lower(c), lower(v))), [])) = 0 then c else c || ' ' || array_to_string(list_filter(x, lambda v: not contains(lower(c), lower(v))), ' ') end as keyword_query from q left join e on q.query_id = e.query_id""")
def query_keyword(spark, d):
    vocabulary = spark.createDataFrame(ALIKE, "term string, expansions array<string>")
    more = understanding.synonyms(asked(spark, d), vocabulary).groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("term", "expansions"))), lambda e: e["expansions"])).alias("x"))
    rows_ = asked(spark, d).join(more, "query_id", "left")
    return rows_.select("query_id", understanding.keyword_query(understanding.clean(F.col("query")), F.col("x")).alias("keyword_query"))


BASE_TERMS = "(select source as term, list_sort(list(distinct lang)) as expansions from documents where source is not null group by source)"
MORE_TERMS = "(select case when source = 'src1' then 'other' else upper(source) end as term, [upper(min(lang)), 'texts ' || count(*)] as expansions from documents where source is not null group by source)"


@query(f"""with b as (select lower(term) as term, expansions as b from {BASE_TERMS}), m as (select lower(term) as term, expansions as m from {MORE_TERMS})
select coalesce(b.term, m.term) as term, array_to_string(list_concat(coalesce(b, []), list_filter(coalesce(m, []), lambda x: not list_contains(list_transform(coalesce(b, []), lambda y: lower(y)), lower(x)))), '|') as expansions from b full outer join m on b.term = m.term""")
def vocabulary_merge(spark, d):
    """Two vocabularies out of the documents: sources with their languages, and most of them once more, written differently."""
    each = table(spark, d, "documents").where("source is not null").groupBy("source")
    base = each.agg(F.array_sort(F.collect_set("lang")).alias("expansions")).withColumnRenamed("source", "term")
    more = each.agg(F.array(F.upper(F.min("lang")), F.concat(F.lit("texts "), F.count("*"))).alias("expansions")).withColumn("term", F.when(F.col("source") == "src1", "other").otherwise(F.upper("source"))).drop("source")
    return understanding.merge_vocabularies(base, more).select("term", F.array_join("expansions", "|").alias("expansions"))


# Chunking

WINDOWS = f"""w as (select doc_id, {wrd('text')} as w from documents), s as (select doc_id, w, unnest(range(0, greatest(len(w) - 80 - 1, 0) + 1, 320)) as st from w),
cw as (select doc_id, (st // 320) as chunk_index, w[st + 1 : st + 400] as piece from s)"""


@query(f"with {WINDOWS} select doc_id, chunk_index, len(piece) as token_count, md5(array_to_string(piece, ' ')) as text_md5 from cw")
def chunk_sliding_window(spark, d):
    return chunking.windows(table(spark, d, "documents")).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("text_md5"))


@query(f"""with {WINDOWS}, t as (select doc_id, chunk_index, array_to_string(piece, ' ') as text from cw), n as (select *, lead(text) over (partition by doc_id order by chunk_index) as nx, trim(substring(case when length(text) > 80 then right(text, 80) else text end, 11, 20)) as nd from t)
select doc_id, chunk_index, contains(nx, nd) as found from n where nx is not null and length(nd) >= 5""")
def chunk_overlap_check(spark, d):
    return chunking.overlap_found(chunking.windows(table(spark, d, "documents")))


@query("""with l as (select conv_id, turn, role, case when lag(role) over w is not distinct from role then 0 else 1 end as n from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, role, sum(n) over (partition by conv_id order by turn) - 1 as island from l""")
def section_islands(spark, d):
    return chunking.islands(table(spark, d, "conversations").select("conv_id", "turn", "role"), "role", "conv_id", "turn")


PARAGRAPHS = f"""l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as t, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select doc_id, t, len({wrd('t')}) as n, row_number() over (partition by doc_id order by pos) as i from l where len({wrd('t')}) > 0)"""


@query(f"""with recursive {PARAGRAPHS}, m as (select doc_id, i, n as total, 0 as chunk from k where i = 1 union all
 select k.doc_id, k.i, case when m.total + k.n <= 300 then m.total + k.n else k.n end, case when m.total + k.n <= 300 then m.chunk else m.chunk + 1 end from m join k on k.doc_id = m.doc_id and k.i = m.i + 1)
select m.doc_id, chunk as chunk_index, sum(n)::bigint as token_count, md5(string_agg(t, chr(10) || chr(10) order by m.i)) as text_md5 from m join k on k.doc_id = m.doc_id and k.i = m.i group by all""")
def paragraph_merge(spark, d):
    return chunking.merge_paragraphs(chunking.paragraphs(table(spark, d, "documents"))).select("doc_id", "chunk_index", "token_count", F.md5("text").alias("text_md5"))


@query()
def chunk_strategy_ab(spark, d):
    return chunking.strategy_chunks(table(spark, d, "documents").withColumn("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))))


def _kind(parts, c: str = "t") -> str:
    return " or ".join(f"contains({c}, '{p}')" for p in parts)


def body(spark, d):
    """The lines of documents as paragraphs; two at a time are a section, whose top title goes round."""
    nth = F.expr("pos div 2")
    lines = chunking.paragraphs(table(spark, d, "documents")).drop("token_count")
    top = F.element_at(T.strings(TITLES), ((nth + F.col("doc_id")) % len(TITLES) + 1).cast("int"))
    part = F.concat(F.lit("Part "), nth.cast("string"))
    return lines.withColumns({"section_title": part, "section_path": F.concat(T.clean_title(top), F.lit(" > "), part)})


@query(f"""with recursive {PARAGRAPHS.replace("select doc_id, t, len", "select doc_id, t, pos // 2 as s, len")}, m as (select doc_id, i, s, n as total, 0 as chunk from k where i = 1 union all
 select k.doc_id, k.i, k.s, case when k.s = m.s and m.total + k.n <= 300 then m.total + k.n else k.n end, case when k.s = m.s and m.total + k.n <= 300 then m.chunk else m.chunk + 1 end from m join k on k.doc_id = m.doc_id and k.i = m.i + 1),
c as (select m.doc_id, chunk, m.s, sum(n)::bigint + 2 as token_count, 'Part ' || m.s as section_title, string_agg(t, chr(10) || chr(10) order by m.i) as txt from m join k on k.doc_id = m.doc_id and k.i = m.i group by all),
u as (select *, {lst(TITLES)}[((s + doc_id) % {len(TITLES)} + 1)::int] as title from c), v as (select *, coalesce(nullif(trim(regexp_replace(title, '^\\d+(\\.\\d+)*\\.?\\s+', '')), ''), title) as top from u)
select doc_id, section_title, top || ' > ' || section_title as section_path, case {' '.join(f"when {_kind(p, 'lower(top)')} then '{k}'" for k, p in T.IMRAD.items())} else 'other' end as imrad_type, token_count, md5(section_title || chr(10) || chr(10) || txt) as text_md5 from v where token_count <= 512""")
def body_chunks_merged(spark, d):
    out = chunking.body_chunks(body(spark, d)).where("split_strategy = 'C_body_merged'")
    return out.select("doc_id", "section_title", "section_path", "imrad_type", "token_count", F.md5("text").alias("text_md5"))


@query()
def body_chunks(spark, d):
    return chunking.body_chunks(body(spark, d), limit=128, size=100, overlap=20)


BLANK = "[\\x09-\\x0D\\x20]"


@query(f"""with {PARAGRAPHS.replace("select doc_id, t, len", "select doc_id, t, pos // 2 as s, len")}
select doc_id, count(distinct s) as n_sections, sum(len(regexp_replace(t, '{BLANK}', '', 'g')))::bigint as n_letters from k group by doc_id""")
def body_chunks_whole(spark, d):
    """Chunks of either kind, without overlap, hold all of a document's sections and every character of its paragraphs but white space."""
    got = chunking.body_chunks(body(spark, d), limit=128, size=100, overlap=0)
    letters = lambda c: F.length(F.regexp_replace(c, BLANK, "")).cast("long")
    return got.groupBy("doc_id").agg(F.countDistinct("section_path").alias("n_sections"), F.sum(letters("text") - letters("section_title")).alias("n_letters"))


@query("select doc_id, substring(coalesce(text, ''), 1, 200) as preview from documents")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


FIRST = "string_split(coalesce(text, ''), chr(10))[1]"


@query(f"""with d as (select doc_id, {FIRST} as title from documents), c as (select *, lower(coalesce(nullif(trim(regexp_replace(title, '^\\d+(\\.\\d+)*\\.?\\s+', '')), ''), title)) as t from d)
select doc_id, case {' '.join(f"when {_kind(p)} then '{k}'" for k, p in T.IMRAD.items())} else 'other' end as imrad, {_kind(T.NOISE)} as is_noise from c""")
def imrad_classify(spark, d):
    """Each document by its first line, taken as its title."""
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    return table(spark, d, "documents").select("doc_id", T.imrad(title).alias("imrad"), T.is_noise(title).alias("is_noise"))


@query("""with i as (select doc_id, regexp_extract(coalesce(text, ''), '[0-9]+') as pmid, case when source = 'src0' then '10.1/' || md5(coalesce(text, '')) else '' end as doi, case when lang = 'en' then 'PMC' || doc_id end as pmc from documents)
select doc_id, case when pmid <> '' and pmid <> '0' then 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' when doi <> '' then 'https://doi.org/' || doi when pmc is not null then 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmc || '/' end as url from i""")
def source_url_fallback(spark, d):
    """A URL by the first number in the text, or else a DOI, or else a PMC id."""
    pmid = F.regexp_extract(F.coalesce("text", F.lit("")), "[0-9]+", 0)
    doi = F.when(F.col("source") == "src0", F.concat(F.lit("10.1/"), F.md5(F.coalesce("text", F.lit(""))))).otherwise("")
    return table(spark, d, "documents").select("doc_id", T.source_url(pmid, doi, F.when(F.col("lang") == "en", F.concat(F.lit("PMC"), "doc_id"))).alias("url"))


LISTED_FILES = """(select 'A' || lpad(doc_id::varchar, 12, '0') as AccessionID, case doc_id % 4 when 0 then doc_id::varchar when 1 then '0' when 2 then null else 'x9' end as PMID, case when doc_id % 5 = 0 then '' else lang || '/' || doc_id % 97 || '.xml' end as Article_File,
 '2020-01-01 00:00:00' as LastUpdated, case doc_id % 3 when 0 then 'no' when 1 then 'YES' end as Retracted from documents)"""


def manifest(spark, d):
    """A manifest with a row for each document, as it would be read from its file."""
    i = F.col("doc_id")
    pmid = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, "0").when(i % 4 == 3, "x9")
    file = F.when(i % 5 == 0, "").otherwise(F.concat("lang", F.lit("/"), (i % 97).cast("string"), F.lit(".xml")))
    flag = F.when(i % 3 == 0, "no").when(i % 3 == 1, "YES")
    return table(spark, d, "documents").select(F.concat(F.lit("A"), F.lpad(i.cast("string"), 12, "0")).alias("AccessionID"), pmid.alias("PMID"), file.alias("Article File"), F.lit("2020-01-01 00:00:00").alias("LastUpdated"), flag.alias("Retracted"))


@query(f"select AccessionID as pmc_id, PMID as pmid_csv, Article_File as article_file, LastUpdated as last_updated, Retracted as retracted from {LISTED_FILES} where lower(Retracted) is distinct from 'yes'")
def manifest_clean(spark, d):
    return tables.clean_manifest(manifest(spark, d))


@query(f"select AccessionID, Article_File as article_file from (select *, row_number() over (partition by Article_File order by AccessionID) as n from {LISTED_FILES}) where n = 1 or Article_File = ''")
def manifest_union_dedup(spark, d):
    own = manifest(spark, d).select("AccessionID", F.col("`Article File`").alias("article_file"))
    half = F.xxhash64("AccessionID") % 2 == 0
    return tables.union_distinct([own.where(half), own.where(~half)], "article_file", "AccessionID")


@query("select lang, count(*) as n from documents where doc_id not in (select doc_id from labels) group by lang")
def resume_antijoin(spark, d):
    return tables.pending(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query()
def html_paragraphs(spark, d):
    return markup.html_paragraphs(table(spark, d, "pages"))


# Profiles

COUNTED = f"t as (select *, len({wrd('text')}) as n_words from documents)"
STATS = "count(*) as n, round(avg(n_words), 4) as mean, " + ", ".join(f"round(quantile_cont(n_words, {q}), 4) as {a}" for q, a in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))) + ", min(n_words) as least, max(n_words) as most, round(stddev_samp(n_words), 4) as deviation, count(*) filter (where n_words > 512) as n_over, round(100.0::double * count(*) filter (where n_words > 512) / count(*), 4) as pct_over"


def counted(spark, d):
    return table(spark, d, "documents").withColumn("n_words", F.size(T.words(F.col("text"))))


@query(f"with {COUNTED} select lang, {STATS} from t group by lang")
def token_stats(spark, d):
    return profile.token_stats(counted(spark, d), "n_words", 512, ("lang",))


@query(f"with {COUNTED}, s as (select {STATS} from t) select *, case when p95 <= 512 then 'truncate' when p95 <= 768 then 'sliding_window' else 'larger_model_or_sentences' end as strategy, p99 > 768 as long_tail from s")
def split_recommendation(spark, d):
    return profile.recommend(profile.token_stats(counted(spark, d), "n_words", 512), 512)


@query(f"with {COUNTED}, b as {rows('bucket, lo, hi', [(0, 0, 64), (1, 64, 128), (2, 128, 256), (3, 256, 512), (4, 512, 1024), (5, 1024, None)])} select bucket, lo, hi, (select count(*) from t where n_words >= lo and (hi is null or n_words < hi)) as n from b")
def token_histogram(spark, d):
    return profile.histogram(counted(spark, d), "n_words", [0, 64, 128, 256, 512, 1024])


@query("select lang, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 4) as pct from documents group by lang")
def strategy_distribution(spark, d):
    return profile.distribution(table(spark, d, "documents"), "lang")


@query("select case when grouping(lang) = 0 then 'lang' else 'source' end as dimension, coalesce(lang, source) as member, count(*) as n, sum(n_chars)::bigint as total, round(sum(n_chars) / count(*)::double, 4) as mean from documents group by grouping sets ((lang), (source))")
def grouping_sets_profile(spark, d):
    return profile.by_each(table(spark, d, "documents"), ["lang", "source"], "n_chars")


@query("with j as (select d.doc_id, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id) select column_name, n_null, round(100.0::double * n_null / n, 4) as pct from (select count(*) as n, count(*) - count(doc_id) as a, count(*) - count(quality) as b, count(*) - count(toxic) as c from j), lateral (values ('doc_id', a), ('quality', b), ('toxic', c)) as x(column_name, n_null)")
def null_profile(spark, d):
    return profile.nulls(table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left"))


@query(f"select term, count(*) as n from (select unnest({tok('text')}) as term from documents) group by term order by n desc, term limit 40")
def top_terms(spark, d):
    return profile.top_terms(table(spark, d, "documents"), T.tokens(F.col("text")), 40)


@query(f"with {COUNTED} select case when n_words < 100 then 'short' when n_words <= 250 then 'mid' else 'long' end as tier, count(*) as n, count(*) filter (where contains(lower(text), 'licensed')) as n_licensed from t group by all")
def length_tiers(spark, d):
    tier = F.when(F.col("n_words") < 100, "short").when(F.col("n_words") <= 250, "mid").otherwise("long")
    return counted(spark, d).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("text"), F.lit("licensed"))).alias("n_licensed"))


ROLLUP = "r as (select conv_id, turn, role, count(*) over (partition by conv_id) as chunk_count, min(turn) over (partition by conv_id) as first_seen, row_number() over (partition by conv_id order by (role = 'assistant')::int desc, turn) as n from conversations)"


def _rollup(spark, d):
    return profile.rollup_documents(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", F.col("role") == "assistant", "turn")


@query(f"with {ROLLUP} select conv_id, turn, role, chunk_count, first_seen from r where n = 1")
def document_rollup(spark, d):
    return _rollup(spark, d)


@query(f"with {ROLLUP} select conv_id, turn, role, chunk_count, first_seen from r where n = 1 order by conv_id limit 20 offset 20")
def document_page(spark, d):
    return profile.page(_rollup(spark, d), ["conv_id"], 2, 20)


@query("select doc_id, stratum from (select doc_id, lang as stratum, row_number() over (partition by lang order by md5(doc_id || '-42'), doc_id) as n from documents) where n <= 5")
def stratified_sample(spark, d):
    return profile.sample_each(table(spark, d, "documents"), F.col("lang"), 5, "doc_id", 42).select("doc_id", "stratum")


@query("select source, n, n_before::bigint as n_before from (select source, n, sum(n) over (order by md5(source || '-42'), source) - n as n_before from (select source, count(*) as n from documents group by source)) where n_before < 200")
def cluster_sample(spark, d):
    return profile.sample_clusters(table(spark, d, "documents"), "source", 200, 42)


@query("with j as (select d.doc_id, source, quality from documents d left join labels l on d.doc_id = l.doc_id) select doc_id, coalesce(source, '') as source, '' as doi, coalesce(quality, 0)::bigint as quality from j")
def metadata_sanitize(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return profile.sanitize(joined, ["source", "doi"], ["quality"])


@query(f"with {COUNTED} select count(*) as n, count(*) filter (where trim(text) = '') as n_empty, count(*) filter (where n_words not between 1 and 1024) as n_bad_length, (select count(*) from embeddings where len(embedding) <> 64) as n_bad_vectors, count(*) - count(distinct doc_id) as n_repeated from t")
def index_quality_checks(spark, d):
    bad = _vectors(spark, d).agg(F.count_if(F.size("embedding") != 64).alias("n_bad_vectors"))
    own = counted(spark, d).agg(F.count("*").alias("n"), F.count_if(F.trim("text") == "").alias("n_empty"), F.count_if(~F.col("n_words").between(1, 1024)).alias("n_bad_length"), (F.count("*") - F.count_distinct("doc_id")).alias("n_repeated"))
    return own.crossJoin(F.broadcast(bad)).select("n", "n_empty", "n_bad_length", "n_bad_vectors", "n_repeated")  # one row each


# Sessions, caches, statistics

TURNS = "tn as (select conv_id, turn, text as query, answer from (select *, lead(text) over w as answer, lead(role) over w as nr from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant')"


@query(f"with {TURNS} select conv_id, turn, md5(query) as query_md5, md5(answer) as answer_md5 from (select *, row_number() over (partition by conv_id order by turn desc) as n from tn) where n <= 3")
def session_last_turns(spark, d):
    last = sessions.last_turns(sessions.turns(table(spark, d, "conversations")), 3)
    return last.select("conv_id", "turn", F.md5("query").alias("query_md5"), F.md5("answer").alias("answer_md5"))


@query(f"with {TURNS} select conv_id, string_agg('Q: ' || query || chr(10) || 'A: ' || substring(answer, 1, 300), chr(10) order by turn) as prefix from (select *, row_number() over (partition by conv_id order by turn desc) as n from tn) where n <= 3 group by conv_id")
def session_context_prefix(spark, d):
    return sessions.context_prefix(sessions.turns(table(spark, d, "conversations")))


@query("with l as (select user_id, count(*) as n_turns, max(ts) as last_active from events group by user_id), n as (select max(ts) as now from events) select user_id, n_turns, floor(epoch(now))::bigint - floor(epoch(last_active))::bigint <= 86400 as is_active from l, n")
def session_expiry(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    return sessions.active(events, F.lit(now), 86400).select("user_id", "n_turns", "is_active")


@query(f"select user_id, count(*) as n_calls, count(*) filter (where event_type <> 'error') as n_ok, count(*) filter (where event_type = 'error') as n_failed, round(count(*) filter (where event_type <> 'error') / count(*)::double, 4) as success_rate, {MEAN} as mean_latency from events group by user_id")
def qa_stats(spark, d):
    return sessions.call_stats(table(spark, d, "events"), F.col("event_type") == "error", "value", ("user_id",))


@query("select doc_id, sha256('lang=' || lang || chr(31) || 'source=' || source) as cache_key from documents")
def cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cache_key(F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))).alias("cache_key"))


@query("with n as (select max(ts) as now from events), e as (select user_id as cache_key, max(ts) as last_access from events group by user_id) select cache_key, row_number() over (order by last_access desc, cache_key) as recency from e, n where floor(epoch(now))::bigint - floor(epoch(last_access))::bigint <= 172800 order by last_access desc, cache_key limit 50")
def cache_lru_ttl(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now")).first()["now"]
    entries = events.groupBy(F.col("user_id").alias("cache_key")).agg(F.max("ts").alias("last_access"))
    return sessions.live_entries(entries, F.lit(now), 172800, 50).select("cache_key", "recency")


@query("select user_id as session_id, event_type as chunk_id, max(value) as score, not bool_or(ts < timestamp '2024-01-10') as is_new from events group by user_id, event_type")
def seen_chunk_merge(spark, d):
    own = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("chunk_id"), F.col("value").alias("score"), (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).alias("old"))
    return sessions.merge_seen(own.where("old"), own.where("not old"))


@query(f"select time_bucket(interval 1 hour, ts) as start_ts, count(*) as n_calls, count(*) filter (where event_type = 'error') as n_failed, {MEAN} as mean_latency from events group by all")
def windowed_call_stats(spark, d):
    out = ingest.windowed_stats(table(spark, d, "events"), "ts", F.col("event_type") == "error", "value")
    return out.select(F.col("start").alias("start_ts"), "n_calls", "n_failed", "mean_latency")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 12 hours then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, count(*) as n_events, min(ts) as start_ts, max(ts) as last_active from s group by user_id, s""")
def session_windows(spark, d):
    return ingest.sessions(table(spark, d, "events"), "ts", "user_id", "12 hours").select("user_id", "n_events", F.col("start").alias("start_ts"), "last_active")


# Answers

ANSWER = "an as (select doc_id, case doc_id % 4 when 0 then text when 1 then text || ' [来源1] [来源 2]' when 2 then '[来源9]' || text || '[来源2]' else text || ' [来源 3][来源3]' end as answer from documents)"


def answers(spark, d):
    t, i = F.col("text"), F.col("doc_id") % 4
    return table(spark, d, "documents").select("doc_id", F.when(i == 0, t).when(i == 1, F.concat(t, F.lit(" [来源1] [来源 2]"))).when(i == 2, F.concat(F.lit("[来源9]"), t, F.lit("[来源2]"))).otherwise(F.concat(t, F.lit(" [来源 3][来源3]"))).alias("answer"))


CITED = "c as (select doc_id, answer, list_transform(regexp_extract_all(answer, '\\[来源\\s*(\\d+)\\]', 1), lambda x: x::int) as ids from an)"


@query(f"with {ANSWER}, {CITED} select doc_id, array_to_string(list_sort(list_distinct(ids)), ',') as cited, array_to_string(list_sort(list_filter(list_distinct(ids), lambda i: i > 3)), ',') as invalid, len(ids) = 0 as missing_citations, len(list_filter(ids, lambda i: i > 3)) = 0 and len(ids) > 0 as passes from c")
def citation_validate(spark, d):
    out = evaluate.check_citations(answers(spark, d), F.lit(3), F.lit(False), "answer")
    return out.select("doc_id", F.array_join(F.col("cited_ids").cast("array<string>"), ",").alias("cited"), F.array_join(F.col("invalid_ids").cast("array<string>"), ",").alias("invalid"), "missing_citations", "passes")


@query(f"with {ANSWER} select doc_id, md5(regexp_replace(answer, '\\[来源\\s*9\\]', '', 'g')) as stripped_md5 from an")
def citation_strip(spark, d):
    out = evaluate.check_citations(answers(spark, d), F.lit(3), F.lit(False), "answer")
    return out.select("doc_id", F.md5(evaluate.strip_citations(F.col("answer"), F.col("invalid_ids"))).alias("stripped_md5"))


HEADED = "h as (select doc_id, case when doc_id % 3 <> 0 then '## Answer:' || chr(10) else '' end || coalesce(text, '') || chr(10) || case when doc_id % 2 = 0 then '**References**' else 'no references' end as t from documents)"


@query(f"""with {HEADED}, l as (select doc_id, list_transform(string_split(t, chr(10)), lambda x: lower(regexp_replace(regexp_replace(x, '^[#*\\s]+', ''), '[#*\\s:：]+$', ''))) as ls from h)
select doc_id, list_contains(ls, 'answer') as has_answer, list_contains(ls, 'references') as has_references from l""")
def format_sections(spark, d):
    """Whole texts as answers, some with the headings that are asked for around them."""
    t = F.concat(F.when(F.col("doc_id") % 3 != 0, F.lit("## Answer:\n")).otherwise(""), F.coalesce("text", F.lit("")), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("**References**")).otherwise(F.lit("no references")))
    gone = evaluate.missing_sections(t, ["Answer", "References"])
    return table(spark, d, "documents").select("doc_id", (~F.array_contains(gone, "Answer")).alias("has_answer"), (~F.array_contains(gone, "References")).alias("has_references"))


CLAIMS = "cl as (select doc_id, text || case doc_id % 3 when 0 then ' Studies show it is completely safe, 100 % proven to work.' when 1 then ' Take 5 mg for 3 weeks; risk 12%.' else '' end as t from documents)"


def claims(spark, d):
    more = F.when(F.col("doc_id") % 3 == 0, F.lit(" Studies show it is completely safe, 100 % proven to work.")).when(F.col("doc_id") % 3 == 1, F.lit(" Take 5 mg for 3 weeks; risk 12%.")).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("t"))


def _re(p: str) -> str:
    return p.replace("'", "''")


@query(f"with {CLAIMS}, s as (select doc_id, {' + '.join(f"len(regexp_extract_all(t, '{_re(p)}'))" for p in evaluate.SIGNALS.values())} as n from cl) select doc_id, n as n_signals, round(least(1.0::double, n / 5.0::double), 4) as risk_score, case when n >= 3 then 'high' when n >= 1 then 'medium' else 'low' end as risk_level from s")
def hallucination_risk(spark, d):
    return claims(spark, d).select("doc_id", evaluate.hallucination(F.col("t")).alias("h")).select("doc_id", "h.*")


@query("with s as (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[。！？!?.]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from documents) select doc_id, len(p) as n_sentences, round(case when len(p) = 0 then 0 else list_sum(list_transform(p, lambda x: length(x))) / len(p)::double end, 4) as mean_chars, round(case when len(p) = 0 then 0 else list_sum(list_transform(p, lambda x: len(string_split_regex(x, '[\\x09-\\x0D\\x20]+')))) / len(p)::double end, 4) as mean_words from s")
def readability(spark, d):
    return table(spark, d, "documents").select("doc_id", evaluate.readability(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(f"with {CLAIMS} select doc_id, array_to_string(list_sort(list_distinct(list_concat({', '.join(f"list_transform(regexp_extract_all(t, '{_re(p)}'), lambda x: '{k}:' || regexp_replace(lower(x), '\\s', '', 'g'))" for k, p in evaluate.KEY_INFO.items())}))), ',') as facts from cl")
def key_info(spark, d):
    return claims(spark, d).select("doc_id", F.array_join(F.array_sort(evaluate.key_info(F.col("t"))), ",").alias("facts"))


LISTED = "r as (select doc_id, coalesce(text, '') || chr(10) || case doc_id % 3 when 0 then 'nothing cited' when 1 then '## REFERENCES' || chr(10) || '[1] A title — Cell (2020), PMC1' || chr(10) || '[2] no year' else 'References:' || chr(10) || '[1] A title — Cell (2020), PMC1' end as t from documents)"


@query(f"""with {LISTED}, b as (select doc_id, case when instr(lower(t), 'references') > 0 then substring(t, instr(lower(t), 'references') + 10) else '' end as block from r),
e as (select doc_id, regexp_extract_all(block, '\\[[^\\]]+\\]\\s*[^\\n\\[]+') as es from b), n as (select doc_id, len(es) as n_entries, len(list_filter(es, lambda x: regexp_matches(x, '{evaluate.REFERENCE}'))) as n_complete from e)
select doc_id, n_entries, n_complete, n_entries > 0 and n_complete = n_entries as passes from n""")
def references_check(spark, d):
    """Whole texts as answers, with and without a list of references at their end."""
    i = F.col("doc_id") % 3
    tail = F.when(i == 0, F.lit("nothing cited")).when(i == 1, F.lit("## REFERENCES\n[1] A title — Cell (2020), PMC1\n[2] no year")).otherwise(F.lit("References:\n[1] A title — Cell (2020), PMC1"))
    return table(spark, d, "documents").select("doc_id", evaluate.references(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), tail)).alias("r")).select("doc_id", "r.*")


GRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


@query(f"""with p as (select item_id, {wrd('lower(b.text)')} as a, {wrd('lower(d.text)')} as r from benchmark b join documents d on d.doc_id = b.item_id), g as (select item_id, {GRAMS.format('a')} as a, {GRAMS.format('r')} as r from p),
x as (select item_id, len(a) as na, len(r) as nr, coalesce(list_sum(list_transform(list_distinct(a), lambda v: least(len(list_filter(a, lambda y: y = v)), len(list_filter(r, lambda y: y = v))))), 0)::double as both_n from g),
y as (select item_id, case when na = 0 then 0 else both_n / na end as p, case when nr = 0 then 0 else both_n / nr end as r from x) select item_id, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from y""")
def rouge_2(spark, d):
    return _pairs(spark, d).select("item_id", evaluate.rouge_n(F.col("a"), F.col("r"), 2).alias("g")).select("item_id", "g.*")


def _pairs(spark, d):
    own = table(spark, d, "benchmark").select("item_id", T.words(F.lower("text")).alias("a"))
    return own.join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), T.words(F.lower("text")).alias("r")), "item_id")


@query(SQL["rouge_2"].replace(f"{GRAMS.format('a')} as a, {GRAMS.format('r')} as r", "a, r"))
def rouge_1(spark, d):
    return _pairs(spark, d).select("item_id", evaluate.rouge_n(F.col("a"), F.col("r"), 1).alias("g")).select("item_id", "g.*")


@query()
def rouge_l(spark, d):
    return _pairs(spark, d).select("item_id", evaluate.rouge_l(F.col("a"), F.col("r")).alias("f1"))


@query("""select event_id, case event_id % 4 when 0 then props when 1 then '{"list": [' || props || ']}' when 2 then '{"o": ' || props || ', "z": "a, }"}' else '{"o": ' || props || '}' end as fixed from events""")
def json_repair(spark, d):
    """Every event's properties as a model might give them: fenced, with a comma too many, brackets that are missing, keys out of order."""
    i, own = F.col("event_id") % 4, F.col("props")
    raw = F.when(i == 0, F.concat(F.lit("```json\n"), own, F.lit(",\n```"))).when(i == 1, F.concat(F.lit('Here: {"list": ['), own, F.lit("}")))
    raw = raw.when(i == 2, F.concat(F.lit('so {"z": "a, }", "o": '), own, F.lit(",} done"))).otherwise(F.concat(F.lit('{"o": '), own))
    return table(spark, d, "events").select("event_id", evaluate.repair_json(raw).alias("fixed"))


# Whole-corpus checks


@query(f"with {WINDOWS}, t as (select doc_id, sum(len(piece))::bigint as total from cw group by doc_id) select {STATS.replace('n_words', 'total')} from t")
def document_token_totals(spark, d):
    totals = chunking.windows(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("token_count").alias("total"))
    return profile.token_stats(totals, "total", 512)


@query()
def approximate_percentiles(spark, d):
    return profile.approximate(counted(spark, d), "n_words", [0.5, 0.9, 0.95, 0.99])


@query("select source, count(*) as n from (select *, row_number() over (partition by md5(text) order by doc_id) as r from documents) where r = 1 group by source")
def distinct_text_sources(spark, d):
    return profile.first_counts(table(spark, d, "documents"), F.md5("text"), "doc_id", "source")


@query("select sum(n)::bigint as n_rows, count(*) as n_documents, round(avg(n), 4) as rows_each, max(n) as most from (select conv_id, count(*) as n from conversations group by conv_id)")
def corpus_shape(spark, d):
    return profile.shape(table(spark, d, "conversations"), "conv_id")


@query("select conv_id, turn, role from conversations where conv_id = (select conv_id from conversations group by conv_id order by count(*) desc, conv_id limit 1)")
def longest_document(spark, d):
    return profile.longest(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id")


@query("select conv_id, role, turn, md5(text) as text_md5 from (select *, row_number() over (partition by conv_id, role order by turn desc) as n from conversations) where n = 1")
def latest_by_role(spark, d):
    last = profile.latest(table(spark, d, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], "turn")
    return last.select("conv_id", "role", "turn", F.md5("text").alias("text_md5"))


@query("select count(*) as n, count(*) filter (where trim(coalesce(lang, '')) = '') as missing_lang, count(*) filter (where trim(coalesce(source, '')) = '') as missing_source, count(*) filter (where trim(coalesce(text, ''), ' ') <> '' and length(text) < 50) as n_short, count(*) filter (where trim(coalesce(text, ''), ' ') = '') as n_without_text from documents")
def completeness_profile(spark, d):
    return profile.completeness(table(spark, d, "documents"), ["lang", "source"], "text")


TYPES = ["research-article", "Letter", "review-article", "news", None]


@query(f"""with {COUNTED}, k as (select *, {lst([t or '' for t in TYPES])}[(doc_id % 5 + 1)::int] as kind from t), w as (select *, case when lower(case when kind = '' then 'other' else kind end) in {tuple(T.DROPPED_TYPES)} then 'type' when coalesce(text, '') = '' then 'no_text' end as why from k)
select count(*) as n, count(*) filter (where why = 'type') as skipped_type, count(*) filter (where why = 'no_text') as skipped_no_text, count(*) filter (where why is null) as n_kept, count(*) filter (where why is null and n_words <= 512) as n_whole, count(*) filter (where why is null and n_words > 512) as n_split from w""")
def ingest_counters(spark, d):
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 5 + 1).cast("int"))
    skips = {"type": ~T.kept_type(kind), "no_text": F.coalesce("text", F.lit("")) == ""}
    return profile.counters(counted(spark, d), skips, {"whole": F.col("n_words") <= 512, "split": F.col("n_words") > 512})


@query("select doc_id, case when a < 50 then (case when trim(text) <> '' then 'body_fallback' end) else 'original' end as abstract_source, md5(case when a < 50 then (case when trim(text) <> '' then substring(text, 1, 500) end) else substring(text, 1, doc_id % 100) end) as text_md5 from (select *, length(substring(coalesce(text, ''), 1, doc_id % 100)) as a from documents)")
def abstract_fallback(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.abstract_or_body(F.col("text").substr(F.lit(1), (F.col("doc_id") % 100).cast("int")), F.col("text")).alias("a"))
    return own.select("doc_id", F.col("a.source").alias("abstract_source"), F.md5("a.text").alias("text_md5"))


@query(f"select term, count(*) as n from (select unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC\\pM]', 'a', 'g'), '\\b([A-Z]{{2,6}}(?:[/-][A-Z]{{1,4}})?)\\b', 1)) as term from documents) group by term order by n desc, term limit 40")
def top_abbreviations(spark, d):
    return profile.top_terms(table(spark, d, "documents"), T.abbreviations(F.col("text")), 40)


@query("select doc_id, regexp_matches(coalesce(text, ''), '" + T.STRUCTURED + "') as structured, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') as {k}" for k, p in T.PARTS.items()) + " from documents")
def abstract_structure(spark, d):
    return table(spark, d, "documents").select("doc_id", T.structure(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("select (select count(*) from documents) as n_chunks, (select count(*) from embeddings) as n_vectors, (select count(*) from documents join embeddings on doc_id = vec_id) as n_matched, (select count(*) from documents) = (select count(*) from embeddings) and (select count(*) from documents) = (select count(*) from documents join embeddings on doc_id = vec_id) as agrees")
def embedding_alignment(spark, d):
    return tables.alignment(table(spark, d, "documents"), _vectors(spark, d), "doc_id", "vec_id")


@query("select file, first_key from (select doc_id // 10 as file, min(doc_id) as first_key from documents group by file) where first_key in (select doc_id from labels)")
def checkpoint_rebuild(spark, d):
    own = table(spark, d, "documents").select(F.expr("doc_id div 10").alias("file"), "doc_id")
    return tables.finished_files(own, "file", "doc_id", table(spark, d, "labels"))


@query("select source, doc_id from (select *, row_number() over (partition by source order by doc_id) as n from documents) where n <= 3")
def head_each_file(spark, d):
    return tables.head_each(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("select user_id, ts::date as turn, pos, event_type as step, value from (select *, row_number() over (partition by user_id, ts::date order by ts, event_id) - 1 as pos from events) where event_type = 'error'")
def trace_flatten(spark, d):
    step = F.struct("ts", "event_id", F.col("event_type").alias("step"), "value")
    turns = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("turn")).agg(F.array_sort(F.collect_list(step)).alias("trace"))
    return sessions.flatten_traces(turns, "user_id", "turn", "trace", "error").select("user_id", "turn", "pos", "step", "value")


@query("select event_id, case when value > 50 then 'timeout' when event_id % 7 >= 5 then 'max_iterations' end as reason from events")
def termination_reason(spark, d):
    return table(spark, d, "events").select("event_id", sessions.terminated(F.col("value"), 50, F.col("event_id") % 7, 5).alias("reason"))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def run_dedup(spark, d):
    return sessions.first_each(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""select doc_id, sha256('search' || chr(31) || '{"lang":"' || lang || '","source":"' || source || '"}') as tool_key from documents""")
def tool_result_key(spark, d):
    arguments = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.tool_key(F.lit("search"), arguments).alias("tool_key"))


MEMO = "h as (select *, coalesce(floor(epoch(ts))::bigint - floor(epoch(lag(ts) over (partition by user_id, event_type order by ts, event_id)))::bigint <= 86400, false) as hit from events)"


@query(f"with {MEMO} select event_id, hit from h")
def memo_lookup(spark, d):
    return sessions.memo_hits(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "ts", 86400).select("event_id", "hit")


@query(f"with {MEMO} select event_type, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, round(count(*) filter (where hit) / count(*)::double, 4) as hit_rate from h group by event_type")
def cache_hit_rate(spark, d):
    return sessions.hit_rate(sessions.memo_hits(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "ts", 86400), by=("event_type",))


@query(f"select event_type, count(*) as n, count(*) filter (where value < 1) as n_errors, min(value) as least, {MEAN} as mean, max(value) as most from events group by event_type")
def batch_wall_stats(spark, d):
    return sessions.wall_stats(table(spark, d, "events"), F.col("value") < 1, "value", ("event_type",))


@query(f"with {FINAL}, e as (select query_id, chunk_id, chunk_id % 3 <> 1 as gone, count(*) filter (where chunk_id % 3 = 1) over (partition by query_id) as n_left from fin where final_rank <= 10) select query_id, chunk_id from e where not gone or n_left = 0")
def evidence_filter(spark, d):
    return evaluate.keep_evidence(_hits(spark, d).select("query_id", "chunk_id"), F.col("chunk_id") % 3 != 1)


@query(f"with {FINAL} select query_id, source, count(*) as n from fin where final_rank <= 10 group by all")
def context_sources(spark, d):
    return _hits(spark, d).groupBy("query_id", "source").agg(F.count("*").alias("n"))


@query(f"""with {BM25}, e as (select item_id as query_id, list_sort(list_distinct({tok('text')}))[1:4] as keywords from benchmark)
select kw.query_id, chunk_id, len(list_filter(keywords, lambda k: contains(lower(d.text), k))) as n_held, len(list_filter(keywords, lambda k: contains(lower(d.text), k))) >= 0.5 * len(keywords) as passes from kw join e on e.query_id = kw.query_id join documents d on doc_id = chunk_id where rank <= 3""")
def keyword_sanity(spark, d):
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, d, "documents")
    hits = tables.written(bm25.best(docs, asks, 3), "hits")
    top = hits.join(tables.fetched(docs.select("doc_id", "text"), hits, "doc_id", bm25.HELD), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    wanted = asks.select("query_id", F.slice(F.array_sort(F.array_distinct(T.tokens(F.col("query")))), 1, 4).alias("keywords"))
    return evaluate.keyword_sanity(top, wanted).select("query_id", "chunk_id", "n_held", "passes")


@query("""with w as (select doc_id, text, floor(length(text) * 0.9::double)::int as st from documents), t as (select *, substring(text, st + 1) as tail from w),
c as (select *, greatest(case when contains(tail, '。') then length(tail) - instr(reverse(tail), '。') else -1 end, case when contains(tail, '. ') then length(tail) - instr(reverse(tail), ' .') - 1 else -1 end, case when contains(tail, '.' || chr(10)) then length(tail) - instr(reverse(tail), chr(10) || '.') - 1 else -1 end) as cut from t)
select doc_id, md5(case when cut < 0 then text else regexp_replace(substring(text, 1, st + cut + 1), '\\s+$', '') end) as text_md5 from c""")
def sentence_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(evaluate.truncate_at_sentence(F.col("text"))).alias("text_md5"))


SPELLED = [" Patients with MI and BP.", " A heart attack ('MI') was noted.", " LDL or HDL"]


@query(f"""with a as (select doc_id, lower(text || {lst(SPELLED)}[(doc_id % 3 + 1)::int]) as t from documents), k as (select doc_id, t, term, expansions from a, {rows('term, expansions', SHORT)} where term <> 'or' and list_contains(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_-]+'), term)),
f as (select doc_id, term, len(list_filter(expansions, lambda e: contains(t, e))) = 0 as gone from k)
select a.doc_id, coalesce(string_agg(term, ',' order by term), '') as found, coalesce(string_agg(term, ',' order by term) filter (where gone), '') as missing, count(*) filter (where gone) = 0 as passes from a left join f on a.doc_id = f.doc_id group by a.doc_id""")
def abbreviation_check(spark, d):
    more = F.element_at(T.strings(SPELLED), (F.col("doc_id") % 3 + 1).cast("int"))
    spelled = table(spark, d, "documents").select("doc_id", F.concat("text", more).alias("text"))
    got = evaluate.abbreviation_report(spelled, spark.createDataFrame(SHORT, "term string, expansions array<string>"))
    return got.select("doc_id", F.array_join("found", ",").alias("found"), F.array_join("missing", ",").alias("missing"), "passes")


def facts_sql(c: str) -> str:
    return f"list_distinct(list_concat({', '.join(f"list_transform(regexp_extract_all({c}, '{_re(p)}'), lambda x: '{k}:' || regexp_replace(lower(x), '\\s', '', 'g'))" for k, p in evaluate.KEY_INFO.items())}))"


@query(f"with {CLAIMS}, f as (select {facts_sql('d.text')} as got, unnest({facts_sql('t')}) as fact from cl join documents d on d.doc_id = cl.doc_id) select split_part(fact, ':', 1) as kind, count(*) as n_reference, count(*) filter (where list_contains(got, fact)) as n_found, round(count(*) filter (where list_contains(got, fact)) / count(*)::double, 4) as recall from f group by kind")
def fact_recall(spark, d):
    both = claims(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return evaluate.fact_recall(both, "text", "t")


@query(f"with {ANSWER}, {CITED}, v as (select doc_id, list_sort(list_filter(list_distinct(ids), lambda i: i > 3)) as bad, len(ids) = 0 as none from c) select doc_id, concat_ws(chr(10), case when len(bad) > 0 then 'These citations have no source, so remove or correct them: ' || array_to_string(list_transform(bad, lambda i: '[来源 ' || i || ']'), ', ') end, case when none then 'Cite a source as [来源 N] for every claim.' end) as note from v")
def retry_instruction(spark, d):
    out = evaluate.check_citations(answers(spark, d), F.lit(3), F.lit(False), "answer")
    return out.select("doc_id", evaluate.retry_note(F.col("invalid_ids"), F.col("missing_citations")).alias("note"))


@query(f"""select c.query_id, cleaned, language, lo, hi, section, keyword_query from ({SQL['query_clean']}) c join ({SQL['query_translate']}) t on t.query_id = c.query_id join ({SQL['query_time_filter']}) y on y.query_id = c.query_id
 left join ({SQL['query_imrad_vote']}) s on s.query_id = c.query_id join ({SQL['query_keyword']}) k on k.query_id = c.query_id""")
def query_process(spark, d):
    kind = "term string, expansions array<string>"
    out = understanding.understand(asked(spark, d), spark.createDataFrame([], kind), spark.createDataFrame(ALIKE, kind), NOW)
    return out.select("query_id", "cleaned", "language", "lo", "hi", "section", "keyword_query")


def understood(spark, asks):
    kind = "term string, expansions array<string>"
    return understanding.understand(asks, spark.createDataFrame(SHORT, kind), spark.createDataFrame(ALIKE, kind), NOW, CHINESE, CLASSES)


ENGLISH = "replace(replace(replace(query, '糖尿病', 'diabetes'), '血压', 'blood pressure'), '糖尿病足', 'diabetic foot')"
CLEANED = "(select query_id, cleaned as query from c)"
LATIN = "(select query_id, regexp_replace(cleaned, '[^\\x00-\\x7F]', 'z', 'g') as query from c)"  # a letter of any script is part of a word
UNDERSTOOD = f"""with c as (select query_id, raw, {CLEAN} as cleaned from (select query_id, query as raw, {ENGLISH} as query from {Q})),
words as (select query_id, regexp_extract_all(lower(cleaned), '[\\p{{L}}\\p{{N}}_''-]+') as ws from c),
ab as (select query_id, term, expansions, list_position(ws, term) as place from words, {rows('term, expansions', SHORT)} where list_contains(ws, term)),
sy as (select query_id, term, min(place) as place, any_value(expansions) as expansions from (select query_id, term, expansions, 0 as place from c, {rows('term, expansions', ALIKE)} where contains(lower(cleaned), term)
 union all select f.query_id, term, a.expansions, 1 from (select query_id, unnest(expansions) as term from ab) f join {rows('term, expansions', ALIKE)} a using (term)) group by query_id, term),
la as (select query_id, string_agg(term || '=' || array_to_string(expansions, '|'), ';' order by place, term) as abbreviations, flatten(list(expansions order by place, term)) as x from ab group by query_id),
ls as (select query_id, string_agg(term || '=' || array_to_string(expansions, '|'), ';' order by place, term) as synonyms, flatten(list(expansions order by place, term)) as x from sy group by query_id),
en as (select query_id, string_agg(kind || '=' || found, ';' order by kind) as entities from ({SQL['query_entities'].replace(Q, LATIN)}) group by query_id),
ex as (select c.*, coalesce(abbreviations, '') as abbreviations, coalesce(synonyms, '') as synonyms, coalesce(entities, '') as entities, list_concat(coalesce(la.x, []), coalesce(ls.x, [])) as x from c left join la using (query_id) left join ls using (query_id) left join en using (query_id)),
ey as (select *, list_filter(x, lambda v, i: list_position(x, v) = i) as own from ex), ez as (select *, list_filter(own, lambda v: not contains(lower(cleaned), lower(v))) as more from ey)
select ez.query_id, cleaned, language, entities, abbreviations, synonyms, array_to_string(own, '|') as expanded_terms, '{understanding.PREFIX}' || raw as vector_query, case when len(more) = 0 then cleaned else cleaned || ' ' || array_to_string(more, ' ') end as keyword_query, lo, hi, section
from ez join ({SQL['query_translate']}) t using (query_id) join ({SQL['query_time_filter'].replace(Q, CLEANED)}) y using (query_id) left join ({SQL['query_imrad_vote'].replace(Q, CLEANED)}) s using (query_id)"""


@query(UNDERSTOOD)
def query_understand(spark, d):
    listed = lambda m, sep: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], sep))), ";")
    kinds = F.map_from_entries(F.array_sort(F.map_entries(F.transform_values("entities", lambda _, v: F.array_sort(v)))))
    return understood(spark, asked(spark, d)).withColumns({"entities": listed(kinds, ","), "abbreviations": listed(F.col("abbreviations"), "|"), "synonyms": listed(F.col("synonyms"), "|"), "expanded_terms": F.array_join("expanded_terms", "|")})


OWN = "(select item_id as query_id, text as query from benchmark)"
ASKED_SO = f"q as (select query_id, term, count(*) as times from (select query_id, unnest({tok('keyword_query')}) as term from un) group by all)"
NEAR_SO = "from (select item_id, v, lo, hi from benchmark join v on vec_id = item_id join un on un.query_id = item_id) a, v b where lo is null or 2000 + b.vec_id % 25 between lo and hi)"
HYBRID_SO = FINAL.replace(f"q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({tok('text')}) as term from benchmark) group by all)", ASKED_SO).replace("from (select item_id, v from benchmark join v on vec_id = item_id) a, v b)", NEAR_SO)


@query(f"with un as ({UNDERSTOOD.replace(Q, OWN)}), {HYBRID_SO} select query_id, chunk_id, final_score, final_rank from fin where final_rank <= 10")
def hybrid_understood(spark, d):
    embeddings, asks = _vectors(spark, d).select(F.col("vec_id").alias("chunk_id"), "embedding"), hybrid_queries(spark, d)
    known = tables.written(understood(spark, asks), "understood")  # understood once, read by both paths
    path = tables.workspace(spark, "bm25")
    bm25.save(chunk_table(spark, d), path, key="chunk_id")
    hits = retrieval.retrieve(chunk_table(spark, d), embeddings, asks, NOW, authority=STANDING, understood=known, index=bm25.load(spark, path))
    return hits.select("query_id", "chunk_id", "final_score", "final_rank")


# Texts to vectors


ASCII = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def hashed(c: str) -> str:
    """SQL: how often each word stands, and its place and sign."""
    return f"select id, sum(case when ('0x' || substr(md5(w), 9, 1))::bigint % 2 = 1 then -1 else 1 end)::double as v, ('0x' || substr(md5(w), 1, 8))::bigint % 128 as i from (select id, unnest(regexp_extract_all({ASCII.format(c)}, '[a-z0-9]+')) as w from x) group by all having v <> 0"


SHAPE = """n as (select id, sqrt(sum(v * v)) as norm, count(*) as n, sum(v * (i + 1)) as m from h group by id),
s as (select x.id, coalesce(n.n, 0) as n_used, round(coalesce(m / n.norm, 0), 5) as moment, case when n.n is null then 0.0::double else 1.0 end as norm from x left join n on n.id = x.id)"""


def shape(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """What is compared of a vector: components that aren't zero, a weighted sum, the length."""
    weighted = F.aggregate(F.transform(vector, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select(key, F.size(F.filter(vector, lambda v: v != 0)).cast("long").alias("n_used"), F.round(weighted, 5).alias("moment"), F.round(F.sqrt(vectors.dot(F.col(vector), F.col(vector))), 6).alias("norm"))


@query(f"with x as (select doc_id as id, text from documents), h as ({hashed('text')}), {SHAPE} select id as doc_id, n_used, moment, norm from s")
def embed_documents(spark, d):
    return shape(embedding.embed_documents(table(spark, d, "documents"), kind="double"), "doc_id", "embedding")


@query(f"with x as (select item_id as id, '{embedding.INSTRUCTION}' || trim(text) as text from benchmark where trim(text) <> ''), h as ({hashed('text')}), {SHAPE} select id as item_id, n_used, moment, norm from s")
def embed_queries(spark, d):
    asks = table(spark, d, "benchmark").where(F.trim("text") != "")
    return shape(embedding.embed_queries(asks, "text", kind="double"), "item_id", "query_vector")


@query("select vec_id, label::varchar as batch, embedding[1]::double as first, embedding[len(embedding)]::double as last, len(embedding)::bigint as n from embeddings where label <> 3")
def vector_files(spark, d):
    rows, _ = vectorfiles.read_pairs(spark, _vector_pairs(spark, d))
    return rows.select("vec_id", F.col("stem").alias("batch"), F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"), F.size("embedding").cast("long").alias("n"))


@query("select label::varchar as batch, count(*) as n_rows, case when label = 3 then count(*) - 1 else count(*) end as n_vectors, label <> 3 as used from embeddings group by label")
def vector_files_report(spark, d):
    return vectorfiles.read_pairs(spark, _vector_pairs(spark, d))[1].withColumnRenamed("stem", "batch")


def _vector_pairs(spark, d) -> str:
    """All embeddings as pairs of files, a pair a label; then the matrix of label 3 once more, without its last row."""
    path, rows = tables.workspace(spark, "pairs"), _vectors(spark, d).withColumn("label", F.col("label").cast("string"))
    vectorfiles.write_pairs(rows, path, "label", "vec_id")
    last = rows.where("label = '3'").agg(F.max("vec_id").alias("last"))
    short = rows.where("label = '3'").crossJoin(F.broadcast(last)).where("vec_id < last").drop("last")  # one row
    vectorfiles.write_pairs(short, path, "label", "vec_id", matrices_only=True)
    return path


@query(SQL["embed_documents"])
def embedding_stream(spark, d):
    """Both phases twice: the second time there is nothing new."""
    path, rows = tables.workspace(spark, "embedding"), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    for _ in range(2):
        streamed.embed_stream(spark, f"{d}/documents.parque[t]", rows.schema, f"{path}/staged", f"{path}/one", key="doc_id", kind="double").awaitTermination()
        staged = spark.read.parquet(f"{path}/staged").drop("batch").schema
        streamed.load_stream(spark, f"{path}/staged", staged, f"{path}/index", f"{path}/two", key="doc_id").awaitTermination()
    return shape(tables.read_index(spark, f"{path}/index", "doc_id"), "doc_id", "embedding")


@query("""select doc_id, md5(case when doc_id % 100 = 7 then 'new ' || coalesce(text, '') when doc_id % 50 = 3 then 'twice' else coalesce(text, '') end) as text_md5 from documents union all select -1 - doc_id, md5('added') from documents where doc_id % 200 = 9""")
def index_upsert(spark, d):
    """All documents, then three batches: a hundredth replaced, others replaced twice, some added."""
    path, rows = tables.workspace(spark, "index"), table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tables.write_index(rows, path, "doc_id")
    tables.write_index(rows.where("doc_id % 50 = 3").withColumn("text", F.lit("once")), path, "doc_id")
    changed = rows.where("doc_id % 100 = 7").withColumn("text", F.concat(F.lit("new "), "text"))
    added = rows.where("doc_id % 200 = 9").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("added").alias("text"))
    tables.write_index(changed.unionByName(added).unionByName(rows.where("doc_id % 50 = 3").withColumn("text", F.lit("twice"))), path, "doc_id")
    return tables.read_index(spark, path, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


# Whole ways: ingest, generation, sketches

INGESTED = f"d as (select doc_id, doc_id % 10 as m, len({wrd('text')}) as n, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as chars from documents)"


@query(f"""with {INGESTED} select count(*) as n, count(*) filter (where m = 9) as skipped_no_file, count(*) filter (where m = 8) as skipped_no_parse, count(*) filter (where m = 7) as skipped_type, count(*) filter (where m < 7) as n_parsed,
 count(*) filter (where m < 7 and m <> 5) as n_with_pmid, count(*) filter (where m < 7) as n_a, 0::bigint as n_b, count(*) filter (where m < 7 and chars > 30 and n + 1 <= 512) as n_c, count(*) filter (where m < 7 and n + 1 > 512) as n_split_bodies from d""")
def ingest_run(spark, d):
    """Documents as article files, some missing, broken or of a type that is left out, by their manifest to chunks."""
    docs = table(spark, d, "documents").withColumn("m", F.col("doc_id") % 10).withColumn("pmc_id", F.concat(F.lit("PMC"), F.col("doc_id")))
    manifest = docs.select("pmc_id", F.when(F.col("m") == 5, "0").when(F.col("doc_id") % 2 == 1, F.concat(F.lit(" 77"), F.col("doc_id"))).alias("pmid_csv"))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x0B\\x0C]", " "), "[\\x00-\\x08\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]", "?")
    body_ = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pmid = F.when((F.col("doc_id") % 2 == 0) & (F.col("m") != 5), F.concat(F.lit('<article-id pub-id-type="pmid">1'), F.col("doc_id"), F.lit("</article-id>"))).otherwise("")
    head = F.concat(F.lit('<article article-type="'), F.when(F.col("m") == 7, "Letter").otherwise("research-article"), F.lit('"><front><article-meta>'), pmid, F.lit("<abstract>An abstract that is long enough to be kept as it is, whatever follows.</abstract></article-meta></front>"))
    xml = F.concat(head, F.lit("<body><sec><title>2. Methods</title><p>"), body_, F.when(F.col("m") == 8, "</q>").otherwise("</p></sec></body></article>"))
    files = docs.where("m <> 9").select(F.col("pmc_id").alias("stem"), F.concat(F.lit("/articles/"), "pmc_id", F.lit(".xml")).alias("path"), xml.alias("content"))
    return plan_ingest.run(manifest, files, tables.workspace(spark, "ingest")).drop("n_d")


STAGED = """p as (select item_id as query_id, item_id % 5 as m, regexp_replace(substring(text, 1, 20), '^\\s+|\\s+$', '', 'g') as p from benchmark)"""


@query(f"""with {STAGED} select query_id, case m when 0 then p || ' [来源 1]' when 1 then p || ' [来源 1] Revised ' when 2 then p || ' ' when 3 then null else p || ' [来源 1]' end as answer, case m when 1 then 1 when 2 then 3 else 0 end as attempts, m not in (2, 3) as passes,
 case when m = 4 then '1,2,3' else '1,2' end as valid_ids, case m when 0 then 'true,true,true,true' when 1 then 'true,true,true,true' when 2 then 'true,true,false,false' when 3 then 'true,false' else 'false,true,true,true' end as stages, case when m = 3 then 'out of reach' end as error from p""")
def generation_staged(spark, d):
    """Four stages with a scripted generator: some cite well, some when told, some never, some fail."""
    block = lambda i: F.struct(F.lit(i).alias("citation_id"), F.concat(F.lit(f"[来源 {i}]\n"), "text").alias("block"))
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array(*map(block, (1, 2, 3))).alias("blocks"))
    out = generation.staged(asks, generation.scripted)
    return out.select("query_id", "answer", "attempts", "passes", F.array_join("valid_ids", ",").alias("valid_ids"), F.array_join(F.transform("stages", lambda s: s["ok"].cast("string")), ",").alias("stages"), "error")


@query("select unnest([0.5, 0.9, 0.95, 0.99]) as share, true as is_within")
def sketch_percentiles(spark, d):
    """Quantiles of words from sketches a source, merged; and whether their true ranks, counted exactly, are within the error that is promised."""
    rows_ = counted(spark, d)
    found = sketches.quantiles(sketches.merged(sketches.batches(rows_, "source", "n_words", "text")), [0.5, 0.9, 0.95, 0.99])
    ranks = rows_.select("n_words").crossJoin(F.broadcast(found)).groupBy("share").agg((F.count_if(F.col("n_words") < F.col("value")) / F.count("*")).alias("lo"), (F.count_if(F.col("n_words") <= F.col("value")) / F.count("*")).alias("hi"))  # four rows
    return ranks.select("share", ((F.col("lo") - sketches.RANK_ERROR <= F.col("share")) & (F.col("share") <= F.col("hi") + sketches.RANK_ERROR)).alias("is_within"))


@query("select lang, count(*) as n, count(distinct coalesce(text, '')) as n_exact, true as is_within from documents group by lang")
def sketch_distinct(spark, d):
    """Distinct texts by language from sketches a source, merged, beside the exact number."""
    rows_ = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_words", F.lit(0))
    kept = rows_.withColumn("batch", F.struct("lang", "source"))
    sketch = sketches.merged(sketches.batches(kept, "batch", "n_words", "text").withColumn("lang", F.col("batch.lang")), ("lang",))
    exact = rows_.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_exact"))
    return sketches.distinct(sketch, ("lang",)).join(exact, "lang").select("lang", "n", "n_exact", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= 1 + F.col("n_exact") * sketches.COUNT_ERROR).alias("is_within"))


@query(f"with y as ({SQL['query_time_filter']}) select query_id, case when lo is null or hi is null then null when lo = hi then '{{\"pub_year\": {{\"$eq\": ' || lo || '}}}}' else '{{\"$and\": [{{\"pub_year\": {{\"$gte\": ' || lo || '}}}}, {{\"pub_year\": {{\"$lte\": ' || hi || '}}}}]}}' end as filter from y")
def query_filter_dictionary(spark, d):
    found = asked(spark, d).select("query_id", understanding.time_range(F.col("query"), NOW).alias("t"))
    return found.select("query_id", understanding.time_filter(F.col("t.lo"), F.col("t.hi")).alias("filter"))


@query(f"with {HYBRID} select query_id, chunk_id, case when vector_rank is null then 'keyword' when keyword_rank is null then 'vector' else 'vector,keyword' end as sources from m")
def fusion_sources(spark, d):
    return _merged(spark, d).select("query_id", "chunk_id", F.array_join("sources", ",").alias("sources"))


@query(f"with {COUNTED}, c as (select least(n_words, 9999) as v from t), b as (select unnest(range(4)) as bucket, unnest([0, 128, 512, 1024]) as lo, unnest([128, 512, 1024, 9999]) as hi) select bucket::int as bucket, lo, hi, (select count(*) from c where v > lo and v <= hi) as n from b")
def token_histogram_closed(spark, d):
    return profile.histogram_to(counted(spark, d), "n_words", [0, 128, 512, 1024, 9999], most=9999)


@query(f"with {COUNTED}, y as (select *, 1940 + doc_id % 100 as pub_year from t) select count(*) as n, count(*) filter (where trim(coalesce(lang, '')) = '') as n_missing_lang, count(*) filter (where trim(coalesce(source, '')) = '') as n_missing_source, count(*) filter (where trim(coalesce(text, '')) = '') as n_no_text, count(*) filter (where pub_year not between 1950 and 2025) as n_bad_year, count(*) filter (where n_words not between 1 and 1024) as n_bad_tokens, count(*) filter (where trim(coalesce(lang, '')) <> '' and trim(coalesce(source, '')) <> '' and trim(coalesce(text, '')) <> '' and pub_year between 1950 and 2025 and n_words between 1 and 1024) as n_sound from y")
def row_quality(spark, d):
    return profile.row_quality(counted(spark, d).withColumn("pub_year", 1940 + F.col("doc_id") % 100), ["lang", "source"], "text", "pub_year", "n_words")


@query("""with c as (select 'source' as field, source as member, count(*) as n from documents where source is not null group by source union all select 'lang', lang, count(*) from documents where lang is not null group by lang union all select 'year', (2000 + doc_id % 25)::varchar, count(*) from documents group by 2),
r as (select *, row_number() over (partition by field order by n desc, member) as place from c) select field, member, n, place from r where field <> 'source' or place <= 3""")
def quality_tops(spark, d):
    return profile.tops(table(spark, d, "documents").withColumn("year", 2000 + F.col("doc_id") % 25), {"source": 3, "lang": None, "year": None})


@query("select doc_id, md5(coalesce(text, '')) as text_md5, rank() over (order by doc_id) as place from documents join labels using (doc_id)")
def point_lookup(spark, d):
    """Documents of a list of keys, those that have a label, each with its place in the list."""
    ids = generation.indexed(table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi"), "doc_id")
    return tables.lookup(table(spark, d, "documents"), ids.withColumn("place", F.col("index") + 1), "doc_id").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "place")


NEAR = "case when len(a.w) > 0 and len(b.w) > 0 then len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double else 0 end"
SQL["context_greedy_dedup"] = f"""with recursive {FINAL}, h as (select query_id, chunk_id, {wset('text')} as w, row_number() over (partition by query_id order by final_score desc, chunk_id) as i from fin where final_rank <= 10),
nb as (select a.query_id, a.i, list(b.i) as near from h a join h b on a.query_id = b.query_id and b.i < a.i and {NEAR} >= 0.3 group by all),
g as (select query_id, 0::bigint as i, []::bigint[] as kept from h group by query_id union all
 select g.query_id, g.i + 1, case when list_has_any(g.kept, coalesce(nb.near, [])) then g.kept else list_append(g.kept, g.i + 1) end from g join h on h.query_id = g.query_id and h.i = g.i + 1 left join nb on nb.query_id = g.query_id and nb.i = g.i + 1)
select h.query_id, chunk_id from h join (select query_id, unnest(max_by(kept, i)) as i from g group by query_id) k on k.query_id = h.query_id and k.i = h.i"""


@query(SQL["context_greedy_dedup"])
def context_dedup_links(spark, d):
    return context.drop_near_duplicates_by_links(tables.written(_hits(spark, d).select("query_id", "chunk_id", "final_score", "text"), "hits"), 0.3).select("query_id", "chunk_id")


@query("select vec_id, round(embedding[1]::double / sqrt(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))), 9) as first, round(1 / (1 + exp(-embedding[1]::double)), 9) as squashed from embeddings")
def embedding_normalized(spark, d):
    v = F.col("embedding")
    return _vectors(spark, d).select("vec_id", F.round(vectors.normalized(v)[0], 9).alias("first"), F.round(fusion.sigmoid(v[0].cast("double")), 9).alias("squashed"))


@query(f"""with {INGESTED.replace("doc_id % 10 as m", "doc_id % 4 as m, lang, source")} select doc_id, case m when 0 then '2001-03-04' when 1 then (2000 + doc_id % 25) || '-07-01' when 2 then '1999-01-01' end as pub_date, chars::int as body_chars, 2 as n_keywords, lang || ',' || source as keywords, source as journal from d where m <> 3 or doc_id % 8 = 3""")
def article_profile(spark, d):
    """Documents as articles with dates of several kinds, some without a year, some without a front, profiled."""
    docs = table(spark, d, "documents").withColumn("m", F.col("doc_id") % 4)
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x0B\\x0C]", " "), "[\\x00-\\x08\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]", "?")
    body_ = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    date = F.when(F.col("m") == 0, '<pub-date pub-type="collection"><year>2010</year></pub-date><pub-date pub-type="epub"><year>2001</year><month>3</month><day>4</day></pub-date>')
    date = date.when(F.col("m") == 1, F.concat(F.lit('<pub-date pub-type="epub"><month>9</month></pub-date><pub-date pub-type="ppub"><year>'), 2000 + F.col("doc_id") % 25, F.lit("</year><month>7</month><day>first</day></pub-date>")))
    date = date.when(F.col("m") == 2, '<pub-date pub-type="collection"><year>1999</year></pub-date>').otherwise("")
    words = F.concat(F.lit("<kwd-group><kwd>"), "lang", F.lit("</kwd><kwd> </kwd><kwd>"), "source", F.lit("</kwd></kwd-group><journal-title>"), "source", F.lit("</journal-title>"))
    front = F.when((F.col("m") != 3) | (F.col("doc_id") % 8 == 3), F.concat(F.lit("<front>"), date, words, F.lit("</front>"))).otherwise("")
    files = docs.select(F.col("doc_id").alias("path"), F.concat(F.lit("<article>"), front, F.lit("<body>"), body_, F.lit("</body></article>")).alias("content"))
    found = markup.profile_articles(files.withColumn("path", F.col("path").cast("string")))
    return found.select(F.col("path").cast("long").alias("doc_id"), "pub_date", "body_chars", F.size("keywords").alias("n_keywords"), F.array_join("keywords", ",").alias("keywords"), "journal")


@query(f"""with {FINAL}, l as (select query_id, string_agg('[' || final_rank || '] Document ' || chunk_id || ' — ' || source || ' (' || (2000 + chunk_id % 25) || '), ' || chunk_id, chr(10) order by final_rank) as ls from fin where final_rank <= 3 group by query_id)
select query_id, 'An answer.' || chr(10) || chr(10) || 'References' || chr(10) || ls || chr(10) || chr(10) || 'No advice.' as answer from l""")
def answer_references(spark, d):
    """An answer with its list of sources and a disclaimer, from each question's three best hits."""
    entry = F.struct(F.col("final_rank").alias("citation_id"), F.concat(F.lit("Document "), "chunk_id").alias("title"), "journal", "pub_year", F.col("chunk_id").cast("string").alias("chunk_id"))
    lists = _hits(spark, d, 3).groupBy("query_id").agg(F.collect_list(entry).alias("entries"))
    return lists.select("query_id", evaluate.with_references(F.lit("An answer."), F.col("entries"), "No advice.").alias("answer"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_rrf_rerank(spark, sf_dir)
