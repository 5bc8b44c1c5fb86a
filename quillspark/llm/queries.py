"""One query for each operator of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import workspace
from . import ann, collocations, embedding_dedup, linededup, packing, secrets, sentencepiece_codec, sharding, simhash, suffix_dedup, toxicity, vector_codes, warc
from .common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), PIECES)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTES)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), path)
    return warc.page_report(warc.read(spark, path, payloads=False))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_ann, op2_line_dedup, op3_embedding_dedup, op4_sentencepiece, op5_best_fit_packing, op6_suffix_dedup, op7_toxicity, op8_sharding, op9_secret_scan, op10_simhash_dedup, op11_warc, op12_vector_codes, op13_collocations)}


LINES = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
g as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, g.keeper is not null and k.doc_id <> g.keeper as gone from k left join g on k.key = g.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id"""

VECTORS = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.9),
r as (select vec_id, vec_id as c from u union select r.vec_id, l.b from r join l on r.c = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, coalesce(min(r.c), e.vec_id) as component_id,
       e.vec_id = coalesce(min(r.c), e.vec_id) as kept
from embeddings e left join r on r.vec_id = e.vec_id group by e.vec_id"""


PAGES = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select h, max(page_id) as top from p where strlen(h) >= 1000 group by h)
select page_id, strlen(p.h)::bigint as payload_bytes, sha1(p.h) as payload_digest, case when page_id <> top then 'revisit' else 'response' end as record_type,
       case when page_id <> top then top end as refers_to
from p left join g on p.h = g.h"""


def _moved(i: int) -> str:
    """Codebooks after one more round: for each part and entry its components; sums are floored by hand, as // rounds towards zero."""
    return f"""a{i} as ({_assigned(i)}),
m{i} as (select p, e, list(c order by j) as c from (select p, e, j, (s - ((s % n) + n) % n) // n as c from (select p, e, j, sum(x)::hugeint as s, count(*) as n from (select p, e, unnest(c) as x, unnest(range(len(c))) as j from a{i}) group by all)) group by all),
b{i + 1} as (select b.p, b.e, coalesce(m.c, b.c) as c from b{i} b left join m{i} m on b.p = m.p and b.e = m.e)"""


def _assigned(i: int) -> str:
    return f"select id, p, e, c, d from (select x.id, x.p, b.e, x.c, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d, row_number() over (partition by x.id, x.p order by d, b.e) as r from parts x join b{i} b using (p)) where r = 1"


CODES = f"""
with k as (select row_number() over (order by vec_id nulls last) - 1 as id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as c from k, range(16) t(p)),
b0 as (select p, id as e, c from parts where id < 64),
{_moved(0)}, {_moved(1)}, a2 as ({_assigned(2)}),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b2),
r as (select id, string_agg(lower(printf('%02x', e)), '' order by p) as code, sum(d)::bigint as error from a2 group by id),
s as (select k.vec_id, k.label, code, error from r join k using (id))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from s, books"""

PHRASES = """
with d as (select doc_id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') as ws from (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d)),
sizes as (select lang, sum(len(ws))::bigint as n from p group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase from p, range(1, 4) t(k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 10),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1),
halves as (select c.*, j, array_to_string(ws[1 : j], ' ') as left_, array_to_string(ws[j + 1 : k], ' ') as right_ from c, range(1, 3) t(j) where j < k),
cuts as (select h.*, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score from halves h join f x on x.lang = h.lang and x.phrase = left_ join f y on y.lang = h.lang and y.phrase = right_),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) as nth from cuts) where nth = 1),
inside as (select lang, phrase, max(a) as m from (select lang, a, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) as phrase from c where k = 3) group by all),
kept as (select best.* from best left join inside i on i.lang = best.lang and i.phrase = best.phrase where m is null or 100 * m < 50 * a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select o.lang, rank, phrase, a, l, r, n, score from o join sizes using (lang) where rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINES, "op3_embedding_dedup": VECTORS, "op11_warc": PAGES, "op12_vector_codes": CODES, "op13_collocations": PHRASES}
