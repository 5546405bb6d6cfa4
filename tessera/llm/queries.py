"""The queries opN_* over the test tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import through_archives

    return through_archives(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.train(pii.labelled_table(spark))))


def toxicity_model(docs: DataFrame, labels: DataFrame):
    """The classifier, from the labels that are not held out."""
    from . import toxicity

    return toxicity.train(docs, labels.filter(~toxicity.held_out("doc_id")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The vocabulary file of the queries; a parameter of the operator.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    found = pieces.encode(table(spark, sf_dir, "documents"), pieces.read_model(MODEL_PATH), check=True)
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "same", "ids")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.digest(suffix.without_repeats(table(spark, sf_dir, "documents")))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_plan

    return shard_plan(table(spark, sf_dir, "documents"), shards=8)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mips import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_nearest": op2_nearest,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_pieces": op6_pieces,
    "op7_mix": op7_mix,
    "op8_repeats": op8_repeats,
    "op9_shards": op9_shards,
    "op10_topk": op10_topk,
}

ORACLE_SQL = {
    "op1_near_duplicates": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then []
    when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end as ss from w),
x as (select doc_id, unnest(ss) as sh from s),
n as (select doc_id, len(ss)::bigint as n from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as m from x a join x b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * m >= 85 * (na.n + nb.n - m)),
r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join e on r.b = e.a)
select n.doc_id, n.n as n_shingles, min(r.b) as component_id, n.doc_id = min(r.b) as kept
from n join r on r.a = n.doc_id group by n.doc_id, n.n
""",
    "op3_warc": r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first, count(*) over (partition by h) as n from p)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::int, 1)), '') as payload_digest,
  case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from f
""",
    "op7_mix": r"""
with sized as (
  select doc_id, case when source is null then 'b' else 'a' || source end as k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
src as (select k, sum(size)::bigint as s, [5, 2, 1][((row_number() over (order by k) - 1) % 3 + 1)::int] as w from sized group by k),
cum as (
  select *, 2.0::double * s / w as r, 1.5::double * sum(s) over () as b, sum(w) over () as all_w,
         sum(2.0::double * s) over (order by 2.0::double * s / w) as cm, sum(w) over (order by 2.0::double * s / w) as cw from src),
cand as (
  select (select any_value(b) / any_value(all_w) from cum) as level, 0.0::double as upto, 0 as n
  union all select (b - cm) / nullif(all_w - cw, 0), r, 1 from cum),
lev as (select min(level) as level from (
  select level, upto from cand c where level is not null
   and not exists (select 1 from cum where cum.r > c.upto and cum.r <= c.level)
  order by upto limit 1)),
goal as (select k, s, least(2.0::double * s, w * coalesce(level, 1e300))::double as target from src, lev),
run as (
  select z.*, g.s, g.target, case when g.s > 0 then floor(g.target / g.s)::bigint else 0 end as f,
         sum(size) over (partition by z.k order by h) as upto, sum(size) over (partition by z.k, h) as tie
  from sized z join goal g using (k)),
cut as (select *, floor(target - f * s)::bigint as remain from run)
select doc_id, size, s as source_size, target,
  (size * f + case when upto <= remain then size
                   when upto - tie <= remain and tie > 0 then floor(size * ((remain - (upto - tie))::double / tie))::bigint else 0 end)::bigint as taken
from cut
""",
    "op10_topk": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and vec_id is not null),
p as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
""",
}
