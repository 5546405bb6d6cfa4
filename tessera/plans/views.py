"""The test tables as records, pairs, addresses, vectors and id lists; in Spark and in SQL, each the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators.keys import CAND, PAIR, S1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from documents, of whole texts: side by id; the name ends with the first sentence or line, all the rest is
    the address."""
    side = F.when(F.col("doc_id") % 5 == 0, "S1").when(F.col("doc_id") % 5 < 3, "S2").otherwise("S3")
    name = F.regexp_extract("text", r"^[^.!?\n]*[.!?\n]?", 0)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entity_id"), side.alias("side"), F.col("lang").alias("country"), name.alias("name"), F.col("text").substr(F.char_length(name) + 1, F.char_length("text")).alias("address")
    )


def keyed_rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec with what blocking needs."""
    return rec(spark, sf_dir).withColumns({"name_tokens": text.tokenize(F.lower("name")), "address_normalized": F.lower("address")})


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return records.filter("side = 'S1'"), records.filter("side <> 'S1'")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and labelled pairs from line items."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") % 1000 / 1000.0
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias(S1), F.col("l_partkey").alias(CAND))
    found = grouped.agg(F.max(cents).alias("score"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    ce = (F.col(S1) * 104729 + F.col(CAND) * 7919) % 1000 / 1000.0
    return found.select(*PAIR, (F.col(S1) % 3).cast("string").alias("country"), "score", "label", ce.alias("ce"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs: those with label 1 and, beyond the candidates, one that was never retrieved for each 50th record."""
    p = pairs(spark, sf_dir)
    more = p.filter(F.col(S1) % 50 == 0).select(S1, (F.col(S1) + 10_000_000).alias("matched_id")).distinct()
    return p.filter("label = 1").select(S1, F.col(CAND).alias("matched_id")).unionByName(more)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reference records (orders, those without pairs included) with their number of true pairs."""
    s1 = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(S1), (F.col("o_orderkey") % 3).cast("string").alias("country"))
    n = truth(spark, sf_dir).groupBy(S1).agg(F.count("*").cast("int").alias("n_true"))
    return s1.join(n, S1, "left").na.fill(0, ["n_true"])


def addr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with house numbers, missing ones included."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    key = F.col("c_custkey")
    line = F.concat((key % 97).cast("string"), F.lit(" "), F.lower("c_mktsegment"), F.lit(" street, suite "), (key % 7).cast("string"), F.lit(", "), F.lower("n_name"), F.lit(", region "), F.col("r_regionkey").cast("string"))
    return joined.select(key.alias("entity_id"), F.when(key % 31 != 0, line).alias("address"), F.col("r_name").alias("country"), F.col("c_name").alias("name"))


def addr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring addresses as pairs, with both sides' tokens."""
    a = addr(spark, sf_dir).select(F.col("entity_id").alias(S1), F.col("address").alias("a"))
    b = addr(spark, sf_dir).select((F.col("entity_id") - 97).alias(S1), F.col("entity_id").alias(CAND), F.col("address").alias("b"))
    return a.join(b, S1)


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("country"), (F.col("vec_id") % 5 == 0).alias("is_source1"), "embedding")


def id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id-list file with one error of each kind: rows (S1, ids)."""
    p = pairs(spark, sf_dir)
    name = lambda c: F.concat(F.when(c % 2 == 0, "S2-").otherwise("S3-"), c.cast("string"))
    lists = p.filter("label = 1").groupBy(S1).agg(F.array_join(F.array_sort(F.collect_list(name(F.col(CAND)))), ",").alias("ids"))
    k = F.col(S1)
    broken = F.when(k % 101 == 0, F.concat("ids", F.lit(",S1-7"))).when(k % 103 == 0, F.concat("ids", F.lit(",X9-1"))).when(k % 107 == 0, F.concat("ids", F.lit(","), "ids")).otherwise(F.col("ids"))
    rows = p.select(S1).distinct().join(lists.withColumn("ids", broken), S1, "left").na.fill("", ["ids"])
    return rows.filter(k % 109 != 0).unionByName(rows.filter(k % 113 == 0)).select(k.cast("string").alias(S1), "ids")


# ---- the same in SQL --------------------------------------------------------------------------------------------------

#: ASCII white space and punctuation but the underscore, for a tokenizer.
SEP = r"[\s!-/:-@\[-\^`{-~]+"
EDGE = r"[\s!-/:-@\[-`{-~]+"

SQL = {
    "rec": """select doc_id as entity_id, case when doc_id % 5 = 0 then 'S1' when doc_id % 5 < 3 then 'S2' else 'S3' end as side, lang as country,
        name, substring(text, (length(name) + 1)::bigint) as address from (select *, regexp_extract(text, '^[^.!?\n]*[.!?\n]?') as name from documents)""",
    "keys": f"""select entity_id as id, side as src, country, s.side, unnest(list_distinct(s.tokens)) as token from (
        select entity_id, side, country, unnest([
          {{'side': 'name', 'tokens': list_filter(regexp_split_to_array(lower(name), '{SEP}'), lambda t: t <> '' and not list_contains(
             ['limited','llc','private','inc','ltd','com','center','pvt','services','corp','group','india','holdings','care','associates','llp'], t))}},
          {{'side': 'address', 'tokens': list_filter(regexp_split_to_array(lower(address), '{SEP}'), lambda t: t <> '')}}]) as s from rec)""",
    "dfs": "select country, side, token, count(*) as df from keys where src <> 'S1' group by all",
    "sizes": "select country, count(*) as n_docs from rec where side <> 'S1' group by country",
    "idfs": "select country, side, token, df, n_docs, ln(n_docs / df) as idf from dfs join sizes using (country)",
    "rare": """select id, country, side, token, df, idf from (
        select k.id, k.country, k.side, k.token, i.df, i.idf, row_number() over (partition by k.id, k.side order by i.df, k.token) as r
        from keys k join idfs i using (country, side, token) where k.src = 'S1' and i.df <= 20000) where r <= 10""",
    "scored": """select r.id as s1, k.id as cand, r.country, round(sum(r.idf), 9) as score
        from rare r join keys k on r.country = k.country and r.side = k.side and r.token = k.token and k.src <> 'S1' group by all having round(sum(r.idf), 9) > 0""",
    "cands": "select s1, cand, score, country from (select *, row_number() over (partition by s1 order by score desc, cand) as r from scored) where r <= 40",
    "tp": "select a.entity_id as s1, b.entity_id as matched_id from rec a join rec b on a.country = b.country and a.name = b.name and a.address = b.address and a.side = 'S1' and b.side <> 'S1'",
    "pairs": """select s1, cand, (s1 % 3)::varchar as country, score, label, ((s1 * 104729 + cand * 7919) % 1000)::double / 1000 as ce from (
        select l_orderkey as s1, l_partkey as cand, max((round(l_extendedprice * 100)::bigint % 1000)::double / 1000) as score, max((l_returnflag = 'R')::int) as label
        from lineitem group by all)""",
    "truth": "select s1, cand as matched_id from pairs where label = 1 union all select distinct s1, s1 + 10000000 from pairs where s1 % 50 = 0",
    "entities": """select o_orderkey as s1, (o_orderkey % 3)::varchar as country, coalesce(n, 0)::int as n_true
        from orders left join (select s1, count(*) as n from truth group by s1) t on t.s1 = o_orderkey""",
    "best": "select * from (select *, row_number() over (partition by cand order by score desc, s1) as r from pairs where score >= 0.5) where r = 1",
    "addr": """select c_custkey as entity_id, r_name as country, c_name as name, case when c_custkey % 31 <> 0 then
        (c_custkey % 97) || ' ' || lower(c_mktsegment) || ' street, suite ' || (c_custkey % 7) || ', ' || lower(n_name) || ', region ' || r_regionkey end as address
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "addr_pairs": "select a.entity_id as s1, b.entity_id as cand, a.address as a, b.address as b from addr a join addr b on b.entity_id = a.entity_id + 97",
    "vec": "select vec_id as id, label::varchar as country, vec_id % 5 = 0 as is_source1, list_transform(embedding, lambda x: x::double) as embedding from embeddings",
    "knn": """select * from (select *, row_number() over (partition by s1 order by emb_score desc, cand) - 1 as emb_rank from (
        select q.id as s1, t.id as cand, q.country, round(list_dot_product(q.embedding, t.embedding), 9) as emb_score
        from vec q join vec t on q.country = t.country and q.is_source1 and not t.is_source1)) where emb_rank < 3""",
    "id_rows": """select s1::varchar as s1, ids from (
        select s1, case when ids is null then '' when s1 % 101 = 0 then ids || ',S1-7' when s1 % 103 = 0 then ids || ',X9-1' when s1 % 107 = 0 then ids || ',' || ids else ids end as ids, n
        from (select distinct s1 from pairs) left join (
          select s1, string_agg(case when cand % 2 = 0 then 'S2-' else 'S3-' end || cand, ',' order by case when cand % 2 = 0 then 'S2-' else 'S3-' end || cand) as ids
          from pairs where label = 1 group by s1) using (s1), (select unnest([0, 1]) as n))
        where (n = 0 and s1 % 109 <> 0) or (n = 1 and s1 % 113 = 0)""",
    "listed": "select s1, unnest(list_filter(list_transform(string_split(ids, ','), lambda x: trim(x)), lambda x: x <> '')) as id from id_rows",
}

#: The views that each view is made from.
NEEDS = {
    "keys": ["rec"],
    "dfs": ["keys"],
    "sizes": ["rec"],
    "idfs": ["dfs", "sizes"],
    "rare": ["keys", "idfs"],
    "scored": ["rare", "keys"],
    "cands": ["scored"],
    "tp": ["rec"],
    "truth": ["pairs"],
    "entities": ["truth"],
    "best": ["pairs"],
    "addr_pairs": ["addr"],
    "knn": ["vec"],
    "id_rows": ["pairs"],
    "listed": ["id_rows"],
}


def sql(body: str, *views: str) -> str:
    """body with the views it reads, and what those read, before it."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, ()):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return body
    return "with " + ",\n".join(f"{v} as ({SQL[v]})" for v in order) + "\n" + body
