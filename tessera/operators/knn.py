"""Exact nearest neighbours by inner product within a country, and evaluation once per distinct text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.similarity import dot

from .blocking import DIGITS
from .keys import CAND, PAIR, S1


def knn_pairs(vectors: DataFrame, k: int, id_col: str = "id", vec: str = "embedding", country: str = "country", is_s1: str = "is_source1") -> DataFrame:
    """(S1, candidate, country, emb_score, emb_rank): of each reference record the k nearest others of its country, all
    in the JVM; the partial top-k runs before the shuffle. For tables whose pairs within a country are few enough."""
    q = vectors.filter(is_s1).select(F.col(id_col).alias(S1), F.col(country).alias("country"), F.col(vec).alias("_a"))
    t = vectors.filter(~F.col(is_s1)).select(F.col(id_col).alias(CAND), F.col(country).alias("country"), F.col(vec).alias("_b"))
    scored = q.join(t, "country").select(*PAIR, "country", F.round(dot(F.col("_a"), F.col("_b")), DIGITS).alias("emb_score"))
    return ranked(scored, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(S1).orderBy(F.desc("emb_score"), CAND)
    return scored.withColumn("emb_rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("emb_rank") < k)


def knn_blocks(vectors: DataFrame, k: int, id_col: str = "id", vec: str = "embedding", country: str = "country", is_s1: str = "is_source1", block: int = 16_384, part: int = 16_384) -> DataFrame:
    """knn_pairs() by matrix products: queries of a country in blocks of about `block` rows by hash, targets in parts of
    about `part`, each pair of a query block and a target part one group of bounded size; k rows a query leave it. A query
    travels once a part and a target once a block, so for groups of a given size equal sides move least."""
    spark = vectors.sparkSession
    s1 = F.col(is_s1)
    sizes = vectors.groupBy(country).agg(F.count(F.when(s1, 1)).alias("_n"), F.count(F.when(~s1, 1)).alias("_m")).filter("_n > 0 and _m > 0")
    q_blocks, t_parts = F.ceil(F.col("_n") / block).cast("int"), F.ceil(F.col("_m") / part).cast("int")
    known = vectors.join(sizes, country)
    queries = known.filter(s1).withColumn("_q", F.pmod(F.xxhash64(id_col), q_blocks).cast("int")).withColumn("_t", F.explode(F.sequence(F.lit(0), t_parts - 1)))
    targets = known.filter(~s1).withColumn("_t", F.pmod(F.xxhash64(id_col, F.lit(1)), t_parts).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), q_blocks - 1)))
    cols = [F.col(country).alias("country"), "_q", "_t", F.col(id_col).alias("id"), F.col(vec).alias("vec")]
    kind = vectors.schema[id_col].dataType.simpleString()

    def search(key, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (S1, CAND, "country")}).assign(emb_score=pd.Series([], dtype=float))
        a, ids, names = np.stack(q["vec"]).astype(float), t["id"].to_numpy(), q["id"].to_numpy()
        b = np.stack(t["vec"]).astype(float)
        n, rows, cols_, scores = min(k, len(ids)), [], [], []
        order_of_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        for i in range(0, len(a), 256):
            s = np.round(a[i : i + 256] @ b.T, DIGITS)
            for j, row in enumerate(s):
                least = np.partition(row, len(row) - n)[len(row) - n]
                some = np.flatnonzero(row >= least)
                best = some[np.lexsort((order_of_id[some], -row[some]))][:n]
                rows += [i + j] * n
                cols_ += best.tolist()
                scores += row[best].tolist()
        made = {S1: names[rows], CAND: ids[cols_], "country": [key[0]] * len(rows)}
        return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in made.items()}).assign(emb_score=scores)

    found = queries.select(*cols).groupBy("country", "_q", "_t").cogroup(targets.select(*cols).groupBy("country", "_q", "_t"))
    schema = f"{S1} {kind}, {CAND} {kind}, country {vectors.schema[country].dataType.simpleString()}, emb_score double"
    return ranked(found.applyInPandas(search, schema), k)


def per_distinct(df: DataFrame, text: str, name: str, function: Callable[[Column], Column]) -> DataFrame:
    """df with `name`: function(text), evaluated once per distinct text and joined back."""
    once = df.select(F.col(text).alias("_text")).filter("_text is not null").distinct().withColumn(name, function(F.col("_text")))
    return df.join(once, df[text] == once["_text"], "left").drop("_text")


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], prefix: str = "", name: str = "embedding") -> DataFrame:
    """df with a vector for each text from any encoder (a list of texts -> a list of vectors), once per distinct text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in encoder([prefix + t for t in s])])

    return per_distinct(df, text, name, run)


def recall_report(truth: DataFrame, token: DataFrame, knn: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50), token_k: int = 40) -> DataFrame:
    """Shares of true pairs (S1, matched_id, country, script) found by tokens, by the k nearest and by either, per country
    and script and for all."""
    t = token.select(S1, F.col(CAND).alias("matched_id")).withColumn("_t", F.lit(1))
    e = knn.select(S1, F.col(CAND).alias("matched_id"), F.col("emb_rank").alias("_r"))
    both = truth.join(t, [S1, "matched_id"], "left").join(e, [S1, "matched_id"], "left")
    hit = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    aggs = [F.count("*").alias("true_pairs"), hit(F.col("_t").isNotNull()).alias(f"token_at_{token_k}")]
    for k in ks:
        near = F.coalesce(F.col("_r") < k, F.lit(False))
        aggs += [hit(near).alias(f"emb_at_{k}"), hit(near | F.col("_t").isNotNull()).alias(f"union_at_{k}")]
    groups = both.groupingSets([["country", "script"], []], "country", "script").agg(*aggs)
    return groups.withColumns({"country": F.coalesce("country", F.lit("ALL")), "script": F.coalesce("script", F.lit("ALL"))})
