"""Candidate sets: union of token and nearest-neighbour candidates, counts, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import dot

from .keys import CAND, PAIR, S1


def candidate_union(token: DataFrame, knn: DataFrame) -> DataFrame:
    """All pairs of either: the token score (0 for pairs found by vectors only) and the vector rank (null for the others)."""
    t = token.select(*PAIR, "country", "score")
    e = knn.select(*PAIR, F.col("country").alias("_c"), "emb_score", "emb_rank")
    both = t.join(e, PAIR, "full_outer")
    return both.select(*PAIR, F.coalesce("country", "_c").alias("country"), F.coalesce("score", F.lit(0.0)).alias("score"), "emb_score", "emb_rank")


def with_cosine(pairs: DataFrame, vectors: DataFrame, id_col: str = "id", vec: str = "embedding", name: str = "emb_score") -> DataFrame:
    """pairs with the inner product of both records' vectors."""
    a = vectors.select(F.col(id_col).alias(S1), F.col(vec).alias("_a"))
    b = vectors.select(F.col(id_col).alias(CAND), F.col(vec).alias("_b"))
    return pairs.drop(name).join(a, S1, "left").join(b, CAND, "left").withColumn(name, dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def candidate_counts(pairs: DataFrame) -> DataFrame:
    """Mean and greatest number of candidates of a record that has any."""
    return pairs.groupBy(S1).agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean_candidates"), F.max("n").alias("max_candidates"))


def missing_ids(pairs: DataFrame, records: DataFrame, column: str, id_col: str = "entity_id") -> DataFrame:
    """Ids in a column of pairs that no record has; empty if all are known."""
    return pairs.select(F.col(column).alias("id")).distinct().join(records.select(F.col(id_col).alias("id")), "id", "left_anti")


def attach(pairs: DataFrame, records: DataFrame, columns: list[str], id_col: str = "entity_id") -> DataFrame:
    """pairs with columns of both records, prefixed s1_ and cand_."""
    a = records.select(F.col(id_col).alias(S1), *(F.col(c).alias(f"s1_{c}") for c in columns))
    b = records.select(F.col(id_col).alias(CAND), *(F.col(c).alias(f"cand_{c}") for c in columns))
    return pairs.join(a, S1, "left").join(b, CAND, "left")


def attach_features(scored: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """scored with columns of a feature table; only the features of scored pairs cross the network beyond the join keys'
    filter, and a pair without features keeps nulls."""
    known = features.select(*PAIR, *columns).join(scored.select(*PAIR), PAIR, "left_semi")
    return scored.join(known, PAIR, "left")


def semi(df: DataFrame, ids: DataFrame, on: str = S1) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids.select(*on).distinct(), on, "left_anti")
