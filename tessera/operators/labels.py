"""Ground truth, labels of pairs, and coverage of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import CAND, PAIR, S1


def id_list(value: Column) -> Column:
    """The trimmed, non-blank ids of a comma list."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def truth_pairs(truth: DataFrame, lists: str = "matched_entity_ids") -> DataFrame:
    """(S1, matched_id) from (S1, comma list); an empty list has no pair."""
    return truth.select(S1, F.explode(id_list(F.col(lists))).alias("matched_id"))


def true_count(value: Column) -> Column:
    """0 for a blank list, else its commas and one."""
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", 0).otherwise(F.size(F.split(value, ","))).cast("int")


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 for those in truth (S1, matched_id), else 0."""
    t = truth.select(S1, F.col("matched_id").alias(CAND)).distinct().withColumn("_t", F.lit(1))
    return pairs.join(t, PAIR, "left").withColumn("label", F.coalesce("_t", F.lit(0))).drop("_t")


def entity_truth(source1: DataFrame, truth: DataFrame, lists: str = "matched_entity_ids") -> DataFrame:
    """(S1, country, n_true) of every reference record; 0 without a row in truth."""
    t = truth.select(S1, true_count(F.col(lists)).alias("n_true"))
    return source1.select(F.col("entity_id").alias(S1), "country").join(t, S1, "left").na.fill(0, ["n_true"])


def label_coverage(labelled: DataFrame, entities: DataFrame) -> DataFrame:
    """Per country, over records with candidates: records, singletons, true, found and candidate pairs, share of records
    with all found, pair recall and share of positive pairs."""
    found = labelled.groupBy(S1).agg(F.count("*").alias("n_cand"), F.sum("label").alias("n_found"))
    by = (
        entities.join(found, S1)
        .groupBy("country")
        .agg(
            F.count("*").alias("entities"),
            F.sum((F.col("n_true") == 0).cast("long")).alias("singletons"),
            F.sum("n_true").alias("true_pairs"),
            F.sum("n_found").alias("found_pairs"),
            F.sum("n_cand").alias("candidates"),
            F.avg((F.col("n_true") == F.col("n_found")).cast("double")).alias("entities_all_found"),
        )
    )
    return by.withColumns(
        {"pair_recall": F.try_divide(F.col("found_pairs"), F.col("true_pairs")), "positive_rate": F.try_divide(F.col("found_pairs"), F.col("candidates"))}
    )


def never_retrieved(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """True pairs that are not among the candidates."""
    return truth.join(pairs.select(S1, F.col(CAND).alias("matched_id")), [S1, "matched_id"], "left_anti")
