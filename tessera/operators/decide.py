"""From scores to matches: thresholds, conflicts, expected-F0.5 decisions, overrides and blends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import logit

from .keys import CAND, PAIR, S1
from .windows import best_per

#: A record is ambiguous if a score is within these bounds; smaller scores than LEAST never count; candidates considered.
LOW, HIGH, LEAST, MOST = 0.2, 0.95, 0.01, 30


def select_matches(pairs: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Pairs at or above the threshold; each candidate goes to its best record (ties to the smaller id)."""
    return best_per(pairs.filter(F.col(score) >= threshold), CAND, score, S1)


def success_distribution(probabilities: Column) -> Column:
    """The distribution of the number of successes of independent trials, as an array from 0 to n."""

    def step(d: Column, p: Column) -> Column:
        at = lambda i: F.coalesce(F.get(d, i), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(d)), lambda i: at(i) * (1 - p) + F.when(i > 0, at(F.greatest(i - 1, F.lit(0)))).otherwise(0.0) * p)

    return F.aggregate(probabilities, F.array(F.lit(1.0)), step)


def expected_f05(q: np.ndarray) -> np.ndarray:
    """For descending probabilities: the expected F0.5 of predicting the first k, for k from 0."""
    n = len(q)
    # heads[k]: successes among the first k; tails[k]: among the rest
    heads, tails = [np.ones(1)], [np.ones(1)]
    for p in q:
        heads.append(np.convolve(heads[-1], [1 - p, p]))
    for p in q[::-1]:
        tails.append(np.convolve(tails[-1], [1 - p, p]))
    tails = tails[::-1]
    out = np.empty(n + 1)
    out[0] = tails[0][0]  # predicting nothing is right only if nothing is true
    for k in range(1, n + 1):
        hit, missed = np.arange(k + 1)[:, None], np.arange(n - k + 1)[None, :]
        value = 1.25 * hit / (1.25 * hit + 0.25 * missed + (k - hit))
        out[k] = heads[k] @ value @ tails[k]
    return out


def best_k(q: np.ndarray, most: int = MOST) -> int:
    """How many of descending probabilities to predict; the smallest of equally good numbers (to twelve digits)."""
    values = np.round(expected_f05(np.asarray(q, float)[:most]), 12)
    k = 0
    for i in range(1, len(values)):
        if values[i] > values[k]:
            k = i
    return k


@F.pandas_udf(T.IntegerType())
def _best_k(scores: pd.Series) -> pd.Series:
    return scores.map(lambda s: best_k(np.asarray(s, float)))


def with_ambiguity(pairs: DataFrame, score: str = "score") -> DataFrame:
    """pairs from LEAST on, with ambiguous: whether a score of the record is within LOW and HIGH."""
    kept = pairs.filter(F.col(score) >= LEAST)
    return kept.withColumn("ambiguous", F.max(F.col(score).between(LOW, HIGH)).over(Window.partitionBy(S1)))


def expected_f_matches(pairs: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Of ambiguous records the number of best candidates with the greatest expected F0.5; of others what reaches the
    threshold; then each candidate's best record.

    Only the MOST best scores of a record reach Python, as one short array a record.
    """
    known = with_ambiguity(pairs, score)
    w = Window.partitionBy(S1).orderBy(F.desc(score), CAND)
    placed = known.filter("ambiguous").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= MOST)
    scores = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.col(score).alias("s")))), lambda x: x["s"])
    # array_sort is ascending by -rank: the best comes last
    wanted = placed.groupBy(S1).agg(F.reverse(scores).alias("_s")).select(S1, _best_k("_s").alias("_k"))
    ambiguous = placed.join(wanted, S1).filter(F.col("_r") <= F.col("_k")).drop("_r", "_k")
    sure = known.filter(~F.col("ambiguous") & (F.col(score) >= threshold))
    return best_per(ambiguous.unionByName(sure).drop("ambiguous"), CAND, score, S1)


def override(pairs: DataFrame, scores: DataFrame, score: str = "score") -> DataFrame:
    """pairs with the new score where `scores` has one, else the old."""
    new = scores.select(*PAIR, F.col(score).alias("_new"))
    return pairs.join(new, PAIR, "left").withColumn(score, F.coalesce("_new", score)).drop("_new")


def blend(score: Column, other: Column, a: float, b: float, c: float) -> Column:
    """Logistic blend of two probabilities."""
    return 1 / (1 + F.exp(-(a * logit(score) + b * logit(other) + c)))


def ensemble_mean(columns: list[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / len(columns)


def confident_agreement(pairs: DataFrame, score: str = "score", ce: str = "ce", high: float = 0.98, low: float = 0.02, score_low: float = 0.5) -> DataFrame:
    """Pairs on which both scores agree with confidence, with label 1 or 0."""
    pos = (F.col(score) >= high) & (F.col(ce) >= high)
    neg = (F.col(ce) <= low) & (F.col(score) < score_low)
    return pairs.filter(pos | neg).withColumn("label", pos.cast("int"))


def not_both_confident(pairs: DataFrame, score: str = "score", ce: str = "ce", high: float = 0.98) -> DataFrame:
    return pairs.filter(~((F.col(score) >= high) & (F.col(ce) >= high)))


def pseudo_labels(pairs: DataFrame, score: str = "score", high: float = 0.98, low: float = 0.02) -> DataFrame:
    """Pairs with a sure score, with label 1 or 0."""
    return pairs.withColumn("label", F.when(F.col(score) >= high, 1).when(F.col(score) <= low, 0)).filter("label is not null")
