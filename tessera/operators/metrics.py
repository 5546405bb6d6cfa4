"""F0.5 of records and its mean, thresholds, and model gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import S1

#: Ranges of values that a histogram has.
RANGES = 4096


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """1.25 tp / (1.25 tp + 0.25 missed + wrong); 1 if nothing is true and nothing predicted."""
    num = 1.25 * tp
    den = num + 0.25 * (true - tp) + (predicted - tp)
    return F.when(den > 0, num / den).otherwise(1.0)


def entity_counts(pairs: DataFrame, selected: Column) -> DataFrame:
    """(S1, tp, n_pred) of the pairs for which `selected` holds."""
    return pairs.filter(selected).groupBy(S1).agg(F.sum("label").cast("long").alias("tp"), F.count("*").alias("n_pred"))


def entity_f05(entities: DataFrame, pairs: DataFrame, selected: Column) -> DataFrame:
    """entities (S1, country, n_true) with tp, n_pred and f05; records without pairs count with zeros."""
    out = entities.join(entity_counts(pairs, selected), S1, "left").na.fill(0, ["tp", "n_pred"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(scored: DataFrame, group: str = "country") -> DataFrame:
    """Mean f05 and records per group and, as ALL, over all."""
    out = scored.groupingSets([[group], []], group).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("entities"), F.grouping(group).alias("_all"))
    return out.withColumn(group, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(group).cast("string"))).drop("_all")


def values_at(df: DataFrame, column: str, places: list[int]) -> dict[int, float]:
    """The values that stand at some places (from 0) of the ascending order of a column's values, nulls left out.

    Values are counted first; a histogram over ranges of the values gives how many come before each range, and running
    counts are taken within the ranges only.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    low, high = counts.agg(F.min("_v"), F.max("_v")).first()
    if low is None or not places:
        return {}
    part = F.floor((F.col("_v") - F.lit(low)) / F.lit((high - low) or 1.0) * RANGES).cast("int")
    counts = counts.withColumn("_r", F.least(part, F.lit(RANGES - 1)))
    upto = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # RANGES rows at most
    before = counts.groupBy("_r").agg(F.sum("_n").alias("_m")).withColumn("_before", F.sum("_m").over(upto) - F.col("_m")).select("_r", "_before")
    inside = Window.partitionBy("_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counts.join(before, "_r").withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    own = F.filter(F.array(*(F.lit(i).cast("long") for i in sorted(set(places)))), lambda i: (i >= F.col("_end") - F.col("_n")) & (i < F.col("_end")))
    return {r["i"]: r["_v"] for r in ends.select("_v", F.explode(own).alias("i")).collect()}  # as many rows as places


def threshold_grid(pairs: DataFrame, quantiles: int = 200, score: str = "score") -> DataFrame:
    """Distinct thresholds: 0.01 .. 0.99 and evenly spaced exact quantiles of the scores, interpolated."""
    n = pairs.filter(F.col(score).isNotNull()).count()
    at = [i / (quantiles - 1) * (n - 1) for i in range(quantiles)] if n else []
    found = values_at(pairs, score, [i for x in at for i in (int(x), min(n - 1, int(x) + 1))])
    exact = [found[int(x)] + (found[min(n - 1, int(x) + 1)] - found[int(x)]) * (x - int(x)) for x in at]
    values = sorted({*(round(i / 100, 4) for i in range(1, 100)), *exact})
    return pairs.sparkSession.createDataFrame([(v,) for v in values], "threshold double")


def level_of(value: Column, levels: list[float]) -> Column:
    """How many of the ascending levels are not above value: found among the first of each stretch of levels, then within
    the stretch."""
    width = max(1, math.isqrt(len(levels)))
    stretches = [levels[i : i + width] for i in range(0, len(levels), width)]
    some = lambda values: F.array(*map(F.lit, values))
    stretch = F.size(F.filter(some([x[0] for x in stretches]), lambda t: t <= value))
    inside = F.size(F.filter(F.get(F.array(*map(some, stretches)), stretch - 1), lambda t: t <= value))
    return F.when(stretch > 0, (stretch - 1) * width + inside).otherwise(0)


def threshold_sweep(entities: DataFrame, pairs: DataFrame, thresholds: DataFrame, score: str = "score") -> DataFrame:
    """(threshold, macro_f05): the mean over all entities when pairs with a score of at least the threshold are taken.

    Each pair changes its record's f05 at its own score only. Scores are first moved down to the greatest threshold they
    reach (by a range bucket, as thresholds are few), changes of the mean are summed by threshold, and a running sum over
    thresholds gives the curve: pairs are shuffled once, and not once a threshold.
    """
    grid = sorted(r["threshold"] for r in thresholds.collect())  # some hundreds by construction
    n = entities.count()
    if not grid or not n:
        return thresholds.select("threshold", F.lit(None).cast("double").alias("macro_f05"))
    local = pairs.join(entities.select(S1, "n_true"), S1).select(S1, "n_true", "label", level_of(F.col(score), grid).alias("_k")).filter("_k > 0")
    by = local.groupBy(S1, "n_true", "_k").agg(F.sum("label").alias("_l"), F.count("*").alias("_n"))
    run = Window.partitionBy(S1).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, predicted = F.sum("_l").over(run), F.sum("_n").over(run)
    now = f05(tp, predicted, F.col("n_true"))
    moved = by.withColumn("_now", now).withColumn("_before", F.lag("_now").over(Window.partitionBy(S1).orderBy(F.desc("_k"))))
    none = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    change = moved.select("_k", (F.col("_now") - F.coalesce("_before", none)).alias("_d")).groupBy("_k").agg(F.sum("_d").alias("_d"))
    base = entities.agg(F.sum(none)).first()[0]
    spark = pairs.sparkSession
    curve = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "_k int, threshold double").join(change, "_k", "left")
    down = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # as many rows as thresholds
    return curve.select("threshold", ((F.lit(float(base)) + F.sum(F.coalesce("_d", F.lit(0.0))).over(down)) / n).alias("macro_f05"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row with the greatest mean; of equal ones the lowest threshold."""
    return curve.withColumn("macro_f05", F.round("macro_f05", 12)).orderBy(F.desc("macro_f05"), "threshold").limit(1)


def rate_matched_threshold(pairs: DataFrame, rate: float, score: str = "score") -> DataFrame:
    """(threshold,): the score at place round(rate * n) of the descending scores, without labels.

    Scores are counted by value first, so that the running count is over distinct scores.
    """
    n = pairs.count()
    place = max(1, round(rate * n))
    counts = pairs.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("_n"))
    # a coarse histogram finds the thousandth in which the place falls; the running sum then covers that part only
    coarse = counts.groupBy(F.floor(F.col("threshold") * 1000).alias("_b")).agg(F.sum("_n").alias("_m"))
    w = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = coarse.withColumn("_upto", F.sum("_m").over(w)).filter(F.col("_upto") >= place).orderBy(F.desc("_b")).limit(1)
    fine = counts.withColumn("_b", F.floor(F.col("threshold") * 1000)).join(part, "_b")
    v = Window.partitionBy("_b").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fine.withColumn("_at", F.col("_upto") - F.col("_m") + F.sum("_n").over(v)).filter(F.col("_at") >= place).orderBy(F.desc("threshold")).limit(1).select("threshold")


def gate(candidate: dict[str, float], baseline: dict[str, float], tolerance: float = 0.0003) -> bool:
    """Whether a variant is no worse than the baseline by more than the tolerance, overall and in each group."""
    return all(candidate.get(g, float("-inf")) >= v - tolerance for g, v in baseline.items())
