"""Deterministic sampling by hash: the same rows on every run and any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import S1

FIT, EARLY_STOP, VAL = "fit", "early_stop", "val"
#: Buckets of hash values that rows are placed by, and rows that one task may put in order.
BUCKETS, IN_ONE_TASK = 4096, 10_000


def arithmetic_hash(key: Column, seed: int = 42) -> Column:
    """A multiplicative hash of an integer key that any SQL engine can state."""
    return F.pmod((key.cast("decimal(38,0)") + seed) * 2654435761, F.lit(2147483647)).cast("long")


def row_hash(*keys: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def fold(key: str, folds: int = 2, seed: int = 42) -> Column:
    return F.pmod(row_hash(key, seed=seed), F.lit(folds)).cast("int")


def hash_places(df: DataFrame, by: Column, ties: list[str], groups: tuple[str, ...] = (), name: str = "_place", total: str = "_total") -> DataFrame:
    """df with each row's place from 1 on in the order of a hash `by` (then ties) within its group, and the group's rows.

    No task sorts a group: rows are dealt to BUCKETS ranges of the hash, a histogram of the ranges gives the rows before
    each, and rows are put in order within their range only. Null groups are a group.
    """
    keyed = df.withColumn("_hash", by)
    low, high = keyed.agg(F.min("_hash"), F.max("_hash")).first()
    if low is None:
        return df.withColumns({name: F.lit(None).cast("long"), total: F.lit(None).cast("long")})
    part = (F.col("_hash").cast("double") - F.lit(float(low))) / F.lit(float(max(1, int(high) - int(low)))) * BUCKETS
    keyed = keyed.withColumn("_bucket", F.least(F.floor(part), F.lit(BUCKETS - 1)).cast("int"))
    w = Window.partitionBy(*groups)  # BUCKETS rows a group at most
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)),
        F.col("_bucket").alias("_b"),
        (F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(w).alias(total),
    )
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_hash", *ties))
    return keyed.join(counts, same).withColumn(name, F.col("_before") + inside).drop("_hash", "_bucket", "_b", "_before", *(f"_g{i}" for i in range(len(groups))))


def sample(df: DataFrame, n: int, by: Column, ties: list[str]) -> DataFrame:
    """n rows with the smallest hash."""
    if n <= IN_ONE_TASK:
        return df.orderBy(by, *ties).limit(n)
    return hash_places(df, by, ties).filter(F.col("_place") <= n).drop("_place", "_total")


def sample_entities(df: DataFrame, share: float, key: str = S1, seed: int = 42, by: Column | None = None) -> DataFrame:
    """All rows of a share of the entities, by a hash of their key."""
    by = row_hash(key, seed=seed) if by is None else by
    return df.filter(F.pmod(by, F.lit(1_000_000)) < int(share * 1_000_000))


def entity_split(entities: DataFrame, val: float = 0.15, early_stop: float = 0.05, key: str = S1, group: str = "country", by: Column | None = None) -> DataFrame:
    """entities with role: per group round(val * n) for validation, round(early_stop * n) for early stopping, the rest
    to fit, in the order of a hash. Halves round to even."""
    by = row_hash(key) if by is None else by
    placed = hash_places(entities, by, [key], (group,)).withColumns({"_v": F.bround(F.col("_total") * F.lit(val)), "_e": F.bround(F.col("_total") * F.lit(early_stop))})
    role = F.when(F.col("_place") <= F.col("_v"), VAL).when(F.col("_place") <= F.col("_v") + F.col("_e"), EARLY_STOP).otherwise(FIT)
    return placed.withColumn("role", role).drop("_place", "_total", "_v", "_e")


def keep_then_fill(df: DataFrame, keep: Column, n: int, by: Column, ties: list[str]) -> DataFrame:
    """All rows for which keep holds, filled with others up to n rows."""
    kept = df.filter(keep)
    missing = max(0, n - kept.count())
    return kept.unionByName(sample(df.filter(~keep), missing, by, ties))


def pick(values: Column, by: Column) -> Column:
    """One element of an array, chosen by a hash; null if it is empty."""
    return F.get(values, F.pmod(by, F.greatest(F.size(values), F.lit(1)).cast("long")).cast("int"))
