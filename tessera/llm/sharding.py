"""Sharding along a Hilbert curve over metadata.

Language, source and size (in half octaves) are quantised to 6 bits each: a value's place among all distinct values,
stretched over the whole grid, so that the first bits of the curve part every dimension alike. Documents are ordered by
the Hilbert index of the three and the order is cut into runs. A shard then covers a box that is small in each dimension,
so that the minima and maxima in the footers of its files let a filter on any of the dimensions skip files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, global_rank, packed, with_small, written
from .hilbert import hilbert_index

BITS = 6


def _named(col: str) -> Column:
    """A sortable text that keeps nulls apart (they come last)."""
    return F.when(F.col(col).isNull(), "b").otherwise(F.concat(F.lit("a"), F.col(col).cast("string")))


def _codes(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with `name`: the value's place among all distinct values, stretched over 0 .. 2 ** BITS - 1; order is kept."""
    ranked = written(global_rank(df.select(col).distinct(), [col], "_rank"), "values")
    code = F.expr(f"cast(_rank * {2**BITS} div {max(1, ranked.count())} as int)")
    return with_small(df, ranked.select(col, code.alias(name)), col)


def half_octave(size: Column) -> Column:
    """Twice the binary logarithm of a size from 1 on, rounded down to a half octave's begin."""
    digits = F.bin(size)
    half = F.when(F.substring(digits, 2, 1) == "1", 1).otherwise(0)
    return (2 * (F.length(digits) - 1) + half).cast("int")


@F.pandas_udf(T.LongType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), BITS))


def shard_plan(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): law is `rows`, so that row counts of shards differ by one
    at most. slot counts from 0 within a shard along the curve; ties follow the text's checksum, then the key, so that
    equal texts with equal metadata are neighbours.

    Null text: no bytes, checksum 0. Null language or source: a value of its own, last. Repeated rows take slots of
    their own. Fewer rows than shards: some shards stay empty. Empty table: no rows. Further columns are ignored.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    base = docs.select(
        F.col(key).alias("_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), _named(lang).alias("_lang"), _named(source).alias("_source")
    )
    base = written(base.withColumn("_half", half_octave(F.col("size"))), "meta")
    coded = _codes(_codes(_codes(base, "_lang", "_l"), "_source", "_s"), "_half", "_z")
    curved = coded.select("_id", "size", "text_crc32", _curve("_l", "_s", "_z").alias("_h"))
    ranked = global_rank(curved, ["_h", "text_crc32", "_id", "size"], "_rank", "curve")
    n = base.count()
    shard = F.expr(f"_rank * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    out = ranked.withColumn("shard", shard).withColumn("slot", (F.col("_rank") - first).cast("long"))
    return out.select(
        F.col("_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", files: int | None = None, **columns) -> None:
    """Writes docs as one folder a shard (shard=N, or shard_=N and so on if docs has such a column), rows in curve order,
    in files cut along the curve. Keys must be unique, but for null: all rows with a null key share a place.

    Null texts, languages and sources and empty texts as for shard_plan(). Empty table: an empty folder. Columns of any
    other name, such as slot, are written as they are.
    """
    spark = docs.sparkSession
    plan = shard_plan(docs, shards, key, **columns)
    twice = plan.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a key repeats: {twice[0][0]}")
    plan = plan.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("shard", "slot")).alias("_at"))
    folder = free_name(docs.columns, "shard")
    rows = packed(docs, _id=docs[key])
    placed = rows.join(plan, rows["_id"].eqNullSafe(plan["_key"])).select("_row", "_at.shard", "_at.slot")
    files = files or max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(*(F.col("_row")[c].alias(c) for c in docs.columns), F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
