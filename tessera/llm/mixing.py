"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 60-bit hash of its id. A source's target is met by a threshold on that hash: every document below
it is taken once more. Thresholds are nested: a target above the source's own size takes all documents once, and those
below a second threshold twice. The threshold is found from a histogram of word counts over (source, hash bucket); only
the bucket in which the budget runs out is refined, twelve bits at a time, until one hash value is left. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, global_rank, packed, remove, unpacked, with_small, written

#: The hash has 60 bits, refined 12 bits at a time.
HASH_BITS, STEP_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of md5 over the id as text; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(_skey, source_size, target) for each source of sized (_skey, size).

    Weights are dealt in the order of the source names (code points, null last), repeating. A target never exceeds
    `most` times its source's size; what is over is shared among the others by weight until none is above.
    """
    per = sized.groupBy("_skey").agg(F.sum("size").alias("source_size"))
    ranked = written(global_rank(per, ["_skey"], "_rank"), "sources")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    src = ranked.select("_skey", "source_size", w.cast("long").alias("_w")).withColumn("_most", F.col("source_size") * F.lit(float(most)))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    budget, level, before = share * total, None, -1
    while True:  # each round is one aggregation; it ends when no further source reaches its limit
        full = F.lit(False) if level is None else (F.col("_most") <= F.col("_w") * F.lit(level))
        row = src.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.sum(F.when(full, F.col("_most")).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0).otherwise(F.col("_w"))).alias("free"),
        ).first()
        if (row["n"] or 0) == before or not row["free"]:
            break
        before, level = row["n"], (budget - row["used"]) / row["free"]
    free = F.col("_w") * F.lit(float(level or 0.0))
    return src.select("_skey", "source_size", F.least(F.col("_most"), free).cast("double").alias("target"))


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(_skey, _full, _cut, _left, _tie): all documents are taken _full times, those with a hash below _cut once more,
    and those at _cut, which hold _tie words, share the _left words."""
    goal = targets.select(
        "_skey",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_full"),
        "source_size",
        "target",
    ).select("_skey", "_full", F.floor(F.col("target") - F.col("_full") * F.col("source_size")).cast("long").alias("_left"))
    goal = written(goal.withColumn("_prefix", F.lit(0).cast("long")), "goal")
    done, shift = None, HASH_BITS
    while True:
        shift -= STEP_BITS
        # documents that are still in their source's boundary bucket
        rows = with_small(sized, goal.drop("_full"), "_skey").filter(F.shiftright("_h", shift + STEP_BITS) == F.col("_prefix"))
        hist = rows.groupBy("_skey", "_left", F.shiftright("_h", shift).alias("_b")).agg(
            F.sum("size").alias("_n"), F.min("_h").alias("_low"), F.max("_h").alias("_high")
        )
        w = Window.partitionBy("_skey").orderBy("_b")  # at most 2 ** STEP_BITS buckets of a source
        hist = hist.withColumn("_below", F.sum("_n").over(w) - F.col("_n"))
        edge = hist.filter((F.col("_below") <= F.col("_left")) & (F.col("_left") < F.col("_below") + F.col("_n")))
        edge = written(
            edge.select("_skey", F.col("_b").alias("_prefix"), (F.col("_left") - F.col("_below")).alias("_left"), F.col("_n").alias("_tie"), "_low", "_high").join(
                goal.select("_skey", "_full"), "_skey"
            ),
            "edge",
        )
        one = edge.filter((F.col("_low") == F.col("_high")) | F.lit(shift == 0)).select("_skey", "_full", F.col("_low").alias("_cut"), "_left", "_tie")
        done = one if done is None else done.unionByName(one)
        goal = edge.filter(F.col("_low") != F.col("_high")).select("_skey", "_full", "_left", "_prefix")
        if shift == 0 or goal.isEmpty():
            return done


def _keyed(docs: DataFrame, key: str, source: str, text: str, kept: bool = False) -> DataFrame:
    """(_id, _skey, _size, _h) of each row and, if kept, the row itself as _row."""
    skey = F.when(docs[source].isNull(), "b").otherwise(F.concat(F.lit("a"), docs[source].cast("string")))
    made = packed(docs, _id=docs[key], _skey=skey, _size=word_count(docs[text]), _h=id_hash(docs[key]))
    return made if kept else made.drop("_row")


def mix_goals(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, key: str, source: str, text: str) -> DataFrame:
    """One row a source: its size, its target and its threshold."""
    sized = written(_keyed(docs, key, source, text).select("_skey", F.col("_size").alias("size"), "_h"), "sizes")
    targets = written(source_targets(sized, weights, share, most), "targets")
    cuts = written(_thresholds(sized.filter("size > 0"), targets), "cuts")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = written(targets.join(cuts.drop("_full"), "_skey", "left").withColumn("_full", full), "goals")
    remove(sized, targets, cuts)
    return goals


def _taken(whole_documents: bool) -> Column:
    if whole_documents:
        at_cut = F.when(F.col("_left") * 2 >= F.col("_tie"), F.col("_size")).otherwise(0)
    else:
        at_cut = F.floor(F.col("_size") * (F.col("_left").cast("double") / F.col("_tie"))).cast("long")
    extra = F.when(F.col("_h") < F.col("_cut"), F.col("_size")).when(F.col("_h") == F.col("_cut"), at_cut).otherwise(0)
    return (F.col("_size") * F.col("_full") + F.coalesce(extra, F.lit(0))).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    whole_documents: bool = False,
) -> DataFrame:
    """(key, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    Documents at the boundary hash (one, unless ids repeat) take their share of the words that are left, so that a
    source's words miss its target by less than one word a boundary document. With whole_documents they are taken whole
    if that comes nearer to the target, else not; `taken` is then a multiple of `size`.

    Null text: size 0, taken 0. Null source: a source of its own, last in order. Null ids hash as the empty text.
    Repeated rows are documents of their own with equal hashes. Empty table: no rows. Further columns are ignored.
    """
    goals = mix_goals(docs, weights, share, most, key, source, text)
    joined = with_small(_keyed(docs, key, source, text), goals, "_skey")
    return joined.select(F.col("_id").alias(key), F.col("_size").alias("size"), "source_size", "target", _taken(whole_documents).alias("taken"))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (whole documents; those that it does not take go).

    A document without words is kept once, whatever its source's share. Nulls, ties, repeated rows and empty tables as
    for mix(). Columns of any other name stay as they are.
    """
    goals = mix_goals(docs, weights, share, most, key, source, text)
    rows = with_small(_keyed(docs, key, source, text, kept=True), goals, "_skey")
    times = F.when(F.col("_size") > 0, F.expr("_taken div _size")).otherwise(1).cast("int")
    rows = rows.withColumn("_taken", _taken(True)).withColumn("_times", times).filter("_times > 0")
    return unpacked(rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs.columns)
