"""Analytics within the candidates of a record and among the records that share a candidate.

Ranks order by value with nulls last, then by the counterpart's id, so that ties have one order. All windows over the
same key run in one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import dot
from tessera.functions.text import logit, source_of

from .keys import CAND, PAIR, S1

GAPS = ("name_tok_idf_cos", "name_token_set_ratio", "name_char3_idf_cos", "addr_tok_idf_cos")
RANKS = ("name_tok_idf_cos", "addr_tok_idf_cos")
COMPETES = {"comp_char3": "name_char3_idf_cos", "comp_name_tsr": "name_token_set_ratio", "comp_emb": "emb_cos"}


def gap_to_max(value: str, group: str = S1) -> Column:
    return F.max(value).over(Window.partitionBy(group)) - F.col(value)


def rank_in_group(value: str, ties: list[str], group: str = S1) -> Column:
    """0 for the greatest; nulls last; ties by `ties`."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(value), *ties)
    return (F.row_number().over(w) - 1).cast("long")


def context_features(pairs: DataFrame, score: str = "score", gaps: tuple[str, ...] = GAPS, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """block_rank, block_score_rel, n_candidates and, for the named features, their gaps and ranks within the record."""
    group = Window.partitionBy(S1)
    out = pairs.withColumns(
        {
            "block_rank": rank_in_group(score, [CAND]),
            "block_score_rel": F.try_divide(F.col(score), F.nullif(F.max(score).over(group), F.lit(0.0))),
            "n_candidates": F.count("*").over(group),
        }
    )
    out = out.withColumns({f"{c}_gap": gap_to_max(c) for c in gaps if c in pairs.columns})
    return out.withColumns({f"{c}_rank": rank_in_group(c, ["block_rank"]) for c in ranks if c in pairs.columns})


def embedding_features(pairs: DataFrame, emb: str = "emb_score", score: str = "score") -> DataFrame:
    out = pairs.withColumn("emb_cos", F.col(emb))
    out = out.withColumns({"emb_cos_gap": gap_to_max("emb_cos"), "from_token": (F.col(score) > 0).cast("double")})
    return out.withColumn("emb_cos_rank", rank_in_group("emb_cos", [F.desc_nulls_last(score), CAND]))


def competition(pairs: DataFrame, value: str, prefix: str, group: str = CAND, ties: str = S1) -> DataFrame:
    """Among the records that share a candidate: the rank of this pair's value, its margin to the best rival (the winner's
    to the second, others' to the first; null without a rival or value) and the number of rivals and itself."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(value), ties)
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.first(value).over(full), F.nth_value(value, 2).over(full)
    rank = F.row_number().over(order)
    return pairs.withColumns(
        {
            f"{prefix}_rank": (rank - 1).cast("long"),
            f"{prefix}_margin": F.col(value) - F.when(rank == 1, second).otherwise(first),
            "comp_n_s1": F.count("*").over(Window.partitionBy(group)),
        }
    )


def competition_features(pairs: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """competition() for each value, all by candidate. Running it again replaces its columns."""
    for prefix, value in (values or COMPETES).items():
        if value in pairs.columns:
            pairs = competition(pairs, value, prefix)
    return pairs


def stacker_context(pairs: DataFrame, score: str = "score", ce: str = "ce") -> DataFrame:
    """Logits of both scores, their ranks (equal values share the smallest), gap and number within the record."""
    group = Window.partitionBy(S1)
    return pairs.withColumns(
        {
            "lg": logit(F.col(score)),
            "lc": logit(F.col(ce)),
            "ce_rank": F.rank().over(group.orderBy(F.desc_nulls_last(ce))).cast("long"),
            "ce_gap": F.max(ce).over(group) - F.col(ce),
            "gbdt_rank": F.rank().over(group.orderBy(F.desc_nulls_last(score))).cast("long"),
            "n_scored": F.count("*").over(group),
        }
    ).withColumn("disagree", F.col("lg") - F.col("lc"))


def stacker_extras(pairs: DataFrame) -> DataFrame:
    """What further scores add where their columns are there: ce2 falls back on ce, ce_x stays null where not scored."""
    if "ce2" in pairs.columns:
        pairs = pairs.withColumn("lc2", logit(F.coalesce("ce2", "ce"))).withColumn("ce_rounds_diff", F.col("lc") - F.col("lc2"))
    if "ce_x" in pairs.columns:
        pairs = pairs.withColumn("lx", logit(F.col("ce_x"))).withColumn("x_vs_ce", F.col("lx") - F.col("lc"))
    return pairs


def head_of_group(pairs: DataFrame, n: int, order: str = "score", group: str = S1, ties: str = CAND) -> DataFrame:
    """The first n rows of each group by descending order."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(order), ties)
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def sibling_partner(pairs: DataFrame, score: str = "score") -> DataFrame:
    """pairs with partner: the record's best candidate other than this one; null if it has no other."""
    w = Window.partitionBy(S1).orderBy(F.desc_nulls_last(score), CAND)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.first(CAND).over(full), F.nth_value(CAND, 2).over(full)
    return pairs.withColumn("partner", F.when(F.row_number().over(w) == 1, second).otherwise(first))


def coherence(pairs: DataFrame, vectors: DataFrame, score: str = "score", id_col: str = "id", vec: str = "embedding", source=source_of) -> DataFrame:
    """coh_cos: the inner product of the candidate's and its partner's vectors; coh_other_source: whether their sources
    differ. Both null without a partner."""
    a = vectors.select(F.col(id_col).alias(CAND), F.col(vec).alias("_a"))
    b = vectors.select(F.col(id_col).alias("partner"), F.col(vec).alias("_b"))
    out = sibling_partner(pairs, score).join(a, CAND, "left").join(b, "partner", "left")
    other = F.when(F.col("partner").isNotNull(), (source(F.col(CAND)) != source(F.col("partner"))).cast("double"))
    return out.withColumns({"coh_cos": dot(F.col("_a"), F.col("_b")), "coh_other_source": other}).drop("_a", "_b")


def best_per(pairs: DataFrame, group: str = CAND, score: str = "score", ties: str = S1) -> DataFrame:
    """Each candidate's best record: greatest score, then smallest id."""
    return head_of_group(pairs, 1, score, group, ties)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("PAIR",)]
