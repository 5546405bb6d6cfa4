"""Reports: predictions, errors and their loss, and inspection of records, entities and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import attach
from .decide import select_matches
from .keys import CAND, PAIR, S1
from .labels import never_retrieved
from .metrics import entity_f05


def prediction_summary(source1: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Per country: records, records without candidates, share without a match, mean matches."""
    n_c, n_m = (d.groupBy(S1).agg(F.count("*").alias(n)) for d, n in ((candidates, "n_candidates"), (matches, "n_matches")))
    s = source1.select(F.col("entity_id").alias(S1), "country").join(n_c, S1, "left").join(n_m, S1, "left").na.fill(0, ["n_candidates", "n_matches"])
    return s.groupBy("country").agg(
        F.count("*").alias("entities"),
        F.sum((F.col("n_candidates") == 0).cast("long")).alias("no_candidates"),
        F.avg((F.col("n_matches") == 0).cast("double")).alias("predicted_singletons"),
        F.avg("n_matches").alias("mean_matches"),
    )


def with_prediction(scored: DataFrame, threshold: float) -> DataFrame:
    """scored with pred: whether select_matches() keeps the pair."""
    kept = select_matches(scored, threshold).select(*PAIR, F.lit(True).alias("pred"))
    return scored.join(kept, PAIR, "left").na.fill(False, ["pred"])


def error_report(scored: DataFrame, truth: DataFrame, entities: DataFrame, threshold: float, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(errors, entities): wrong pairs that are predicted (FP), true ones that are not (FN) and true ones that are no
    candidates (MISS), with the record's F0.5 and loss and both texts; and the records with their F0.5."""
    predicted = with_prediction(scored, threshold)
    by_entity = entity_f05(entities, predicted, F.col("pred"))
    cols = [*PAIR, "score", "label"]
    fp = predicted.filter("pred and label = 0").select(F.lit("FP").alias("error_type"), *cols)
    fn = predicted.filter("not pred and label = 1").select(F.lit("FN").alias("error_type"), *cols)
    miss = never_retrieved(truth.join(entities.select(S1), S1, "left_semi"), scored)
    miss = miss.select(F.lit("MISS").alias("error_type"), S1, F.col("matched_id").alias(CAND), F.lit(None).cast("double").alias("score"), F.lit(1).alias("label"))
    errors = fp.unionByName(fn).unionByName(miss)
    known = by_entity.select(S1, "country", "n_true", F.col("f05").alias("entity_f05"), (1 - F.col("f05")).alias("entity_loss"))
    errors = errors.join(known, S1, "left")
    if texts is not None:
        errors = attach(errors, texts, ["text"], "id").withColumnsRenamed({"s1_text": "s1_text", "cand_text": "candidate_text"})
    return errors, by_entity


def error_summary(errors: DataFrame, by_entity: DataFrame) -> DataFrame:
    """(country, kinds, entities, loss_points): the mean F0.5 lost to each combination of error kinds."""
    kinds = errors.groupBy(S1).agg(F.array_join(F.array_sort(F.collect_set("error_type")), "+").alias("kinds"))
    n = by_entity.count()
    rows = by_entity.join(kinds, S1).withColumn("kinds", F.when((F.col("n_true") == 0) & (F.col("kinds") == "FP"), "FP (true singleton)").otherwise(F.col("kinds")))
    return rows.groupBy("country", "kinds").agg(F.count("*").alias("entities"), (F.sum(1 - F.col("f05")) / n).alias("loss_points"))


def list_errors(errors: DataFrame, kind: str | None = None, country: str | None = None, has_address: bool | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of errors, greatest loss first; filters are options. has_address needs a column of that name."""
    if kind is not None:
        errors = errors.filter(F.col("error_type") == kind)
    if country is not None:
        errors = errors.filter(F.col("country") == country)
    if has_address is not None:
        errors = errors.filter(F.col("has_address") == has_address)
    return errors.orderBy(F.desc("entity_loss"), S1, "error_type", CAND).offset(offset).limit(limit)


def inspect_record(records: DataFrame, entity_id, id_col: str = "entity_id") -> DataFrame:
    return records.filter(F.col(id_col) == F.lit(entity_id))


def inspect_pair(features: DataFrame, s1, cand) -> DataFrame:
    return features.filter((F.col(S1) == F.lit(s1)) & (F.col(CAND) == F.lit(cand)))


def inspect_entity(scored: DataFrame, truth: DataFrame, s1) -> DataFrame:
    """(candidate, score, label, retrieved) of one record: its candidates and the true matches never retrieved."""
    own = scored.filter(F.col(S1) == F.lit(s1))
    t = truth.filter(F.col(S1) == F.lit(s1))
    labels = t.select(F.col("matched_id").alias(CAND), F.lit(1).alias("_t"))
    rows = own.select(CAND, "score").join(labels, CAND, "left").select(CAND, "score", F.coalesce("_t", F.lit(0)).alias("label"), F.lit(True).alias("retrieved"))
    missing = never_retrieved(t, own).select(F.col("matched_id").alias(CAND), F.lit(None).cast("double").alias("score"), F.lit(1).alias("label"), F.lit(False).alias("retrieved"))
    return rows.unionByName(missing)
