"""Pair classifiers on pyspark.ml: boosted trees, a stacker over folds, a logistic blend, and their diagnostics."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import logit
from tessera.operators.decide import pseudo_labels
from tessera.operators.features import FEATURES, feature_columns
from tessera.operators.keys import PAIR, S1
from tessera.operators.metrics import best_threshold, entity_f05, macro_f05, threshold_grid, threshold_sweep
from tessera.operators.sampling import EARLY_STOP, FIT, VAL, fold
from tessera.sources.stages import staged

#: What stands for an undefined feature: below all defined values, so that trees can split it off.
UNDEFINED = -2.0


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(UNDEFINED)).alias(c) for c in features]
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df.select(*(c for c in df.columns if c not in features), *filled))


def boosted(rounds: int = 40, depth: int = 5, rate: float = 0.1, seed: int = 42, validation: str | None = None) -> GBTClassifier:
    """Boosted trees; with validation, a boolean column, training stops when rows for which it holds gain no more."""
    gbt = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8)
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


class PairModel:
    """A trained classifier with its feature list."""

    def __init__(self, model, features: list[str]) -> None:
        self.model, self.features = model, features

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the probability of a match. A table with other features is refused: one that lacks a feature of the
        model, or has one of the known features that the model was not trained on."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"features are missing: {missing}")
        unknown = [c for c in feature_columns(df) if c not in self.features]
        if unknown and set(self.features) <= set(FEATURES):
            raise ValueError(f"the model was not trained on these features: {unknown}")
        keys = [c for c in df.columns if c not in self.features and c != name]
        rows = self.model.transform(assemble(df, self.features))
        return rows.select(*keys, *self.features, vector_to_array("probability")[1].alias(name))

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance, splits), greatest first: the share of the gain, and in how many nodes of the trees the
        feature decides."""
        gains = self.model.featureImportances.toArray().tolist()
        splits = [0] * len(self.features)
        for tree in self.model.trees:
            for i in re.findall(r"If \(feature (\d+) ", tree.toDebugString):
                splits[int(i)] += 1
        return spark.createDataFrame(list(zip(self.features, gains, splits)), "feature string, importance double, splits long").orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        """Writes the model and its feature list."""
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        rows = spark.createDataFrame(list(enumerate(self.features)), "place int, feature string")
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PairModel:
        """A saved model; it scores as it did and refuses the tables that it refused."""
        features = [r["feature"] for r in spark.read.schema("place int, feature string").json(f"{path}/features").orderBy("place").collect()]
        return PairModel(GBTClassificationModel.load(f"{path}/model"), features)


def train_pairs(df: DataFrame, features: list[str], role: str | None = "role", **options) -> PairModel:
    """Fits boosted trees to labelled pairs: those with role `fit`, stopping early by those with role `early_stop`."""
    if role is None:
        rows = assemble(df, features)
        return PairModel(boosted(**options).fit(rows.select("_x", "label")), features)
    rows = assemble(df.filter(F.col(role).isin(FIT, EARLY_STOP)), features).withColumn("_stop", F.col(role) == EARLY_STOP)
    return PairModel(boosted(validation="_stop", **options).fit(rows.select("_x", "label", "_stop")), features)


def evaluate(scored: DataFrame, entities: DataFrame, threshold: float | None = None) -> tuple[float, DataFrame]:
    """(threshold, macro F0.5 by country and ALL) of scored pairs over all entities; the threshold is tuned if not given."""
    if threshold is None:
        row = best_threshold(threshold_sweep(entities, scored, threshold_grid(scored))).first()
        threshold = row["threshold"] if row is not None else 0.5
    return threshold, macro_f05(entity_f05(entities, scored, F.col("score") >= threshold))


def dev_run(df: DataFrame, entities: DataFrame, features: list[str], **options) -> tuple[PairModel, DataFrame, float, DataFrame]:
    """Fit, score validation records, tune: (model, scored validation pairs, threshold, metrics). entities have a role."""
    model = train_pairs(df, features, **options)
    scored = model.score(df.filter(F.col("role") == VAL))
    threshold, metrics = evaluate(scored, entities.filter(F.col("role") == VAL))
    return model, scored, threshold, metrics


def final_run(df: DataFrame, features: list[str], rounds: int, **options) -> PairModel:
    """A model from all rows with a locked number of rounds."""
    return train_pairs(df, features, role=None, rounds=rounds, **options)


def leave_one_country_out(df: DataFrame, entities: DataFrame, features: list[str], **options) -> DataFrame:
    """(country, threshold, transferred, own): F0.5 on each country of a model from the others, at the threshold tuned on
    those others and at the country's own best. Countries are few; each is a training run. Training and tuning go over
    the pairs and their scores many times, so these are computed once and written; entities should be a table."""
    spark, rows = df.sparkSession, []
    df = staged(df.select(S1, "country", "label", *(c for c in features if c not in (S1, "country", "label"))), "pairs")
    for c in sorted(r["country"] for r in entities.select("country").distinct().collect()):
        rest, own = df.filter(F.col("country") != c), df.filter(F.col("country") == c)
        model = train_pairs(rest, features, role=None, **options)
        known = staged(model.score(df).select(S1, "country", "label", "score"), "scored")
        there = entities.filter(F.col("country") == c)
        threshold, _ = evaluate(known.filter(F.col("country") != c), entities.filter(F.col("country") != c))
        scored = known.filter(F.col("country") == c)
        all_of = lambda m: m.filter("country = 'ALL'").first()["macro_f05"]
        rows.append((c, float(threshold), all_of(evaluate(scored, there, threshold)[1]), all_of(evaluate(scored, there)[1])))
    return spark.createDataFrame(rows, "country string, threshold double, transferred double, own double")


def fit_blend(df: DataFrame, score: str = "score", ce: str = "ce") -> tuple[float, float, float]:
    """(a, b, c) of the logistic blend of two probabilities."""
    rows = df.select(logit(F.col(score)).alias("lg"), logit(F.col(ce)).alias("lc"), "label")
    m = LogisticRegression(featuresCol="_x", labelCol="label").fit(VectorAssembler(inputCols=["lg", "lc"], outputCol="_x").transform(rows))
    return float(m.coefficients[0]), float(m.coefficients[1]), float(m.intercept)


def bagged(df: DataFrame, features: list[str], to_score: DataFrame, name: str, seeds: tuple[int, ...] = (1, 2, 3), **options) -> DataFrame:
    """to_score with the mean score of models that differ by seed."""
    out = to_score
    for s in seeds:
        out = train_pairs(df, features, role=None, seed=s, **options).score(out, f"_s{s}")
    mean = F.lit(0.0)
    for s in seeds:
        mean = mean + F.col(f"_s{s}")
    return out.withColumn(name, mean / len(seeds)).drop(*(f"_s{s}" for s in seeds))


def out_of_fold(df: DataFrame, features: list[str], name: str = "stacked", folds: int = 2, key: str = S1, **options) -> DataFrame:
    """df with a score of each row by bagged models from the other folds; a fold is a hash of the record."""
    known = df.withColumn("_fold", fold(key, folds))
    out = None
    for f in range(folds):
        scored = bagged(known.filter(F.col("_fold") != f), features, known.filter(F.col("_fold") == f), name, **options)
        out = scored if out is None else out.unionByName(scored)
    return out.drop("_fold")


def pseudo_label_run(labelled: DataFrame, unlabelled: DataFrame, features: list[str], **options) -> DataFrame:
    """unlabelled scored by a model that was trained on the labelled pairs and on those that a first model is sure of."""
    first = train_pairs(labelled, features, role=None, **options)
    sure = pseudo_labels(first.score(unlabelled.drop("label")))
    cols = [*PAIR, *features, "label"]
    both = labelled.select(*cols).unionByName(sure.select(*cols))
    return train_pairs(both, features, role=None, **options).score(unlabelled)
