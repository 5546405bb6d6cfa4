"""The whole linkage: records to candidates, features, scores, matches and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocking, candidates, decide, features, knn, sampling, validate
from tessera.operators.keys import CAND, PAIR, S1
from tessera.sources import sinks
from tessera.sources.stages import staged


#: What the score of two names reads of a record.
NAMED = ("entity_id", "country", "name_tokens")


@dataclass(frozen=True)
class Config:
    max_df: int = blocking.MAX_DF
    keys: int = blocking.KEYS
    token_k: int = blocking.TOP_K
    emb_k: int = 20
    threshold: float = 0.75


def candidate_pairs(source1: DataFrame, targets: DataFrame, vectors: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Candidates of cleaned records by tokens and, with vectors, by nearest neighbours."""
    token = blocking.token_blocking(source1, targets, config.max_df, config.keys, config.token_k)
    if vectors is None:
        return token
    union = candidates.candidate_union(token, knn.knn_blocks(vectors, config.emb_k))
    return candidates.with_cosine(union, vectors)


def scored_pairs(pairs: DataFrame, source1: DataFrame, targets: DataFrame, model=None) -> DataFrame:
    """(S1, candidate, score) of candidate pairs of cleaned records; without a model the IDF cosine of the names is the
    score."""
    if model is None:
        return features.name_cosine(pairs, source1.select(*NAMED).unionByName(targets.select(*NAMED)))
    table = features.all_features(pairs, source1.unionByName(targets, allowMissingColumns=True))
    return model.score(table.drop("score")).select(*PAIR, "score")


def link(source1: DataFrame, targets: DataFrame, model=None, vectors: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(S1, candidate, score) matches of cleaned records, which are written once, as are the scored pairs. Without a model
    only what blocking and names need of a record is written."""
    if model is None:
        source1, targets = (r.select(*NAMED, blocking.address_keys(r).alias("address_keys")) for r in (source1, targets))
    source1, targets = staged(source1, "source1"), staged(targets, "targets")
    pairs = candidate_pairs(source1, targets, vectors, config)
    return decide.expected_f_matches(staged(scored_pairs(pairs, source1, targets, model), "scored"), config.threshold)


def run_test(spark: SparkSession, folder: str, source1: DataFrame, targets: DataFrame, model=None, vectors: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """The test run as one step: candidates, scores, matches, both id lists written under folder, and the validator's
    findings on the lists as they were written (rule, severity, n_offenders)."""
    source1, targets = staged(source1, "source1"), staged(targets, "targets")
    pairs = staged(candidate_pairs(source1, targets, vectors, config), "pairs")
    matches = staged(decide.expected_f_matches(staged(scored_pairs(pairs, source1, targets, model), "scored"), config.threshold), "matches")
    ids = sampling.hash_places(source1.select(F.col("entity_id").alias(S1)), sampling.row_hash(S1), [S1], name="ordinal").drop("_total")
    sinks.export_submission(folder, ids, pairs, matches)
    return validate.report_files(spark, f"{folder}/matches", f"{folder}/candidates", ids, targets.select(F.col("entity_id").alias("id")))


__all__ = ["Config", "candidate_pairs", "link", "run_test", "CAND", "S1"]
