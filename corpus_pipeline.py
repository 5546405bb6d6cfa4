"""From raw documents to token ids: five stages, each over all that the one before kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, further columns of any
name included and unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, minhash, pieces, pii, queries, toxicity
from tessera.llm.common import free_name, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5. Labels are not inputs of a score, so labelled documents are judged alike.

    Null and empty texts get the score of a text without any feature. Repeated rows are judged alike. Empty table: empty.
    """
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "score")
    return toxicity.score(docs, model, docs.columns, name=name).filter(f"{name} < 0.5").drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates, similar from 0.8 on.

    Null, empty and blank texts are near nothing. Rows with a null id stay. Of rows that repeat an id, those with the same
    words count as one row; see one_of_each(). Empty table: empty.
    """
    return minhash.one_of_each(docs, percent=80)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets. Null and empty texts stay as they are, repeated rows
    change alike. Empty table: empty."""
    return pii.redact(docs, pii.train(pii.labelled_table(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole. Documents without words stay once, a null source is a source of
    its own, repeated rows and null ids are documents like others. Empty table: empty."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, a row for each time that the mix takes it. Null text: null ids; empty text: no ids.
    Empty table: empty."""
    found = pieces.encode(docs, pieces.read_model(queries.MODEL_PATH), check=True)
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "same", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_pii),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: The classifier, the field and the encoder are no SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
