"""Matching of records that arrive: each micro-batch meets the selected keys of the reference records.

Keys and weights are those of the corpus at the time they were written; they are a table, so that they can be renewed
between batches. A batch writes its candidates once, under its number: a batch that runs again replaces its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocking


def match_batch(arrived: DataFrame, selected: DataFrame, k: int = blocking.TOP_K) -> DataFrame:
    """Candidates (S1, candidate, country, score) of newly arrived cleaned records."""
    return blocking.top_k(blocking.pair_scores(selected, blocking.record_keys(arrived)), k)


def start(stream: DataFrame, selected: DataFrame, out: str, checkpoint: str, k: int = blocking.TOP_K, once: bool = True) -> StreamingQuery:
    """Starts matching of a stream of cleaned records; results are folders out/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        match_batch(batch, selected, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
