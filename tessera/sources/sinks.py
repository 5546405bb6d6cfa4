"""Writers: tables with a schema, cached stages, id lists and submissions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.naming import model_key
from tessera.operators.keys import CAND, PAIR, S1


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there (Spark writes _SUCCESS last)."""
    fs, p = _file(spark, path.rstrip("/") + "/_SUCCESS")
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    fs, p = _file(spark, path)
    return fs.getFileStatus(p).getModificationTime()


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, mode: str = "errorifexists") -> DataFrame:
    """Writes Parquet under a fixed schema (columns are picked and cast to it) and reads it back."""
    if schema is not None:
        df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def cache_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, inputs: list[str] | None = None) -> DataFrame:
    """The table at path; built and written if it is missing, force is set or one of the inputs is newer."""
    fresh = not force and exists(spark, path)
    if fresh and inputs:
        at = modified(spark, path.rstrip("/") + "/_SUCCESS")
        fresh = all(modified(spark, i) <= at for i in inputs)
    return spark.read.parquet(path) if fresh else write_table(build(), path, mode="overwrite")


def publish(df: DataFrame, path: str) -> DataFrame:
    """Writes a table under a name of its own beside path and renames it when it is whole: readers of path see the old
    table or the new one, never a part. The old one goes only after the new one is written."""
    spark, path = df.sparkSession, path.rstrip("/")
    trial = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(trial)
    fs, to = _file(spark, path)
    old = _file(spark, f"{trial}.old")[1]
    if fs.exists(to) and not fs.rename(to, old):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(_file(spark, trial)[1], to):
        fs.rename(old, to)
        raise OSError(f"cannot publish {path}")
    fs.delete(old, True)
    return spark.read.parquet(path)


def vectors(spark: SparkSession, folder: str, split: str, model: str, records: DataFrame, encode: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """(id, embedding, ...) of a split's records by the encoder of one model: read if the folder has them under the
    model's key and they are as many as the records, else encoded and published there."""
    path = f"{folder.rstrip('/')}/{model_key(model)}/{split}"
    if not force and exists(spark, path):
        found = spark.read.parquet(path)
        if found.count() == records.count():
            return found
    return publish(encode(records), path)


def write_features(df: DataFrame, path: str, files: int | None = None) -> None:
    """A feature table whose files hold whole records."""
    (df.repartition(files, S1) if files else df.repartition(S1)).write.mode("overwrite").parquet(path)


def replace_columns(df: DataFrame, columns: dict, path: str) -> DataFrame:
    """df with added or replaced columns at a new path; Spark cannot overwrite what it reads."""
    return write_table(df.withColumns(columns), path)


def id_lists(ids: DataFrame, pairs: DataFrame, id_col: str = CAND, score: str = "score", order: str | None = None) -> DataFrame:
    """(S1, ids) for each row of ids: its pairs' ids by descending score (ties by id), joined by commas; empty if none.
    With `order`, a column of ids, that is kept for sorting."""
    entry = F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("i"))
    lists = pairs.groupBy(S1).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    joined = F.array_join(F.transform("_l", lambda x: x["i"].cast("string")), ",")
    kept = [S1] if order is None else [S1, order]
    return ids.select(*kept).join(lists, S1, "left").select(*kept, F.coalesce(joined, F.lit("")).alias("ids"))


def write_id_lists(ids: DataFrame, pairs: DataFrame, path: str, header: tuple[str, str], order: str = "ordinal", score: str = "score") -> None:
    """A tab-separated text table in the order of `order`: a header line, then a line a record. Lines are range-sorted, so
    the parts in name order are the file; the header is the first line of the first part."""
    lines = id_lists(ids, pairs, score=score, order=order).select(F.col(order).cast("long").alias("_o"), F.concat_ws("\t", F.col(S1).cast("string"), "ids").alias("value"))
    top = ids.sparkSession.createDataFrame([(-1, "\t".join(header))], "_o long, value string")
    lines.unionByName(top).orderBy("_o").select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


def check_submission(candidates: DataFrame, matches: DataFrame) -> None:
    """Fails if a match is no candidate or a pair repeats."""
    stray = matches.select(*PAIR).join(candidates.select(*PAIR), PAIR, "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"a match is not among the candidates: {tuple(stray[0])}")
    for name, df in (("candidates", candidates), ("matches", matches)):
        twice = df.groupBy(*PAIR).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"a pair repeats in {name}: {tuple(twice[0])[:2]}")


def export_submission(folder: str, ids: DataFrame, candidates: DataFrame, matches: DataFrame) -> None:
    """Both id lists, after the checks."""
    check_submission(candidates, matches)
    write_id_lists(ids, candidates, f"{folder}/candidates", (S1, "candidate_entity_ids"))
    write_id_lists(ids, matches, f"{folder}/matches", (S1, "matched_entity_ids"))


def write_metrics(spark: SparkSession, values: dict[str, float | str], path: str) -> None:
    """Metrics of a run as one line of JSON."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(scored: DataFrame, path: str, threshold: float | None = None) -> DataFrame:
    """(S1, candidate, score, and label and country if they are known) of scored pairs, with `predicted` given a threshold."""
    out = scored.select(*PAIR, "score", *(c for c in ("label", "country") if c in scored.columns))
    return publish(out if threshold is None else out.withColumn("predicted", (F.col("score") >= threshold).cast("int")), path)


def package(spark: SparkSession, files: dict[str, str], path: str) -> list[str]:
    """A zip archive of text tables (name in the archive -> folder of write_id_lists()), each as one file. The parts are
    streamed through the driver in name order, a block at a time; returns the names."""
    fs, to = _file(spark, path)
    out = spark._jvm.java.util.zip.ZipOutputStream(fs.create(to, True))
    try:
        for name, folder in files.items():
            source, place = _file(spark, folder)
            parts = sorted(str(s.getPath()) for s in source.listStatus(place) if s.getPath().getName().startswith("part-"))
            if not parts:
                raise ValueError(f"nothing to pack in {folder}")
            out.putNextEntry(spark._jvm.java.util.zip.ZipEntry(name))
            for p in parts:
                stream = source.open(spark._jvm.org.apache.hadoop.fs.Path(p))
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
                stream.close()
            out.closeEntry()
    finally:
        out.close()
    return list(files)


def write_csv(df: DataFrame, path: str) -> None:
    """Side tables: curves, importances, errors."""
    df.write.mode("overwrite").csv(path, header=True)
