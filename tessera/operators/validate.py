"""Validation of id-list files (record, comma list of ids): a query a rule, and a report that runs them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import S1
from .labels import id_list


def parsed(lines: DataFrame, header: str | None = None) -> DataFrame:
    """(S1, ids, malformed) of raw lines (value): a line without a tab is malformed. The header line, if given, goes."""
    rows = lines if header is None else lines.filter(F.lower(F.trim("value")) != header.lower())
    cut = F.split("value", "\t", 2)
    return rows.select(F.get(cut, F.lit(0)).alias(S1), F.coalesce(F.get(cut, F.lit(1)), F.lit("")).alias("ids"), (F.instr("value", "\t") == 0).alias("malformed"))


def malformed_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("malformed")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """(S1, n) of records with more than one row."""
    return rows.groupBy(S1).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Records that list an id twice."""
    ids = id_list(F.col("ids"))
    return rows.filter(F.size(ids) != F.size(F.array_distinct(ids))).select(S1)


def self_matches(rows: DataFrame, prefix: str = "S1-") -> DataFrame:
    """(S1, id) of ids of the reference source."""
    return rows.select(S1, F.explode(id_list(F.col("ids"))).alias("id")).filter(F.col("id").startswith(prefix))


def wrong_prefix(rows: DataFrame, prefixes: tuple[str, ...] = ("S2-", "S3-"), own: str = "S1-") -> DataFrame:
    """(S1, id) of ids of no known source."""
    ids = rows.select(S1, F.explode(id_list(F.col("ids"))).alias("id"))
    good = F.lit(False)
    for p in (*prefixes, own):
        good = good | F.col("id").startswith(p)
    return ids.filter(~good)


def unknown_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(S1, id) of ids that are not in known (id)."""
    return rows.select(S1, F.explode(id_list(F.col("ids"))).alias("id")).join(known.select("id"), "id", "left_anti").select(S1, "id")


def missing_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    """Required records without a row."""
    return required.select(S1).join(rows.select(S1), S1, "left_anti")


def unexpected_rows(rows: DataFrame, required: DataFrame) -> DataFrame:
    """Rows of records that are not required."""
    return rows.select(S1).distinct().join(required.select(S1), S1, "left_anti")


def not_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(S1, id) of matches that the record's candidates lack."""
    pairs = lambda d: d.select(S1, F.explode(id_list(F.col("ids"))).alias("id"))
    return pairs(matches).join(pairs(candidates), [S1, "id"], "left_anti")


def row_counts(rows: DataFrame) -> DataFrame:
    """rows, empty_rows and non_empty_rows."""
    n = F.size(id_list(F.col("ids")))
    return rows.agg(F.count("*").alias("rows"), F.sum((n == 0).cast("long")).alias("empty_rows"), F.sum((n > 0).cast("long")).alias("non_empty_rows"))


def examples(found: DataFrame, column: str = S1, n: int = 5) -> DataFrame:
    """(n_offenders, examples): the first n distinct values in order; the rest stay where they are."""
    first = found.select(column).distinct().orderBy(column).limit(n).agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ",").alias("examples"))
    return found.agg(F.countDistinct(column).alias("n_offenders")).crossJoin(first)  # two single rows


def check_header(first_line: str | None, expected: tuple[str, str]) -> list[str]:
    """Errors of a file's first line: none, no tab, or other column names."""
    if not first_line:
        return ["the file is empty"]
    if "\t" not in first_line:
        return ["the file is not tab-separated"]
    found = tuple(c.strip().lower() for c in first_line.split("\t"))
    return [] if found == expected else [f"the header is {found}, not {expected}"]


def read_lines(spark: SparkSession, path: str) -> DataFrame | None:
    """(value) of a text file or folder of text files; None if it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.text(path)


def report_files(spark: SparkSession, matches: str, candidates: str, required: DataFrame, known: DataFrame | None = None, names: tuple[str, str] = ("matched_entity_ids", "candidate_entity_ids")) -> DataFrame:
    """(rule, severity, n_offenders): report() of two id-list files. A file that is missing, empty or without tabs or with
    another header is a finding of its own (rule `file` and why), and its rows are not looked at."""
    found, rows = [], []
    for path, name in zip((matches, candidates), names):
        lines = read_lines(spark, path)
        first = None if lines is None else lines.first()
        errors = ["the file is missing"] if lines is None else check_header(first["value"] if first else None, (S1, name))
        found += [(f"file {path.rstrip('/').rpartition('/')[2]}: {e}", "error", 1) for e in errors]
        rows.append(None if errors else parsed(lines, f"{S1}\t{name}"))
    out = spark.createDataFrame(found, "rule string, severity string, n_offenders long")
    return out if rows[0] is None else out.unionByName(report(rows[0], required, known, rows[1]))


def report(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, severity, n_offenders) for each rule."""
    rules = {
        "malformed": ("error", malformed_rows(rows)),
        "duplicate": ("error", duplicate_rows(rows)),
        "repeated id": ("error", repeated_ids(rows)),
        "self match": ("error", self_matches(rows)),
        "unknown source": ("error", wrong_prefix(rows)),
        "missing": ("error", missing_rows(rows, required)),
        "unexpected": ("error", unexpected_rows(rows, required)),
    }
    if known is not None:
        rules["unknown id"] = ("error", unknown_ids(rows, known))
    if candidates is not None:
        rules["not a candidate"] = ("warning", not_subset(rows, candidates))
    out = None
    for name, (severity, found) in rules.items():
        row = found.agg(F.count(S1).alias("n_offenders")).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "n_offenders")
        out = row if out is None else out.unionByName(row)
    return out
