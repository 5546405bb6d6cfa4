"""What the operators of this folder share: written tables, global ranks, joins with small tables, byte arrays."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word of the contracts: a run of anything but the ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: What parts them.
SPACES = "[\\x20\\x09-\\x0D]+"

#: A table of at most so many rows counts as small enough to be broadcast (checked by a count).
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session, where driver and executors are one process, may fall back on a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads, to free disk."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """name, or name with underscores behind it, so that no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, **made: Column) -> DataFrame:
    """(_row, *made): the whole row as one struct beside new columns, so that no name of its columns can clash."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("_row"), *(c.alias(n) for n, c in made.items()))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows that packed() put into _row."""
    return df.select(*(F.col("_row")[c].alias(c) for c in columns))


def with_small(df: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Joins df with a table that has one row a key. It is broadcast only if a count shows that it is small; beyond
    that, keys are salted on both sides, so that a hot key is split among `salts` tasks."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), key, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank", sort_first: str = "ranked") -> DataFrame:
    """df with `name`: each row's place from 0 in the order of all rows, without gathering them in one task.

    Rows are range-partitioned and sorted within partitions, which are written; counts of the partitions (as many rows
    as there are partitions) give each one's offset.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"_k{i}" for i in range(len(cols))]
    keyed = df.select("*", *(c.alias(k) for c, k in zip(cols, keys)))
    ranged = keyed.repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*keys)
    base = written(ranged, sort_first)
    counts = {r["_p"]: r["n"] for r in base.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    offset, at = [], 0
    for p in sorted(counts):
        offset.append((p, at))
        at += counts[p]
    offsets = spark.createDataFrame(offset, "_p int, _offset long") if offset else spark.createDataFrame([], "_p int, _offset long")
    # one window group is one range partition, never larger than a task's share of the sort above
    ranked = base.withColumn("_r", F.row_number().over(w)).join(F.broadcast(offsets), "_p")
    return ranked.withColumn(name, F.col("_offset") + F.col("_r") - 1).drop("_p", "_r", "_offset", *keys)


# ---- texts of a batch as one byte array -------------------------------------------------------------------------


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (None: empty) in one array, and the offsets (n + 1) at which each begins."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def in_slices(n_bytes: list[int], most: int):
    """(from, to) slices of a batch whose texts have at most `most` bytes together, or are a single longer text."""
    start, size = 0, 0
    for i, n in enumerate(n_bytes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(n_bytes):
        yield start, len(n_bytes)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words of each text."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a word that runs over the border of two texts is two words
    border = np.unique(offsets[1:-1])
    border = border[(border > 0) & (border < n)]
    cut = border[(inside[border] == 1) & (inside[border + 1] == 1)]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def struct_of(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


def arrow_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """joined_bytes() of an Arrow string column, without a copy where there are no nulls."""
    import pyarrow as pa

    col = col.cast(pa.binary()).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded_batches(spark: SparkSession, rows: int = 400) -> None:
    """Rows that go to Python at once; whole texts make 10,000 rows too many for a small executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Bytes of text that one numpy pass holds.
SLICE = 2_000_000
