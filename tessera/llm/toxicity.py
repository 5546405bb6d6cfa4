"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z), white space counts as one space each, and the n-grams (in bytes) are hashed. From labelled
texts come the numbers of documents of both classes that hold an n-gram; their smoothed log ratio, where it is
significant, is the n-gram's scale. A logistic regression over the scaled presence of n-grams gives the score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes, bounded_batches, free_name, in_slices, mix64, remove, written

GRAMS = (4, 5, 6)
BUCKET_BITS = 19
#: The classifier is fitted to at most so many labelled rows (those with the smallest hash of their id) and features
#: (a feature is sent as a short).
MOST_ROWS, MOST_FEATURES = 30_000, 20_000
#: Least z value of a log-count ratio, least documents with the n-gram, and smoothing.
LEAST_Z, LEAST_DOCS, SMOOTHING = 4.0, 5, 1.0

#: Bytes of text in one numpy pass; a pass takes some hundred bytes of memory for each.
SLICE = 500_000

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD[9:14] = 32
_FOLD = mix64(_FOLD + np.uint64(77))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_buckets(data: np.ndarray, offsets: np.ndarray):
    """For each n of GRAMS: the bucket of the n-gram that begins at each byte, and where one fits into its text."""
    x = _FOLD[data]
    h, power = np.zeros(len(x), np.uint64), np.uint64(1)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(x))  # bytes to the text's end
    with np.errstate(over="ignore"):
        for j in range(max(GRAMS)):
            h[: len(x) - j] += x[j:] * power
            power *= _BASE
            if j + 1 in GRAMS:
                at = ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93 + 2 * j)) >> np.uint64(64 - BUCKET_BITS)
                yield at.astype(np.int32), left > j


def _present(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once. place: the feature of a bucket, or -1."""
    found = []
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for at, fits in gram_buckets(data, offsets):
        f = place[at]
        hit = np.flatnonzero((f >= 0) & fits)
        found.append(doc_of[hit].astype(np.int64) * len(place) + f[hit])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // len(place), both % len(place)


class Classifier:
    """place: the feature of each bucket or -1; weight: of each feature, its scale included; bias."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, bias: float) -> None:
        self.place, self.weight, self.bias = place, weight, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = _present(data, offsets, self.place)
        z = np.bincount(doc, self.weight[feature], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _counts(batches):
    """Documents of both classes with each bucket, from one partition."""
    import pyarrow as pa

    n = np.zeros((2, 2**BUCKET_BITS), np.int64)
    size = [0, 0]
    for b in batches:
        data, offsets = arrow_bytes(b.column(1))
        labels = np.asarray(b.column(0))
        for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
            own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            doc, bucket = _present(own, off, np.arange(2**BUCKET_BITS, dtype=np.int32))
            for c in (0, 1):
                n[c] += np.bincount(bucket[labels[lo:hi][doc] == c], minlength=2**BUCKET_BITS)
                size[c] += int((labels[lo:hi] == c).sum())
    some = np.flatnonzero(n.sum(axis=0))
    rows = [pa.array(np.r_[-1, some]), pa.array(np.r_[size[0], n[0][some]]), pa.array(np.r_[size[1], n[1][some]])]
    yield pa.RecordBatch.from_arrays(rows, names=["bucket", "clean", "toxic"])


def _regression(sizes: np.ndarray, feature: np.ndarray, y: np.ndarray, scale: np.ndarray, rounds: int = 300, penalty: float = 1e-4, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression over scaled presence, by Adam on all rows. feature: each row's features, `sizes` of them, one
    row after another; they are read in slices of whole rows, so memory is feature's own and a slice's."""
    w, bias = np.ones(len(scale)) * 0.1, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m = np.zeros(len(w) + 1)
    v = np.zeros(len(w) + 1)
    first = np.r_[0, np.cumsum(sizes)]
    full = np.flatnonzero(sizes)
    slices = [full[lo:hi] for lo, hi in in_slices(sizes[full].tolist(), SLICE)] if len(full) else []
    for t in range(1, rounds + 1):
        each, slope = scale * w, np.zeros(len(w))
        d = np.full(len(y), bias)
        for own in slices:
            part = feature[first[own[0]] : first[own[-1] + 1]]
            d[own] += np.add.reduceat(each[part], first[own] - first[own[0]])
        d = (1 / (1 + np.exp(-np.clip(d, -40, 40))) - y) / len(y)
        for own in slices:
            slope += np.bincount(feature[first[own[0]] : first[own[-1] + 1]], np.repeat(d[own], sizes[own]), len(w))
        g = np.r_[slope * scale + penalty * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w * scale, bias


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> Classifier:
    """Fits a classifier to the texts that have a label (0 or 1), most_rows of them at most; of conflicting labels of a
    document the greater counts. Without labels of both classes all scores are 0 (or 1, if all labels are 1).

    Null labels and null keys of labels are left out; null texts count as empty. Rows of docs that repeat a labelled key
    are all read. Empty tables: as without labels. Further columns are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    some = written(known.orderBy(F.xxhash64(key), key).limit(most_rows), "labelled")  # most_rows rows bound this broadcast
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text")).join(F.broadcast(some), key).select("_label", "_text")
    rows = written(rows.repartition(8), "sample")
    counted = rows.mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = written(counted, "counts")
    total = counted.filter("bucket = -1").first()
    place = np.full(2**BUCKET_BITS, -1, np.int32)
    if total is None or not total["clean"] or not total["toxic"]:
        return Classifier(place, np.zeros(1), 40.0 if total is not None and total["toxic"] else -40.0)
    a, b = F.col("toxic") + SMOOTHING, F.col("clean") + SMOOTHING
    ratio = F.log(a / (total["toxic"] + 2 * SMOOTHING)) - F.log(b / (total["clean"] + 2 * SMOOTHING))
    z = F.abs(ratio) / F.sqrt(1 / a + 1 / b)
    best = counted.filter((F.col("bucket") >= 0) & (F.col("toxic") + F.col("clean") >= LEAST_DOCS)).select("bucket", ratio.alias("ratio"), z.alias("z"))
    best = best.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(MOST_FEATURES).toPandas()
    place[best["bucket"]] = np.arange(len(best), dtype=np.int32)
    scale = np.append(best["ratio"].to_numpy(float), 0.0)
    shared = spark.sparkContext.broadcast(place)

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = arrow_bytes(batch.column(1))
            found = []
            for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
                doc, feature = _present(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shared.value)
                found += np.split(feature.astype(np.int16), np.searchsorted(doc, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int16()))], names=["label", "features"])

    got = rows.mapInArrow(features, "label int, features array<short>").toArrow().combine_chunks()
    remove(some, rows, counted)
    y, lists = got.column("label").to_numpy().astype(float), got.column("features").combine_chunks()
    weight, bias = _regression(lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), y, scale)
    return Classifier(place, weight, bias)


def score(docs: DataFrame, model: Classifier, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` of docs, and `name` (no column of keep) from 0 to 1.

    A null or empty text gets the score of a text without any feature. Repeated rows and null keys are rows like others.
    Empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*(docs[f"`{c}`"] for c in keep), docs[text].cast("string").alias(free_name(keep, "_text")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = arrow_bytes(b.column(len(keep)))
            scores = [np.zeros(0)]
            for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
                scores.append(shared.value.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.concatenate(scores))], names=[*keep, name])

    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())]))


def held_out(key: str):
    """Whether crc32 of the id as text is divisible by 5 (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0
