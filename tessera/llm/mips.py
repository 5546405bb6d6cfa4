"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are range-partitioned by length, longest first, and read in buckets of rows with similar length. The k-th best
score a query has so far, over the query's length and the bucket's greatest length, is the cosine that a row of this
bucket must reach. Above 1, the bucket is skipped. If it is high, rows are pruned by the query's strongest coordinate:
a row whose share of that coordinate is outside the range that the cosine allows cannot reach it. Else rows too short to
reach the score are pruned. What is left is verified by the exact product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import global_rank, written

#: Queries that are searched in one pass over the vectors; they are broadcast, so this bounds the broadcast.
WAVE = 16_384
#: Longest vectors that give each query its first threshold, and rows of a bucket.
HEAD, BUCKET = 2_048, 1_024
#: So many numbers of components, the most common ones, are searched by buckets or curves; vectors of others in plain blocks.
LENGTHS = 64
#: From this local cosine on, pruning by a coordinate pays.
COORDINATE_FROM = 0.6
#: Float bounds prune only what is below the threshold by more than this part.
SLACK = 1e-9


def usable(vec: Column) -> Column:
    """Not null and without null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors], np.float64)


def keep_best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: greatest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = place < k
    return query[keep], ids[keep], scores[keep]


def common_lengths(rows: DataFrame) -> tuple[list[tuple[int, int]], DataFrame | None]:
    """The most common numbers of components (_dims) of rows that hold a query, as (number, rows), and the rows that have
    another one (None if there are none)."""
    most = LENGTHS
    counts = rows.groupBy("_dims").agg(F.count("*").alias("n"), F.max(F.col("_query").cast("int")).alias("q")).filter("q = 1")
    found = [(r["_dims"], r["n"]) for r in counts.orderBy(F.desc("n"), "_dims").limit(most).collect()]
    others = rows.join(counts.select("_dims"), "_dims", "left_semi").filter(~F.col("_dims").isin([d for d, _ in found]))
    return found, others if len(found) == most and not others.isEmpty() else None


def by_blocks(rows: DataFrame, k: int, part: int = 4_096) -> DataFrame:
    """(query_id, vec_id) of the k best rows of each query of rows (_id, _vec, _query, _dims) with as many components, in
    each part of about `part` rows, ties to the smaller id: every row meets every query of its number of components, in
    parts of bounded size. For numbers of components that few rows have."""
    n = F.ceil(F.col("n") / part).cast("int")
    known = rows.join(rows.groupBy("_dims").agg(F.count("*").alias("n")).select("_dims", n.alias("_n")), "_dims")
    parted = known.select("_dims", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int").alias("_p"), "_id", "_vec")
    asked = known.filter("_query").select(*(F.col(c).alias(c) for c in ("_dims", "_id", "_vec")), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_p"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(q) and len(c):
            ids, x = c["_id"].to_numpy(np.int64), matrix(c["_vec"])
            for i in range(0, len(q), 512):
                own, scores = q["_id"].to_numpy(np.int64)[i : i + 512], matrix(q["_vec"].iloc[i : i + 512]) @ x.T
                a, b = np.nonzero(own[:, None] != ids[None, :])
                best = keep_best(own[a], ids[b], scores[a, b], k)
                found = tuple(np.r_[x, y] for x, y in zip(found, best))
        return pd.DataFrame({"query_id": found[0], "vec_id": found[1]})

    return asked.groupBy("_dims", "_p").cogroup(parted.groupBy("_dims", "_p")).applyInPandas(search, "query_id long, vec_id long")


class Searcher:
    """Running top-k of a wave of queries over buckets of rows, in one task."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.q_ids, self.q, self.k = q_ids, q, k
        self.length = np.sqrt((q * q).sum(axis=1))
        self.least = floor.copy()  # a row below this score is not among a query's k best
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.nan_to_num(q / self.length[:, None])
        self.focus = np.abs(self.unit).argmax(axis=1) if q.shape[1] else np.zeros(len(q), int)

    def _found(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        b = self.best
        query, ids, scores = keep_best(np.r_[b[0], rows], np.r_[b[1], ids], np.r_[b[2], scores], self.k)
        self.best = query, ids, scores
        if len(query):
            last = np.flatnonzero(np.r_[query[1:] != query[:-1], True])
            full = np.diff(np.r_[-1, last]) == self.k
            at = query[last[full]]
            self.least[at] = np.maximum(self.least[at], scores[last[full]])

    def _verify(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for i in range(0, len(rows), 1024):
            own = rows[i : i + 1024]
            scores = self.q[own] @ x.T
            keep = (scores >= self.least[own][:, None]) & (ids[None, :] != self.q_ids[own][:, None])
            a, b = np.nonzero(keep)
            if len(a):
                self._found(own[a], ids[b], scores[a, b])

    def bucket(self, ids: np.ndarray, x: np.ndarray) -> None:
        length = np.sqrt((x * x).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        ids, x, length = ids[order], x[order], length[order]
        most = self.length * length[0] * (1 + SLACK)
        active = np.flatnonzero(most >= self.least)
        if not len(active):
            return
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(most[active] > 0, self.least[active] / most[active], -np.inf)
        by_coordinate = (cosine >= COORDINATE_FROM) & (length[-1] > 0)
        for i, t in zip(active[by_coordinate], np.minimum(cosine[by_coordinate], 1.0)):
            f, u = self.focus[i], self.unit[i, self.focus[i]]
            wide = np.sqrt(max(0.0, (1 - t * t) * (1 - min(1.0, u * u)))) + SLACK
            # a shorter row needs a greater cosine than t: its range lies on the side of u
            share = x[:, f] / length
            rows = np.flatnonzero(share >= t * u - wide) if u > 0 else np.flatnonzero(share <= t * u + wide)
            if len(rows):
                self._verify(np.array([i]), ids[rows], x[rows])
        rest = active[~by_coordinate]
        if len(rest):
            with np.errstate(invalid="ignore", divide="ignore"):
                need = np.where(self.length[rest] > 0, self.least[rest] / self.length[rest] * (1 - SLACK), -np.inf)
            reach = np.searchsorted(-length, -need, side="right")  # rows at least as long as needed come first
            for lo, hi in ((0, len(x) // 4), (len(x) // 4, len(x) // 2), (len(x) // 2, len(x))):
                some = rest[(reach > lo) & (reach <= hi)]
                if len(some):
                    self._verify(some, ids[:hi], x[:hi])


def _wave(vectors: DataFrame, q_ids: np.ndarray, q: np.ndarray, head_ids: np.ndarray, head: np.ndarray, k: int) -> DataFrame:
    first = Searcher(q_ids, q, np.full(len(q), -np.inf), k)
    if len(head):
        first.bucket(head_ids, head)
    floor, dims = first.least, q.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q, floor))

    def search(batches):
        s = Searcher(*shared.value, k)
        for pdf in batches:
            pdf = pdf[pdf["_vec"].map(len) == dims]
            ids, x = pdf["_id"].to_numpy(np.int64), matrix(pdf["_vec"]).reshape(len(pdf), dims)
            for i in range(0, len(pdf), BUCKET):
                s.bucket(ids[i : i + BUCKET], x[i : i + BUCKET])
        rows, ids, scores = s.best
        yield pd.DataFrame({"query_id": s.q_ids[rows], "vec_id": ids, "score": scores.astype(np.int64)})

    found = vectors.select("_id", "_vec").mapInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _scored(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of pairs by the product of their vectors."""
    a = rows.filter("_query").dropDuplicates(["_id"]).select(F.col("_id").alias("query_id"), F.col("_vec").alias("_a"))
    b = rows.select(F.col("_id").alias("vec_id"), F.col("_vec").alias("_b"))
    product = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).cast("long")
    scored = pairs.distinct().join(a, "query_id").join(b, "vec_id").filter("size(_a) = size(_b)").select("query_id", "vec_id", product.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vec: str = "embedding", wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `queries` holds, the k other rows with the greatest inner
    product of components floor(scale * x); ties go to the smaller id. Products are exact while they stay below 2 ** 53.

    Rows whose vector is null or holds null or non-finite components, and rows with a null id, take no part. Vectors
    meet only those of their own number of components. Rows that repeat a query's id count as its own row. Empty table:
    no rows. Further columns are ignored.
    """
    spark = vectors.sparkSession
    ints = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.filter(usable(F.col(vec)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), ints.alias("_vec"), queries.alias("_query"))
    rows = rows.withColumn("_n2", F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x * x)).withColumn("_dims", F.size("_vec"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(rows.repartitionByRange(parts, F.desc("_n2")).sortWithinPartitions(F.desc("_n2")), "by-length")
    out = None
    lengths, others = common_lengths(rows)
    for dims, _ in lengths:
        own = rows.filter(F.col("_dims") == dims)
        asked = own.filter("_query").dropDuplicates(["_id"])
        top = own.orderBy(F.desc("_n2"), "_id").limit(HEAD).toPandas()
        head_ids, head = top["_id"].to_numpy(np.int64), matrix(top["_vec"]).reshape(len(top), dims)
        waves = -(-asked.count() // wave)
        if waves > 1:
            asked = written(global_rank(asked, ["_id"], "_place"), "queries")
        for n in range(waves):
            some = (asked if waves == 1 else asked.filter(F.expr(f"_place div {wave} = {n}"))).select("_id", "_vec").toPandas()
            q_ids, q = some["_id"].to_numpy(np.int64), matrix(some["_vec"]).reshape(len(some), dims)
            found = _wave(own, q_ids, q, head_ids, head, k)
            found = found if waves == 1 else written(found, "found")
            out = found if out is None else out.unionByName(found)
    if others is not None:
        out = _scored(by_blocks(others, k), others, k) if out is None else out.unionByName(_scored(by_blocks(others, k), others, k))
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out
