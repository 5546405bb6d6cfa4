"""Approximate nearest neighbours by inner product: shifted space-filling curves.

Each curve is a Hilbert ordering of randomly projected and shifted vectors. Rows and queries of all curves are
range-partitioned together by (curve, place on it); each row's rank within its curve follows. A query meets the rows of
the blocks of ranks that its window touches, in every curve. Along the curves a vector travels as one byte a component;
the windows of all curves merge to a few times k rows a query, and these are reranked by the exact inner product of the
vectors as they are.

For the largest inner product rather than the smallest distance, rows get one more coordinate, sqrt(M^2 - |x|^2) with M
the greatest length, and queries are scaled to length M with that coordinate 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import global_rank, written
from .hilbert import hilbert_index
from .mips import by_blocks, common_lengths, keep_best, matrix, usable

CURVES, DIMS, BITS = 32, 12, 5
#: A window is this share of the rows to both sides, and LEAST_WINDOW rows at least. Vectors without structure in many
#: dimensions need windows in proportion to the table for a given recall; where there is structure, pass a fixed window.
WINDOW_SHARE, LEAST_WINDOW = 0.0105, 128
#: A window is so many blocks long to either side; rows from which the grid of the curves is measured.
BLOCKS_A_SIDE, SAMPLE = 2, 20_000
#: Rows a query that the merged windows keep for the exact product, as a multiple of k.
RERANK = 4


class Curves:
    """Projections, shifts and grid bounds of all curves."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = sample.shape[1]
        dims = min(DIMS, n)
        self.bases = [np.linalg.qr(rng.normal(size=(n, n)))[0][:, :dims] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 0.5, dims) for _ in range(curves)]
        self.low = [np.quantile(sample @ b, 0.001, axis=0) for b in self.bases]
        self.wide = [np.maximum(np.quantile(sample @ b, 0.999, axis=0) - lo, 1e-12) for b, lo in zip(self.bases, self.low)]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, curves): the place of each row on each curve."""
        out = np.empty((len(x), len(self.bases)), np.int64)
        for c, (b, shift, low, wide) in enumerate(zip(self.bases, self.shifts, self.low, self.wide)):
            # the rows fill half of each side of the grid; the shift moves them within it
            grid = ((x @ b - low) / wide * 0.5 + shift) * 2**BITS
            out[:, c] = hilbert_index(np.clip(grid, 0, 2**BITS - 1).astype(np.int64), BITS)
        return out


def lifted(x: np.ndarray, is_query: np.ndarray, most: float) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1))
    last = np.where(is_query, 0.0, np.sqrt(np.maximum(0.0, most * most - length * length)))
    return np.c_[x * np.where(is_query, most / length, 1.0)[:, None], last]


def _placed(rows: DataFrame, curves: Curves, most: float) -> DataFrame:
    """(curve, key, id, query, scale, code): each row once a curve, and each query once more. scale * code is the vector,
    rounded to 255 steps a component."""
    shared = rows.sparkSession.sparkContext.broadcast(curves)

    def place(batches):
        for pdf in batches:
            x = matrix(pdf["_vec"])
            scale = np.abs(x).max(axis=1) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            packed = np.array([c.tobytes() for c in code], object)
            for query, own in ((False, np.arange(len(x))), (True, np.flatnonzero(pdf["_query"].to_numpy(bool)))):
                if len(own):
                    keys = shared.value.keys(lifted(x[own], np.full(len(own), query), most))
                    for c in range(keys.shape[1]):
                        yield pd.DataFrame({"curve": np.int32(c), "key": keys[:, c], "_id": pdf["_id"].to_numpy()[own], "_query": query, "_scale": scale[own].astype(np.float32), "_code": packed[own]})

    return rows.select("_id", "_vec", "_query").mapInPandas(place, "curve int, key long, _id long, _query boolean, _scale float, _code binary")


class _Best:
    """The k best distinct rows of each query so far; what is found is gathered and cut now and then."""

    def __init__(self, k: int) -> None:
        self.k, self.held, self.n = k, [], 0
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        self.full, self.least = np.zeros(0, np.int64), np.zeros(0, np.float32)  # queries with k rows, and their worst score

    def floor(self, q_ids: np.ndarray) -> np.ndarray:
        """A row below this score is not among a query's k best."""
        if not len(self.full):
            return np.full(len(q_ids), -np.inf, np.float32)
        at = np.minimum(np.searchsorted(self.full, q_ids), len(self.full) - 1)
        return np.where(self.full[at] == q_ids, self.least[at], np.float32(-np.inf))

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.held.append((query, ids, scores))
        self.n += len(query)
        if self.n > max(200_000, len(self.best[0])):
            self.cut()

    def cut(self) -> None:
        query, ids, scores = (np.concatenate(c) for c in zip(self.best, *self.held))
        self.best, self.held, self.n = _distinct_best(query, ids, scores, self.k), [], 0
        query = self.best[0]
        last = np.flatnonzero(np.r_[query[1:] != query[:-1], True]) if len(query) else np.zeros(0, int)
        full = last[np.diff(np.r_[-1, last]) == self.k]
        self.full, self.least = query[full], self.best[2][full]


def _search(blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, near): the k best rows of each query among those it meets in the blocks of a partition, by
    rounded vectors; blocks are sorted."""

    def search(batches):
        best, pending = _Best(k), []

        def closed() -> None:
            ids, is_query, x = (np.concatenate(c) for c in zip(*pending))
            if is_query.all() or not is_query.any():
                return
            q_ids, q, c_ids, c = ids[is_query], x[is_query], ids[~is_query], x[~is_query]
            for i in range(0, len(q_ids), 512):
                own = q_ids[i : i + 512]
                scores = q[i : i + 512] @ c.T
                scores[own[:, None] == c_ids[None, :]] = -np.inf
                least = best.floor(own)
                if k < len(c_ids):
                    least = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
                a, b = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                best.add(own[a], c_ids[b], scores[a, b])

        group_before = None
        for pdf in batches:
            ids, is_query = pdf["_id"].to_numpy(np.int64), pdf["_query"].to_numpy(bool)
            x = np.frombuffer(b"".join(pdf["_code"]), np.int8).reshape(len(pdf), -1) * pdf["_scale"].to_numpy(np.float32)[:, None]
            group = (pdf["curve"].to_numpy(np.int64) << 40) + pdf["block"].to_numpy(np.int64)
            cuts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)] if len(group) else np.zeros(0, int)
            for s, e in zip(cuts[:-1], cuts[1:]):
                if pending and group_before != group[s]:
                    closed()
                    pending.clear()
                pending.append((ids[s:e], is_query[s:e], x[s:e]))
                group_before = group[s]
        if pending:
            closed()
        best.cut()
        yield pd.DataFrame({"query_id": best.best[0], "vec_id": best.best[1], "near": best.best[2].astype(float)})

    return blocks.mapInPandas(search, "query_id long, vec_id long, near double")


def _distinct_best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """keep_best() over distinct pairs: curves meet the same pair again, its product rounded otherwise at times."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])] if len(query) else np.zeros(0, bool)
    return keep_best(query[new], ids[new], scores[new], k)


def _reranked(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of pairs by the inner product of the vectors as they are, summed in
    their order as doubles, so that the same pair has the same score in every run. Of an id with several vectors the
    nearest counts."""
    a = rows.filter("_query").select(F.col("_id").alias("query_id"), F.col("_vec").alias("_a"))
    b = rows.select(F.col("_id").alias("vec_id"), F.col("_vec").alias("_b"))
    product = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_id", "vec_id").distinct().join(a, "query_id").join(b, "vec_id").filter("size(_a) = size(_b)")
    scored = scored.select("query_id", "vec_id", product.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", curves: int = CURVES, window: int | None = None, window_share: float = WINDOW_SHARE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `queries` holds, the k nearest other rows found, by the
    inner product of the vectors as doubles; ties go to the smaller id. All rows are indexed; the curves' grids are
    measured on SAMPLE rows at most. window: rows to each side on a curve; else window_share of all rows.

    Rows take no part whose vector is null, zero or holds null or non-finite components, and rows with a null id.
    Vectors meet only those of their own number of components; all but the most common numbers are searched without an
    index, in blocks. Rows with the query's id are its own row. Repeated rows count once. Empty table: no rows. Further
    columns are ignored.
    """
    spark = vectors.sparkSession
    length2 = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.filter(usable(F.col(vec)) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("_id"), F.col(vec).alias("_vec"), queries.alias("_query"), length2.alias("_n2"), F.size(vec).alias("_dims"))
    rows = written(rows.filter("_n2 > 0").dropDuplicates(["_id", "_vec"]), "vectors")
    found = None
    lengths, others = common_lengths(rows)
    for dims, n in lengths:
        own = rows.filter(F.col("_dims") == dims)
        most = float(np.sqrt(own.agg(F.max("_n2")).first()[0]))
        sample = own.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select(F.col("_vec").cast("array<double>").alias("_vec")).toArrow()
        x = np.asarray(sample.column("_vec").combine_chunks().flatten(), np.float64).reshape(-1, dims)
        measured = Curves(lifted(x, np.zeros(len(x), bool), most), curves)
        side = window if window is not None else max(LEAST_WINDOW, int(np.ceil(window_share * n)))
        size = max(1, -(-side // BLOCKS_A_SIDE))
        ranked = global_rank(_placed(own, measured, most), ["curve", "key", "_id", "_query"], "_rank", "curves")
        first, last = F.expr(f"(_rank - {side}) div {size}"), F.expr(f"(_rank + {side}) div {size}")
        block = F.when(F.col("_query"), F.sequence(F.greatest(first, F.lit(0)), last)).otherwise(F.array(F.expr(f"_rank div {size}")))
        met = ranked.select("curve", F.explode(block).alias("block"), "_query", "_id", "_scale", "_code")
        met = met.repartition("curve", "block").sortWithinPartitions("curve", "block")
        w = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
        merged = _search(met, RERANK * k).groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
        merged = merged.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= RERANK * k).select("query_id", "vec_id")
        found = merged if found is None else found.unionByName(merged)
    if others is not None:
        rest = by_blocks(others, k)
        found = rest if found is None else found.unionByName(rest)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _reranked(found, rows, k)
