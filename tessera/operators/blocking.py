"""Token blocking: an inverted-index join on rare tokens within a country.

Names and addresses are two key spaces. A record of the reference source keeps its rarest keys; each key it shares with a
target record adds its inverse document frequency to the pair's score. Keys above a document frequency are dropped, so a
key makes that many rows at most for each reference record that keeps it; how many of these there are is not bounded.
Only a table of all pair scores holds these rows. For the best candidates, blocks of records meet parts of the targets that
hold their keys; a part sums scores in one array and returns the best of each record, so no pair is shuffled before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.sources.stages import staged

from .keys import CAND, PAIR, S1

#: Keys above this document frequency are dropped; a record keeps so many keys a side; candidates kept a record.
MAX_DF, KEYS, TOP_K = 20_000, 10, 40
#: Scores are rounded to so many digits before they order rows: the order of a sum must not decide.
DIGITS = 9
#: Records of a block, and (key, target) rows of a part that it meets, on average.
BLOCK, PART = 16_384, 400_000
#: Bits of the filter that keeps targets' unselected keys out of the shuffle; its words are broadcast.
FILTER_BITS = 2**24


def address_keys(records: DataFrame) -> Column:
    """Each record's distinct address tokens: its column address_keys, if a table of records has these made before."""
    return F.col("address_keys") if "address_keys" in records.columns else F.array_distinct(text.tokenize(F.col("address_normalized")))


def record_keys(records: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(id, country, side, token): each record's distinct name tokens but stopwords, and address tokens."""
    sides = F.array(
        F.struct(F.lit("name").alias("side"), F.array_distinct(text.blocking_tokens(F.col("name_tokens"))).alias("tokens")),
        F.struct(F.lit("address").alias("side"), address_keys(records).alias("tokens")),
    )
    return (
        records.select(F.col(id_col).alias("id"), "country", F.explode(sides).alias("s"))
        .select("id", "country", "s.side", F.explode("s.tokens").alias("token"))
    )


def document_frequency(keys: DataFrame) -> DataFrame:
    """(country, side, token, df): records that hold a key; a record counts once."""
    return keys.groupBy("country", "side", "token").agg(F.count("*").alias("df"))


def country_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count("*").alias("n_docs"))


def idf(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """df with idf = ln(n / df) of the country's n target records."""
    return df.join(sizes, "country").withColumn("idf", F.log(F.col("n_docs") / F.col("df")))


def rare_keys(query_keys: DataFrame, weights: DataFrame, max_df: int = MAX_DF, keys: int = KEYS) -> DataFrame:
    """(id, country, side, token, df, idf): of each record and side the rarest keys that targets hold, max_df at most;
    ties by token. A record whose keys are all too frequent keeps none."""
    usable = weights.filter(F.col("df") <= max_df).select("country", "side", "token", "df", "idf").hint("shuffle_hash")
    w = Window.partitionBy("id", "side").orderBy("df", "token")
    ranked = query_keys.join(usable, ["country", "side", "token"]).withColumn("_r", F.row_number().over(w))
    return ranked.filter(F.col("_r") <= keys).select("id", "country", "side", "token", "df", "idf")


def pair_scores(selected: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(S1, candidate, country, score) of pairs that share a key and score above 0."""
    q = selected.select(F.col("id").alias(S1), "country", "side", "token", "idf")
    t = target_keys.select(F.col("id").alias(CAND), "country", "side", "token")
    scored = q.join(t, ["country", "side", "token"]).groupBy(*PAIR, "country").agg(F.round(F.sum("idf"), DIGITS).alias("score"))
    return scored.filter("score > 0")


def top_k(pairs: DataFrame, k: int = TOP_K, score: str = "score") -> DataFrame:
    """The k best candidates of each record; ties by candidate id."""
    w = Window.partitionBy(S1).orderBy(F.desc_nulls_last(score), CAND)
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _holding(target_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """target_keys that are among keys, and a few others: those whose bit some key has set."""
    bit = F.pmod(F.xxhash64("country", "side", "token"), F.lit(FILTER_BITS))
    word, mask = F.shiftright(bit, 6).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(country, side, token), {FILTER_BITS}) & 63 as int))")
    words = keys.select(word.alias("_w"), mask.alias("_m")).groupBy("_w").agg(F.bit_or("_m").alias("_bits"))
    marked = target_keys.withColumns({"_w": word, "_m": mask}).join(F.broadcast(words), "_w")
    return marked.filter(F.col("_bits").bitwiseAND(F.col("_m")) != 0).drop("_w", "_m", "_bits")


def _best_of_part(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of one part, rows (country, key, idf, s1, null) and (null, key, null, null, cand): each record's k best candidates."""

    def run(rows: pa.Table) -> pa.Table:
        is_key = rows.column("idf").is_valid()
        mine, theirs = rows.filter(is_key), rows.select(["key", "cand"]).filter(pc.invert(is_key))
        country, idf = mine.column("country")[0], mine.column("idf").to_numpy()
        keys, of = np.unique(mine.column("key").to_numpy(), return_inverse=True)
        # s1 and candidates as places in the order of their ids
        s1s, s1 = _places(mine.column("s1"))
        cands, code = _places(theirs.column("cand"))
        pair = np.searchsorted(keys, theirs.column("key").to_numpy()) * max(1, len(cands)) + code
        pair, times = np.unique(pair, return_counts=True)
        code = pair % max(1, len(cands))
        ends = np.searchsorted(pair, np.arange(len(keys) + 1) * max(1, len(cands)))
        repeated = len(times) > 0 and times.max() > 1  # an id that several target records have
        by_record = np.lexsort((idf, s1))
        starts = np.searchsorted(s1[by_record], np.arange(len(s1s) + 1))
        own, weight = of[by_record], idf[by_record]
        total = np.zeros(len(cands))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i in range(len(s1s)):
            seen = []
            for j, w in zip(own[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]]):
                a, b = ends[j], ends[j + 1]
                if a == b:
                    continue
                c = code[a:b]
                before = total[c]
                seen.append(c[before == 0] if seen else c)
                total[c] = before + (w * times[a:b] if repeated else w)
            if not seen:
                continue
            c = np.concatenate(seen)
            score = total[c]
            total[c] = 0
            if len(c) > k:
                near = np.round(score, DIGITS)
                least = np.partition(near, len(c) - k)[len(c) - k]
                above, level = np.flatnonzero(near > least), np.flatnonzero(near == least)
                if len(level) > k - len(above):
                    level = level[np.argsort(c[level])[: k - len(above)]]
                kept = np.r_[above, level]
                c, score = c[kept], score[kept]
            found.append((i, c, score))
        n = [len(c) for _, c, _ in found]
        none = np.zeros(0, np.int64)
        left = s1s.take(pa.array(np.repeat(np.array([i for i, _, _ in found], np.int64), n)))
        right = cands.take(pa.array(np.concatenate([none, *(c for _, c, _ in found)])))
        score = pa.array(np.concatenate([np.zeros(0), *(s for _, _, s in found)]))
        return pa.table([left, right, pa.array([country.as_py()] * len(score), pa.string()), score], [*PAIR, "country", "score"])

    return run


def _places(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids in ascending order, null first, and the place of each id among them."""
    whole = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], ids.type)
    coded = whole.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def best_pairs(selected: DataFrame, target_keys: DataFrame, k: int = TOP_K) -> DataFrame:
    """top_k(pair_scores(selected, target_keys), k) without a table of all pairs.

    A block of BLOCK records of a country meets the targets that hold its keys in parts by a hash of their ids, as many as
    give PART rows each. A part has all keys of its targets, so its scores are whole and its best k hold those of all.
    """
    key = ["country", "side", "token"]
    selected = staged(selected.filter("idf > 0"), "selected")
    blocks = max(1, -(-selected.select("id", "country").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    lists = selected.groupBy(*key, block.alias("_b")).agg(F.first("df").alias("df"))
    lists = staged(lists.withColumn("key", F.monotonically_increasing_id()), "lists")
    sizes = lists.groupBy("country", "_b").agg(F.ceil(F.sum("df") / PART).cast("int").alias("_parts"))  # a row a block
    upto = Window.orderBy("country", "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_first", F.sum("_parts").over(upto).cast("int") - F.col("_parts"))
    lists = lists.drop("df").join(F.broadcast(sizes), ["country", "_b"])
    parts = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1))
    records = selected.withColumn("_b", block).join(lists, [*key, "_b"]).select(parts.alias("_p"), "country", "key", "idf", F.col("id").alias("s1"))
    part = (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int")
    wanted = lists.select(*key, "key", "_first", "_parts").hint("shuffle_hash")
    held = _holding(target_keys, lists.select(*key).distinct()).join(wanted, key).select(part.alias("_p"), "key", F.col("id").alias("cand"))
    rows = records.unionByName(held, allowMissingColumns=True)
    kinds = {S1: selected.schema["id"].dataType, CAND: target_keys.schema["id"].dataType, "country": T.StringType(), "score": T.DoubleType()}
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    found = rows.groupBy("_p").applyInArrow(_best_of_part(k), schema)
    return staged(top_k(found.withColumn("score", F.round("score", DIGITS)).filter("score > 0"), k), "best")


def select_keys(source1: DataFrame, targets: DataFrame, max_df: int = MAX_DF, keys: int = KEYS) -> tuple[DataFrame, DataFrame]:
    """The selected keys of source1 and all keys of targets."""
    target_keys = record_keys(targets)
    weights = idf(document_frequency(target_keys), country_sizes(targets))
    return rare_keys(record_keys(source1), weights, max_df, keys), target_keys


def token_blocking(source1: DataFrame, targets: DataFrame, max_df: int = MAX_DF, keys: int = KEYS, k: int = TOP_K) -> DataFrame:
    """(S1, candidate, score, country). A country without target records yields nothing."""
    selected, target_keys = select_keys(source1, targets, max_df, keys)
    return best_pairs(selected, target_keys, k).select(*PAIR, "score", "country")


def recall_ceiling(truth: DataFrame, selected: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(S1, matched_id) of the true pairs that share a selected key."""
    q = selected.select(F.col("id").alias(S1), "country", "side", "token")
    t = target_keys.select(F.col("id").alias("matched_id"), "country", "side", "token")
    return truth.join(q, S1).join(t, ["matched_id", "country", "side", "token"], "left_semi").select(S1, "matched_id").distinct()


def diagnostics(source1: DataFrame, targets: DataFrame, candidates: DataFrame, truth: DataFrame | None = None, reachable: DataFrame | None = None) -> DataFrame:
    """Per country: records, pairs, pairs a record, reduction ratio and, with truth, recall at k and its ceiling."""
    n_q = source1.groupBy("country").agg(F.count("*").alias("n_query"))
    n_t = targets.groupBy("country").agg(F.count("*").alias("n_target"))
    n_p = candidates.groupBy("country").agg(F.count("*").alias("n_candidate_pairs"))
    out = n_q.join(n_t, "country").join(n_p, "country", "left").na.fill(0, ["n_candidate_pairs"])
    pairs = F.col("n_candidate_pairs")
    out = out.withColumns(
        {
            "avg_candidates_per_entity": F.coalesce(F.try_divide(pairs, F.col("n_query")), F.lit(0.0)),
            "reduction_ratio": 1 - F.try_divide(pairs.cast("double"), F.col("n_query") * F.col("n_target")),
        }
    )
    if truth is None:
        return out
    homes = truth.join(source1.select(F.col("entity_id").alias(S1), "country"), S1)
    kept = candidates.select(S1, F.col(CAND).alias("matched_id")).withColumn("_kept", F.lit(1))
    seen = homes.join(kept, [S1, "matched_id"], "left")
    if reachable is not None:
        seen = seen.join(reachable.withColumn("_reach", F.lit(1)), [S1, "matched_id"], "left")
    else:
        seen = seen.withColumn("_reach", F.lit(None).cast("int"))
    gt = seen.groupBy("country").agg(
        F.count("*").alias("n_gt_pairs"), (F.count("_reach") / F.count("*")).alias("recall_ceiling"), (F.count("_kept") / F.count("*")).alias("recall_at_k")
    )
    return out.join(gt, "country", "left")
