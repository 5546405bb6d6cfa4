"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Of two collections of small sketches (R minhashes each), every pair of one sketch from each makes a table key: M + M
sketches give M * M tables, for 2 * M * R minhash values rather than 2 * M * M * R. Documents with equal sets are one
class from the start. Documents that share a key form a group; its members are compared with one of them, its centre.

No link may be lost in a group of which some members are not linked with the centre c. If |x & c| is too small for x to
be linked with c, then each y linked with x shares with x shingles that c lacks, or is smaller than c by so much that
x & c alone makes the link (which needs |x & c| >= 0.85 |x|). So members meet again in smaller groups, by centre and
shingle that the centre lacks (the first few in hash order, by the number that must be shared, or sketches of all that it
lacks), and by centre alone for the few of the other kind. Groups that are small then are compared pair by pair; those
that are not, as in families of thousands of copies of a text that is not among them, by products of blocks in bounded
memory.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_bytes, bounded_batches, in_slices, mix64, packed, remove, unpacked, words_of, written

#: Sketches of each collection, and minhashes of a sketch: a pair at similarity 0.85 meets in some table with
#: probability (1 - (1 - 0.85 ** R) ** M) ** 2 = 0.999, one at 0.9 with 0.9999.
M, R = 8, 3
#: Sketches of each collection for links from 80 percent on: (1 - (1 - 0.8 ** R) ** M_80) ** 2 = 0.999.
M_80 = 11
WORDS = 5
#: Bytes of text in one numpy pass; a pass takes some hundred bytes of memory for each.
SLICE = 500_000
#: Link if 100 * |x & y| >= percent * |x | y|; PERCENT, unless another is asked for.
PERCENT = 85
#: Groups around a centre of at most so many members are compared pair by pair; larger ones in blocks of about BLOCK.
SMALL, BLOCK = 64, 384

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD = mix64(_FOLD + np.uint64(1))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = mix64(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_XOR, _TIMES = mix64(np.arange(100, 100 + 2 * M_80 * R, dtype=np.uint64)), mix64(np.arange(500, 500 + 2 * M_80 * R, dtype=np.uint64)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                _powers[i] = np.multiply.accumulate(p)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z folded."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right")))
            lo, hi = int(starts[at]), int(ends[upto - 1])
            power, inverse = _grown(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_FOLD[data[lo:hi]] * power[: hi - lo], out=sums[1:])
            s, e = starts[at:upto] - lo, ends[at:upto] - lo
            out[at:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
            at = upto
    return mix64(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, counts = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    first = np.r_[0, np.cumsum(counts)]
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WORDS + 1)
        sums = np.zeros(n, np.uint64)
        for k in range(WORDS):
            sums += words[k : k + n] * _PLACES[k]
        sums = mix64(sums)
        out = []
        for i, c in enumerate(counts):
            a = first[i]
            if c >= WORDS:
                s = np.sort(sums[a : a + c - WORDS + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif c:
                out.append(mix64(np.array([(words[a : a + c] * _PLACES[:c]).sum() + np.uint64(c)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets that are not empty: (sets, 2 * m) sketches, and two hashes of each whole set."""
    flat = np.concatenate(sets)
    first = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.zeros((len(sets), 2 * m), np.uint64)
    with np.errstate(over="ignore"):
        for h in range(2 * m * R):
            least = np.minimum.reduceat((flat ^ _XOR[h]) * _TIMES[h], first)
            out[:, h // R] = mix64(out[:, h // R] + least + np.uint64(h))
        one = np.add.reduceat(flat, first)
        two = np.bitwise_xor.reduceat(mix64(flat + np.uint64(9)), first)
    return out, one, two


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", m: int = M) -> DataFrame:
    """(key, n, one, two, sketch): the size of the shingle set, its two hashes and its sketches (null if it is empty)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = arrow_bytes(b.column(1))
            rows = b.num_rows
            n, one, two, sketch = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros((rows, 2 * m), np.int64)
            for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n[lo:hi] = [len(s) for s in sets]
                own = lo + np.flatnonzero(n[lo:hi])
                if len(own):
                    s, x, y = sketches([sets[i - lo] for i in own], m)
                    sketch[own], one[own], two[own] = s.view(np.int64), x.view(np.int64), y.view(np.int64)
            empty = n == 0
            at = np.r_[0, np.cumsum(np.where(empty, 0, 2 * m))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(sketch[~empty].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(one), pa.array(two), lists], names=[key, "n", "one", "two", "sketch"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, one long, two long, sketch array<long>")


#: Bytes of a shingle's hash in a stored set: two different shingles of a pair of documents with a thousand shingles
#: each share them with probability 4e-9.
WIDE = 6


def _packed(s: np.ndarray) -> bytes:
    """The highest WIDE bytes of sorted hashes."""
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // WIDE, 8), np.uint8)
    out[:, 8 - WIDE :] = raw.reshape(-1, WIDE)
    return out.view(">u8").ravel().astype(np.int64)


#: Bits of the filter that keeps sets of documents without a partner from being stored: BITS_EACH a document that has
#: one, MOST_BITS (16 MB) at most, which bounds its broadcast. Beyond, more sets are stored than needed; none is missed.
BITS_EACH, MOST_BITS = 16, 2**27


def _filter_bits(nodes: DataFrame) -> np.ndarray:
    """A bit array with the bits of all nodes set, as 64-bit words."""
    bits = min(MOST_BITS, max(2**16, 2 ** int(np.ceil(np.log2(max(1, nodes.count()) * BITS_EACH)))))
    bit = F.pmod(F.xxhash64("node"), F.lit(bits))
    words = nodes.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(node), 64) as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # MOST_BITS / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def stored_sets(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(x, xs): the sets of the documents whose key is in nodes (node), and of few others; texts are not shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_filter_bits(nodes))
    rows = docs.select(F.col(key).cast("long").alias("x"), F.col(text).cast("string").alias("_text")).filter("x is not null")
    rows = rows.withColumn("h", F.xxhash64("x"))

    def run(batches):
        import pyarrow as pa

        bits = shared.value
        for b in batches:
            h = b.column(2).to_numpy().astype(np.int64) & (len(bits) * 64 - 1)
            b = b.filter(pa.array((bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1))
            data, offsets = arrow_bytes(b.column(1))
            packed = []
            for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
                packed += [_packed(s) for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["x", "xs"])

    return rows.mapInArrow(run, "x long, xs binary")


def _meeting_keys(rest: np.ndarray, shared: int) -> np.ndarray:
    """Keys under which two members meet that share `shared` or more of the shingles that their centre lacks.

    If few need be shared: the first shingles in hash order, so many that one must be common. If most must be, the
    rests are similar sets: their sketches. In between both, as the other member may be on either side.
    """
    keys = [rest[: max(0, len(rest) - shared + 1)]] if 3 * shared <= 2 * len(rest) else []
    if 3 * shared >= len(rest) > 0:
        with np.errstate(over="ignore"):
            least = ((rest.astype(np.uint64)[:, None] ^ _XOR[: 2 * M * R]) * _TIMES[: 2 * M * R]).min(axis=0).reshape(2 * M, R)
            sketch = mix64(mix64(least + np.arange(R, dtype=np.uint64)).sum(axis=1) + np.arange(2 * M, dtype=np.uint64))
        keys.append(sketch.view(np.int64))
    return np.concatenate(keys) if keys else rest[:0]


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(c, node, more) with linked, size, room and adds. adds: shingles of node that c lacks, as many as a link between
    two members that does not rest on c must hit. room: the greatest size of a y that x & c alone may link with x."""
    one = pairs.join(sets, pairs["c"] == sets["x"]).select("c", "node", "more", F.col("xs").alias("cs"))
    both = one.join(sets, one["node"] == sets["x"]).select("c", "node", "more", "cs", "xs")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            more = b.column(2).to_pylist()
            (cs, c_at), (xs, x_at) = arrow_bytes(b.column(3)), arrow_bytes(b.column(4))
            linked, size, room, adds = [], [], [], []
            for i in range(b.num_rows):
                c, x = _unpacked(cs[c_at[i] : c_at[i + 1]]), _unpacked(xs[x_at[i] : x_at[i + 1]])
                at = np.searchsorted(c, x)
                held = c[np.minimum(at, len(c) - 1)] == x if len(c) else np.zeros(len(x), bool)
                m = int(held.sum())
                link = 100 * m >= percent * (len(c) + len(x) - m)
                linked.append(link)
                size.append(len(x))
                room.append((100 * m) // percent + m - len(x) if not link and 100 * m >= percent * len(x) else None)
                if more[i]:
                    adds.append(_meeting_keys(x[~held], max(1, -(-percent * len(x) // 100) - m)))
                else:
                    adds.append(None)
            cols = [b.column(0), b.column(1), b.column(2), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(room, pa.int64()), pa.array(adds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["c", "node", "more", "linked", "size", "room", "adds"])

    return both.mapInArrow(run, "c long, node long, more boolean, linked boolean, size long, room long, adds array<long>")


def table_groups(classes: DataFrame, m: int = M) -> DataFrame:
    """(g, node, rank): the table keys of the classes (node, sketch), without those that surely are a node's own.

    A key can be shared only if both its sketches are. How many nodes share a node's sketches also ranks it: of a family
    of copies the text they come from shares most, and it makes the best centre.
    """
    each = classes.select("node", F.posexplode("sketch").alias("i", "s"))
    shared = each.groupBy("i", "s").agg(F.count("*").alias("m")).filter("m > 1")
    known = each.join(shared, ["i", "s"]).groupBy("node").agg(F.sum("m").alias("rank"), F.collect_list(F.struct("i", "s")).alias("own"))  # 2 * m at most
    rank = F.least("rank", F.lit(2**40)) * 2**20 + F.pmod(F.xxhash64("node"), F.lit(2**20))
    one, two = F.filter("own", lambda x: x["i"] < m), F.filter("own", lambda x: x["i"] >= m)
    tables = known.select("node", rank.alias("rank"), F.explode(one).alias("one"), two.alias("two")).select("node", "rank", "one", F.explode("two").alias("two"))
    return tables.select(F.xxhash64("one.i", "one.s", "two.i", "two.s").alias("g"), "node", "rank")


def _star_pairs(groups: DataFrame) -> DataFrame:
    """(c, node, more) for groups (g, node, rank): each member with the centre, the member with the greatest rank; more:
    some group of theirs has further members, between which links may be left."""
    heads = groups.groupBy("g").agg(F.max_by("node", "rank").alias("c"), F.count("*").alias("m")).filter("m > 1")
    members = groups.select("g", "node").join(heads, "g").filter("node != c")
    return members.groupBy("c", "node").agg(F.max(F.col("m") > 2).alias("more"))


def _small_pairs(members: DataFrame) -> DataFrame:
    """(c, node, more) for all pairs of groups of SMALL members at most."""
    other = members.select("g", F.col("node").alias("c"))
    return members.select("g", "node").join(other, "g").filter("c < node").select("c", "node").distinct().withColumn("more", F.lit(False))


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the linked members of families (f, node), found by products of blocks of members.

    Members are dealt to blocks of about BLOCK by hash. A pair of blocks is one group of bounded size: which of its
    members are linked comes from the product of their incidence matrices over shared shingles, in parts of the columns,
    and what leaves is one row a member that has a link, not a row a pair.
    """
    sizes = members.groupBy("f").agg(F.count("*").alias("m"))
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.join(sizes, "f").select("f", "node", F.pmod(F.xxhash64("node"), n).cast("int").alias("p"), n.alias("n")).join(sets, F.col("node") == F.col("x"))
    dealt = dealt.select("f", "node", "xs", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"))
    dealt = dealt.select("f", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "node", "xs")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [_unpacked(np.frombuffer(x, np.uint8)) for x in pdf["xs"]]
        size = np.array([len(x) for x in own])
        shingle, column, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(own)), size)
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(own), len(own)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            s, e = np.searchsorted(column, [lo, lo + 2048])
            part = np.zeros((len(own), 2048), np.float32)
            part[row[s:e], column[s:e] - lo] = 1
            both += part @ part.T
        linked = 100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))
        np.fill_diagonal(linked, True)
        label, before = np.arange(len(own)), None
        while before is None or (label != before).any():
            before = label
            label = np.where(linked, label[None, :], len(own)).min(axis=1)
        node = pdf["node"].to_numpy()
        joined = np.flatnonzero(label != np.arange(len(own)))
        return pd.DataFrame({"a": node[joined], "b": node[label[joined]]})

    return dealt.groupBy("f", "p", "q").applyInPandas(links, "a long, b long")


def _next_groups(compared: DataFrame) -> DataFrame:
    """Groups (g, node) in which links between members may be left."""
    star = compared.filter("more")
    open_ = star.groupBy("c").agg(F.max(~F.col("linked")).alias("_open"), F.max("room").alias("_room"), F.min("size").alias("_least")).filter("_open")
    rows = star.join(open_, "c")
    by_shingle = rows.select(F.explode("adds").alias("a"), "c", "node", "linked").select(F.xxhash64("c", "a").alias("g"), "node", "linked")
    by_size = rows.filter("size <= _room or room >= _least").select(F.xxhash64("c", F.lit("size")).alias("g"), "node", "linked")
    both = by_shingle.unionByName(by_size)
    left = both.groupBy("g").agg(F.count("*").alias("_m"), F.max(~F.col("linked")).alias("_open")).filter("_m > 1 and _open").select("g")
    return both.select("g", "node").join(left, "g", "left_semi").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes of edges (a, b), by alternating large and small stars."""

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := tuple(state(e))) != before:
        before, last = now, e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = written(small.filter("a != b").distinct(), "small")
        remove(last, large)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each document: the size of its set of distinct WORDS-word shingles (a
    shorter text is one shingle), the smallest id that links reach, and whether that is its own.

    Sets link at a similarity of percent / 100 or more; below 80, candidates are found with less probability.
    Words are runs of what is no ASCII white space, A-Z folded. Null, empty or blank text: no shingles, no links. Null
    id: no links; component_id is null and kept true. Rows that repeat an id are one document in links, with the links
    of all their texts. Ties cannot occur: the smallest id is kept. Empty table: no rows. Further columns are ignored.
    """
    m = M if percent >= PERCENT else M_80
    sig = written(signatures(docs, key, text, m).withColumnRenamed(key, "_id"), "signatures")
    full = sig.filter("n > 0 and _id is not null").withColumn("_id", F.col("_id").cast("long"))
    classes = written(full.groupBy("n", "one", "two").agg(F.min("_id").alias("node"), F.any_value("sketch").alias("sketch")), "classes")
    pairs = written(_star_pairs(table_groups(classes, m)), "pairs")
    nodes = pairs.select("node").unionByName(pairs.select(F.col("c").alias("node"))).distinct()
    sets = written(stored_sets(docs, nodes, key, text), "sets")
    compared = written(_compare(pairs, sets, percent), "compared")
    left = written(_next_groups(compared), "groups")
    sized = left.join(left.groupBy("g").agg(F.count("*").alias("m")), "g")
    few = _compare(_small_pairs(sized.filter(F.col("m") <= SMALL)), sets, percent)
    many = sized.filter(F.col("m") > SMALL).select("g", "node")
    heads = many.groupBy("g").agg(F.min("node").alias("b"))
    chained = components(many.join(heads, "g").select(F.col("node").alias("a"), "b"))
    families = chained.select(F.col("root").alias("f"), "node").unionByName(chained.select(F.col("root").alias("f"), F.col("root").alias("node"))).distinct()
    found = compared.filter("linked").unionByName(few.filter("linked")).select(F.col("c").alias("a"), F.col("node").alias("b"))
    edges = found.unionByName(_block_links(families, sets, percent))
    roots = components(edges)
    remove(pairs, sets, compared, left, chained)
    rows = sig.drop("sketch").join(classes.drop("sketch"), ["n", "one", "two"], "left").join(roots, "node", "left")
    kind = docs.schema[key].dataType
    component = F.when(F.col("n") > 0, F.coalesce("root", "node")).otherwise(F.col("_id"))
    component = F.when(F.col("_id").isNotNull(), component).cast(kind)
    out = rows.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates() keeps. Rows with a null id all stay.

    Of rows that repeat a kept id, those with the same words (A-Z folded) are one row: the one whose columns hash least
    stays, whatever the partitioning. Rows with that id and other words all stay, as they repeat nothing. Null, empty or
    blank texts of one id have the same words. Empty table: no rows. Columns of any other name stay as they are.
    """
    found = near_duplicates(docs, key, text, percent).filter(F.col("component_id").isNotNull())
    kept = found.filter("kept").groupBy(F.col(key).alias("_key")).agg((F.count("*") > 1).alias("_many"))
    rows = packed(docs, _id=docs[key], _order=F.xxhash64(*(docs[f"`{c}`"] for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant"))))
    stay = rows.join(kept, rows["_id"] == kept["_key"])
    once = stay.filter("not _many").select("_row")
    same = F.sha2(F.trim(F.regexp_replace(F.translate(F.coalesce(F.col("_row")[text].cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase), SPACES, " ")), 256)
    many = stay.filter("_many").groupBy("_id", same.alias("_same")).agg(F.min_by("_row", "_order").alias("_row")).select("_row")
    return unpacked(once.unionByName(many), docs.columns).unionByName(docs.filter(docs[key].isNull()))
