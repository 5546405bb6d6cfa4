"""The 57 features of a pair: similarities of names and addresses, context within the record, competition for the candidate.

Tokens become weights once per record (maps token -> idf), so that a pair's set similarities are expressions over two maps
and no join by token is needed per pair. Text similarities are pandas UDFs; all of them run in one Python step.

A record goes to each of its pairs, so it travels packed, as compressed bytes. Records are weighed, and pairs meet their
records, in slices by a hash, one after the other: the shuffles of a slice are deleted before the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions import similarity as sim
from tessera.functions import text
from tessera.sources.stages import delete, staged, staged_parts

from .keys import CAND, PAIR, S1
from .windows import competition_features, context_features, embedding_features

BASE_FEATURES = (
    "name_ratio name_partial_ratio name_token_sort_ratio name_token_set_ratio name_jaro_winkler name_ascii_token_set_ratio "
    "name_tok_jaccard name_tok_idf_cos name_tok_idf_containment_s1 name_tok_idf_containment_cand name_char3_dice name_char3_idf_cos "
    "name_digit_match name_digit_conflict name_len_s1 name_len_cand name_len_ratio name_nonascii_frac_s1 name_nonascii_frac_cand "
    "addr_ratio addr_token_set_ratio addr_head_ratio addr_middle_token_set_ratio addr_tail_ratio "
    "addr_tok_jaccard addr_tok_idf_cos addr_tok_idf_containment_s1 addr_tok_idf_containment_cand "
    "addr_digit_match addr_digit_conflict addr_digit_jaccard addr_both_present addr_len_ratio street_core_ratio "
    "name_acronym_match cand_is_source3 block_rank block_score_rel n_candidates "
    "name_tok_idf_cos_gap name_token_set_ratio_gap name_char3_idf_cos_gap addr_tok_idf_cos_gap name_tok_idf_cos_rank addr_tok_idf_cos_rank"
).split()
EMBEDDING_FEATURES = "emb_cos emb_rank emb_cos_gap emb_cos_rank from_token".split()
COMPETITION_FEATURES = "comp_n_s1 comp_char3_rank comp_char3_margin comp_name_tsr_rank comp_name_tsr_margin comp_emb_rank comp_emb_margin".split()
#: The maps token -> idf of a record: words and trigrams of the name, words of the address.
WEIGHTS = ("name_w", "char3_w", "addr_w")
#: Most slices in which records are weighed and pairs meet them; records for each slice if these are fewer. What stands between packed tokens, of which none holds it.
WEIGHED, MET, SLICE = 16, 64, 768
BETWEEN = "\n"
#: Pairs whose records are unpacked at once.
UNPACKED = 256
FEATURES = BASE_FEATURES + EMBEDDING_FEATURES + COMPETITION_FEATURES


def feature_columns(df: DataFrame) -> list[str]:
    """The features that a table has, in their fixed order."""
    return [c for c in FEATURES if c in df.columns]


def smoothed_idf(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """(country, token, idf): ln((n + 1) / (df + 1)) + 1 over all records of the country; tokens are distinct a record."""
    df = tokens.groupBy("country", "token").agg(F.count("*").alias("df"))
    return df.join(sizes, "country").select("country", "token", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def token_weights(records: DataFrame, tokens: str, name: str, id_col: str = "entity_id") -> DataFrame:
    """(id, name): each record's distinct tokens as a map token -> idf of its country."""
    rows = records.select(id_col, "country", F.explode(F.array_distinct(tokens)).alias("token"))
    sizes = records.groupBy("country").agg(F.count("*").alias("n_docs"))
    weighed = rows.join(smoothed_idf(rows, sizes), ["country", "token"])
    entries = F.array_sort(F.collect_list(F.struct("token", "idf")))
    return weighed.groupBy(id_col).agg(F.map_from_entries(entries).alias(name))


def token_rows(records: DataFrame, columns: dict[str, str], id_col: str = "entity_id") -> DataFrame:
    """(id, country, kind, token): the distinct tokens of each of columns, kind -> token array."""
    kinds = F.array(*(F.struct(F.lit(n).alias("kind"), F.array_distinct(c).alias("tokens")) for n, c in columns.items()))
    return records.select(id_col, "country", F.explode(kinds).alias("_k")).select(id_col, "country", "_k.kind", F.explode("_k.tokens").alias("token"))


def repeated_tokens(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(country, kind, token, df): the tokens that more than one record of a country holds."""
    return token_rows(records, columns).groupBy("country", "kind", "token").agg(F.count("*").alias("df")).filter("df > 1")


def record_weights(records: DataFrame, columns: dict[str, str], repeated: DataFrame, sizes: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(id, a map token -> smoothed idf for each of columns); a token that is not repeated has one record. Records without
    tokens are left out."""
    rows = token_rows(records, columns, id_col).join(repeated, ["country", "kind", "token"], "left").join(sizes, "country")
    weighed = rows.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(1)) + 1)) + 1)
    entry = F.struct("token", "idf")
    return weighed.groupBy(id_col).agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == n, entry)))).alias(n) for n in columns))


def token_stats(weights: Column) -> Column:
    """size, idf_sum and idf_norm of a map token -> idf."""
    values = F.map_values(weights)
    return F.struct(
        F.size(weights).alias("size"),
        F.aggregate(values, F.lit(0.0), lambda s, x: s + x).alias("idf_sum"),
        F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)).alias("idf_norm"),
    )


DIGITS = ("name_digits", "addr_digits")
#: The token arrays of a prepared record that its weights are made from.
TOKENS = dict(zip(WEIGHTS, ("name_tokens", "char3", "addr_tokens")))


def prepared(records: DataFrame) -> DataFrame:
    """Cleaned records with their texts, never null, and tokens."""
    return records.withColumns(
        {
            "name": F.coalesce("name_original_normalized", F.lit("")),
            "ascii": F.coalesce("name_ascii_folded", F.lit("")),
            "addr": F.coalesce("address_normalized", F.lit("")),
            "addr_tokens": text.tokenize(F.col("address_normalized")),
            "char3": text.trigrams(F.col("name_original_normalized")),
        }
    )


def corpus(records: DataFrame, repeated: DataFrame, sizes: DataFrame) -> DataFrame:
    """Prepared records with all that a pair's features need of one side."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    out = records.join(record_weights(records, TOKENS, repeated, sizes), "entity_id", "left")
    return out.withColumns({n: F.coalesce(n, empty) for n in WEIGHTS}).select(
        "entity_id",
        "name",
        "ascii",
        "addr",
        *WEIGHTS,
        *(token_stats(F.col(n)).alias(f"{n}_stats") for n in WEIGHTS),
        F.coalesce("address_present", F.lit(False)).alias("present"),
        F.coalesce("address_head", F.lit("")).alias("head"),
        F.coalesce("address_tail", F.lit("")).alias("tail"),
        F.array_join("address_middle", " ").alias("middle"),
        F.col("name_digit_tokens").alias("name_digits"),
        text.digit_tokens(F.col("addr_tokens")).alias("addr_digits"),
        F.char_length("name").cast("double").alias("name_len"),
        F.char_length("addr").cast("double").alias("addr_len"),
        text.nonascii_share(F.col("name"), F.col("ascii")).alias("nonascii"),
        text.street_core(F.col("address_normalized")).alias("street"),
        text.initials(F.col("name_tokens")).alias("initials"),
        text.compact(F.col("name_tokens")).alias("compact"),
    )


def flat(sides: DataFrame) -> DataFrame:
    """corpus() with texts instead of token arrays, and texts and weights instead of maps: what is packed row by row."""
    weights = {f"{n}_values": F.map_values(n) for n in WEIGHTS}
    return sides.withColumns(weights).withColumns({n: F.array_join(F.map_keys(n), BETWEEN) for n in WEIGHTS} | {n: F.array_join(n, BETWEEN) for n in DIGITS})


def restored(side: str) -> Column:
    """A struct of flat() columns as it was."""
    tokens = lambda n: F.when(F.col(f"{side}.{n}") == "", F.array().cast("array<string>")).otherwise(F.split(f"{side}.{n}", BETWEEN))
    out = F.col(side)
    for n in WEIGHTS:
        out = out.withField(n, F.map_from_arrays(tokens(n), F.col(f"{side}.{n}_values")))
    for n in DIGITS:
        out = out.withField(n, tokens(n))
    return out.dropFields(*(f"{n}_values" for n in WEIGHTS))


def _nullable(kind: T.DataType) -> T.DataType:
    """A type all parts of which may be null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType))
    return kind


def pack(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with some columns as one of compressed bytes."""
    others = [c for c in df.columns if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        for batch in batches:
            some, made = batch.select(columns), []
            for i in range(len(some)):
                row = some.slice(i, 1).serialize()
                made.append(row.size.to_bytes(8, "little") + codec.compress(row, asbytes=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(made, pa.binary())], names=[*others, name])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in others), T.StructField(name, T.BinaryType())]))


def unpack(df: DataFrame, packed: dict[str, T.StructType]) -> DataFrame:
    """df whose columns of packed, name -> the columns in it, become structs. Rows that hold the same bytes share the work."""
    others = [c for c in df.columns if c not in packed]
    kinds = {n: _nullable(k) for n, k in packed.items()}

    def structs(rows: pa.Array, schema: pa.Schema) -> pa.Array:
        codec, coded = pa.Codec("zstd"), rows.dictionary_encode()
        bodies = [x.as_buffer() for x in coded.dictionary]
        bodies = [codec.decompress(x.slice(8), int.from_bytes(x.slice(0, 8).to_pybytes(), "little")) for x in bodies]
        table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), schema) for x in bodies], schema).combine_chunks()
        columns = [pa.concat_arrays(c.chunks) for c in table.columns]
        return pa.StructArray.from_arrays(columns, fields=list(schema)).take(coded.indices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemas = {n: to_arrow_schema(k) for n, k in kinds.items()}
        for batch in batches:
            for i in range(0, len(batch), UNPACKED):
                some = batch.slice(i, UNPACKED)
                made = [structs(some.column(n), s) for n, s in schemas.items()]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in others), *made], names=[*others, *kinds])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in others), *(T.StructField(n, k) for n, k in kinds.items())]))


def slices(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """df in n parts by a hash of a key."""
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def _map_sets(q, t, weights: str) -> dict[str, Column]:
    """Set similarities of a pair's maps, from what both have; sizes, sums and norms come with each record."""
    of_q, of_t, both = q(f"{weights}_stats"), t(f"{weights}_stats"), F.col(f"{weights}_both")
    shared = both["n"].cast("double")
    return {
        "jaccard": F.try_divide(shared, of_q["size"] + of_t["size"] - shared),
        "dice": F.try_divide(2 * shared, of_q["size"] + of_t["size"]),
        "idf_cos": F.try_divide(both["product"], of_q["idf_norm"] * of_t["idf_norm"]),
        "containment_s1": F.try_divide(both["of_a"], of_q["idf_sum"]),
        "containment_cand": F.try_divide(both["of_b"], of_t["idf_sum"]),
    }


def pair_features(both: DataFrame, is_source3=lambda cand: text.source_of(cand) == "S3") -> DataFrame:
    """Pairs whose records of the corpus are the structs q and t, with the features that need both records only, in place of
    these; undefined ones are null."""
    q, t = (lambda c: F.col(f"q.{c}")), (lambda c: F.col(f"t.{c}"))
    both = both.withColumns({f"{n}_both": sim.shared_weights(q(n), t(n)) for n in WEIGHTS})
    both = both.withColumns({c: F.col(c).dropFields(*WEIGHTS) for c in ("q", "t")})
    present = q("present") & t("present")
    only = lambda c, value: F.when(c, value)
    filled = lambda c: (q(c) != "") & (t(c) != "")
    words, char3, addr = (_map_sets(q, t, n) for n in WEIGHTS)
    made = {
        "name_ratio": sim.ratio(q("name"), t("name")),
        "name_partial_ratio": sim.partial(q("name"), t("name")),
        "name_token_sort_ratio": sim.token_sort(q("name"), t("name")),
        "name_token_set_ratio": sim.token_set(q("name"), t("name")),
        "name_jaro_winkler": sim.winkler(q("name"), t("name")),
        "name_ascii_token_set_ratio": sim.token_set(q("ascii"), t("ascii")),
        "name_tok_jaccard": words["jaccard"],
        "name_tok_idf_cos": words["idf_cos"],
        "name_tok_idf_containment_s1": words["containment_s1"],
        "name_tok_idf_containment_cand": words["containment_cand"],
        "name_char3_dice": char3["dice"],
        "name_char3_idf_cos": char3["idf_cos"],
        "name_digit_match": sim.digit_match(q("name_digits"), t("name_digits")),
        "name_digit_conflict": sim.digit_conflict(q("name_digits"), t("name_digits")),
        "name_len_s1": q("name_len"),
        "name_len_cand": t("name_len"),
        "name_len_ratio": sim.length_ratio(q("name_len"), t("name_len")),
        "name_nonascii_frac_s1": q("nonascii"),
        "name_nonascii_frac_cand": t("nonascii"),
        "addr_ratio": only(present, sim.ratio(q("addr"), t("addr"))),
        "addr_token_set_ratio": only(present, sim.token_set(q("addr"), t("addr"))),
        "addr_head_ratio": only(present, sim.ratio(q("head"), t("head"))),
        "addr_middle_token_set_ratio": only(present & filled("middle"), sim.token_set(q("middle"), t("middle"))),
        "addr_tail_ratio": only(present, sim.ratio(q("tail"), t("tail"))),
        "addr_tok_jaccard": only(present, addr["jaccard"]),
        "addr_tok_idf_cos": only(present, addr["idf_cos"]),
        "addr_tok_idf_containment_s1": only(present, addr["containment_s1"]),
        "addr_tok_idf_containment_cand": only(present, addr["containment_cand"]),
        "addr_digit_match": only(present, sim.digit_match(q("addr_digits"), t("addr_digits"))),
        "addr_digit_conflict": only(present, sim.digit_conflict(q("addr_digits"), t("addr_digits"))),
        "addr_digit_jaccard": only(present, sim.jaccard(q("addr_digits"), t("addr_digits"))),
        "addr_both_present": present.cast("double"),
        "addr_len_ratio": sim.length_ratio(q("addr_len"), t("addr_len")),
        "street_core_ratio": only(present & filled("street"), sim.token_set(q("street"), t("street"))),
        "name_acronym_match": sim.acronym_match(q("initials"), q("compact"), t("initials"), t("compact")),
        "cand_is_source3": is_source3(F.col(CAND)).cast("double"),
    }
    return both.withColumns(made).drop("q", "t", *(f"{n}_both" for n in WEIGHTS))


def name_cosine(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(S1, candidate, score): name_tok_idf_cos of pairs alone, from the records' name tokens."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    weights = records.select("entity_id").join(token_weights(records, "name_tokens", "w"), "entity_id", "left").select("entity_id", F.coalesce("w", empty).alias("w"))
    a, b = (weights.select(F.col("entity_id").alias(side), F.col("w").alias(name)) for side, name in ((S1, "_a"), (CAND, "_b")))
    both = pairs.select(*PAIR).join(a, S1).join(b, CAND)
    return both.select(*PAIR, sim.idf_cosine(F.col("_a"), F.col("_b")).alias("score"))


def packed_corpus(pairs: DataFrame, records: DataFrame, n: int) -> tuple[DataFrame, T.StructType]:
    """(entity_id, asked, found, side): the records of pairs, packed, and whether they are some pair's S1 and candidate;
    and what a side holds. All records count for weights."""
    ids = [pairs.select(F.col(c).alias("entity_id"), F.lit(c == S1).alias("asked"), F.lit(c == CAND).alias("found")) for c in PAIR]
    ids = staged(ids[0].unionByName(ids[1]).groupBy("entity_id").agg(F.max("asked").alias("asked"), F.max("found").alias("found")), "ids")
    known = prepared(records)
    repeated = staged(repeated_tokens(known, TOKENS), "repeated")
    sizes = staged(records.groupBy("country").agg(F.count("*").alias("n_docs")), "sizes")
    sides = [flat(corpus(some, repeated, sizes)) for some in slices(known, "entity_id", n)]
    inside = [f for f in sides[0].schema if f.name != "entity_id"]
    names = [f.name for f in inside]
    out = staged_parts((pack(s.join(i, "entity_id"), names, "side") for s, i in zip(sides, slices(ids, "entity_id", n))), "corpus")
    delete(repeated, sizes, ids)
    return out, T.StructType(inside)


def meet(pairs: DataFrame, sides: DataFrame, n: int) -> Iterator[DataFrame]:
    """Slices of pairs by candidate with the packed records q and t; the pairs of a candidate follow each other."""
    a = sides.filter("asked").select(F.col("entity_id").alias(S1), F.col("side").alias("q"))
    b = sides.filter("found").select(F.col("entity_id").alias(CAND), F.col("side").alias("t"))
    for some, own in zip(slices(pairs, CAND, n), slices(b, CAND, n)):
        yield some.join(a.hint("merge"), S1).join(own.hint("merge"), CAND)


def all_features(pairs: DataFrame, records: DataFrame, is_source3=lambda cand: text.source_of(cand) == "S3", done=lambda: None) -> DataFrame:
    """pairs (S1, candidate, country, score and, of a union, emb_score and emb_rank) with all features they allow. Records
    should be a table; done() is called when it is read no more. What a record brings to its pairs is computed once and read from a table on both sides of a pair."""
    n = max(1, -(-records.count() // SLICE))
    pairs = staged(pairs, "pairs")
    sides, inside = packed_corpus(pairs, records, min(WEIGHED, n))
    done()
    both = (unpack(some, {"q": inside, "t": inside}).withColumns({c: restored(c) for c in ("q", "t")}) for some in meet(pairs, sides, min(MET, n)))
    made = staged_parts((pair_features(some, is_source3) for some in both), "features")
    delete(sides, pairs)
    out = context_features(made)
    if "emb_score" in pairs.columns:
        out = embedding_features(out)
    out = competition_features(out)
    extra = [c for c in ("score", "label") if c in out.columns]
    return out.select(*PAIR, "country", *extra, *(F.col(c).cast("double").alias(c) for c in feature_columns(out)))
