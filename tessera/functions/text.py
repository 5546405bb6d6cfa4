"""Normalising, tokenising and parsing of names and addresses, as column expressions.

Only Unicode normalisation has no built-in and runs as a pandas UDF, which rows of plain ASCII pass through unchanged.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------------------------------------------------
# Word lists that results depend on.

LEGAL_SUFFIXES = {
    "pvt": "pvt",
    "private": "pvt",
    "ltd": "ltd",
    "limited": "ltd",
    "corp": "corp",
    "corporation": "corp",
    "inc": "inc",
    "incorporated": "inc",
    "llc": "llc",
    "llp": "llp",
}
STOPWORDS = "limited llc private inc ltd com center pvt services corp group india holdings care associates llp".split()
FURTHER_LEGAL_FORMS = "sarl sas sasu eurl sa sci ei snc".split()
STREET_TYPES = (
    "street st str road rd avenue ave av boulevard blvd bd drive dr lane ln court ct place pl terrace ter "
    "circle cir way highway hwy parkway pkwy square sq trail trl rue r route rte rt chemin ch chem impasse "
    "imp allee all quai cours marg main cross path"
).split()
STREET_FILLERS = "no nos door plot flat shop house h hno unit suite ste apt floor fl bldg block blk po box null de des du la le les d l of the".split()
TOP_LEVEL_DOMAINS = "com net org co io biz info in".split()

#: Java patterns: white space and ASCII punctuation; the second without the underscore.
EDGE = r"[\s\p{Punct}]+"
SEPARATOR = r"[\s\p{Punct}&&[^_]]+"


# ---- characters -------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None or x.isascii():
            return x
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c) and ord(c) < 128)

    return s.map(one)


@F.pandas_udf(T.StringType())
def _unaccent(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None or x.isascii():
            return x
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))

    return s.map(one)


def clean(text: Column) -> Column:
    """Trimmed text; blank or null is empty."""
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def collapse(text: Column) -> Column:
    """Each run of white space (of any script) as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def lower_nfkc(text: Column) -> Column:
    return F.lower(_nfkc(text))


def ascii_fold(text: Column) -> Column:
    """Base letters of accented ones; what has no ASCII form goes."""
    return collapse(_fold(text))


def fold_accents(text: Column) -> Column:
    """Base letters of accented ones; other scripts stay."""
    return _unaccent(text)


def without_domain(text: Column) -> Column:
    """Without `www.` at a word's start and without a top-level domain that follows a letter or digit."""
    text = F.regexp_replace(text, r"\bwww\.", "")
    return F.regexp_replace(text, rf"(?<=[a-z0-9])\.({'|'.join(TOP_LEVEL_DOMAINS)})\b", "")


def without_leading_noise(text: Column) -> Column:
    return F.regexp_replace(text, "^" + EDGE, "")


def name_text(raw: Column) -> Column:
    """The normalised form of a name: blank, Unicode, domain, white space and leading noise."""
    return without_leading_noise(collapse(without_domain(lower_nfkc(clean(raw)))))


def country(raw: Column) -> Column:
    return clean(raw)


# ---- tokens -----------------------------------------------------------------------------------------------------------


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokenize(text: Column) -> Column:
    """Tokens between white space and ASCII punctuation but the underscore; order and repetitions stay."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda t: t != "")


def canonical_suffixes(tokens: Column, mapping: dict[str, str] | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in (mapping or LEGAL_SUFFIXES).items() for x in kv))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(pairs, t), t))


def digit_tokens(tokens: Column) -> Column:
    """The distinct tokens of digits only, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^\p{Nd}+$"))))


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~F.array_contains(words(stop), t))


def blocking_tokens(tokens: Column) -> Column:
    return without(tokens, STOPWORDS)


def name_tokens(normalized: Column) -> Column:
    return canonical_suffixes(tokenize(normalized))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(without(tokens, sorted({*STOPWORDS, *FURTHER_LEGAL_FORMS})), lambda t: F.substring(t, 1, 1)), "")


def compact(tokens: Column) -> Column:
    return F.array_join(without(tokens, sorted({*STOPWORDS, *FURTHER_LEGAL_FORMS})), "")


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of each word with a space on both sides."""
    padded = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


# ---- addresses --------------------------------------------------------------------------------------------------------


def address_struct(raw: Column) -> Column:
    """present, normalized, head, tail and middle of an address given as components between commas."""
    normalized = collapse(lower_nfkc(clean(raw)))
    return address_parts(normalized)


def address_parts(normalized: Column) -> Column:
    parts = components(normalized)
    n = F.size(parts)
    middle = F.when(n > 2, F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        (n > 0).alias("present"),
        normalized.alias("normalized"),
        F.get(parts, F.lit(0)).alias("head"),
        F.try_element_at(parts, F.lit(-1)).alias("tail"),
        middle.alias("middle"),
    )


def components(normalized: Column) -> Column:
    stripped = F.transform(F.split(normalized, ","), lambda c: F.regexp_replace(c, rf"^{EDGE}|{EDGE}$", ""))
    return F.filter(stripped, lambda c: c != "")


def street_core(address: Column) -> Column:
    """What identifies the street: of the first component that names a street type, else holds a digit, the words of two
    letters or more that are no street type, filler or house number."""
    split = F.transform(F.split(F.coalesce(address, F.lit("")), ","), tokenize)
    typed = F.get(F.filter(split, lambda c: F.arrays_overlap(c, words(STREET_TYPES))), F.lit(0))
    numbered = F.get(F.filter(split, lambda c: F.exists(c, lambda t: t.rlike(r"\p{Nd}"))), F.lit(0))
    chosen = F.coalesce(typed, numbered, F.array().cast("array<string>"))
    drop = words(sorted({*STREET_TYPES, *STREET_FILLERS}))
    kept = F.filter(chosen, lambda t: (F.char_length(t) > 1) & ~F.array_contains(drop, t) & ~t.rlike(r"^\p{Nd}+[a-z]?$"))
    return F.array_join(kept, " ")


def street_component(address: Column) -> Column:
    """index, component and house number of the first component with a word of digits; -1 and empty texts if none."""
    parts = F.split(F.coalesce(address, F.lit("")), ",")
    number = lambda c: F.get(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t.rlike(r"^\p{Nd}+$")), F.lit(0))
    found = F.filter(F.transform(parts, lambda c, i: F.struct(i.alias("index"), F.trim(c).alias("component"), number(c).alias("number"))), lambda s: s["number"].isNotNull())
    none = F.struct(F.lit(-1).alias("index"), F.lit("").alias("component"), F.lit("").alias("number"))
    return F.coalesce(F.get(found, F.lit(0)), none)


def city_key(address: Column) -> Column:
    """The components without a digit, sorted: what records of one place share."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike(r"\p{Nd}"))
    return F.array_join(F.array_sort(parts), ",")


# ---- records ----------------------------------------------------------------------------------------------------------


def record_text(name: Column, address: Column) -> Column:
    return F.when(F.coalesce(address, F.lit("")) == "", F.coalesce(name, F.lit(""))).otherwise(F.concat_ws(", ", F.coalesce(name, F.lit("")), address))


def nonascii_share(name: Column, folded: Column) -> Column:
    """The share of letters that folding loses, from 0 to 1; null for an empty name."""
    share = 1 - F.try_divide(F.char_length(folded).cast("double"), F.char_length(name))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def source_of(entity_id: Column) -> Column:
    return F.substring(entity_id, 1, 2)


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def clean_records(raw: DataFrame, id_col: str = "entity_id", name: str = "business_name", address: str = "business_address", country_col: str = "country") -> DataFrame:
    """Cleaned records: one row for each raw one, ids unchanged.

    Unicode normalisation runs first and alone, so that its Python step is one, and all else stays in one JVM stage.
    """
    prepared = raw.select(
        F.col(id_col).alias("entity_id"),
        country(F.col(country_col)).alias("country"),
        name_text(F.col(name)).alias("name_original_normalized"),
        collapse(lower_nfkc(clean(F.col(address)))).alias("address_normalized"),
    )
    tokens = name_tokens(F.col("name_original_normalized"))
    parts = address_parts(F.col("address_normalized"))
    return prepared.withColumns({"name_ascii_folded": ascii_fold(F.col("name_original_normalized")), "_t": tokens, "_a": parts}).select(
        "entity_id",
        "country",
        "name_original_normalized",
        "name_ascii_folded",
        F.col("_t").alias("name_tokens"),
        digit_tokens(F.col("_t")).alias("name_digit_tokens"),
        F.col("_a.present").alias("address_present"),
        "address_normalized",
        F.col("_a.head").alias("address_head"),
        F.col("_a.middle").alias("address_middle"),
        F.col("_a.tail").alias("address_tail"),
    )
