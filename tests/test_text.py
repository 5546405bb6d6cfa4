import pytest
from pyspark.sql import functions as F

from tessera.functions import text


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "v string").select(*(c(F.col("v")) for c in columns)).first())


def norm(spark, value):
    return one(spark, value, text.name_text)[0]


def test_case_width_and_accents(spark):
    assert norm(spark, "ACME Corp") == norm(spark, "acme corp") == "acme corp"
    assert norm(spark, "ＡＣＭＥ") == "acme"
    assert one(spark, "café société", text.ascii_fold)[0] == "cafe societe"
    assert norm(spark, "Café") == "café"


@pytest.mark.parametrize("value", ["नमस्ते दुनिया", "ಬೆಂಗಳೂರು ಅಂಗಡಿ"])
def test_other_scripts_stay_whole(spark, value):
    assert one(spark, value, text.tokenize)[0] == value.split()


def test_domain_noise(spark):
    assert norm(spark, "www.acme.com") == "acme"
    assert norm(spark, "shop.in store") == "shop store"
    assert norm(spark, "dot com") == "dot com"


def test_leading_noise_and_blank(spark):
    assert norm(spark, " -- acme") == "acme"
    for blank in (None, "", "  \t "):
        assert norm(spark, blank) == ""
        assert one(spark, blank, text.tokenize)[0] == []


def test_suffixes_by_whole_token(spark):
    f = lambda c: text.canonical_suffixes(text.tokenize(c))
    assert one(spark, "acme private limited", f)[0] == one(spark, "acme pvt ltd", f)[0] == ["acme", "pvt", "ltd"]
    assert one(spark, "incorporatedx", f)[0] == ["incorporatedx"]


def test_tokens_keep_order_repetition_and_underscore(spark):
    assert one(spark, "b-a, a_b (b)", text.tokenize)[0] == ["b", "a", "a_b", "b"]


def test_digit_tokens(spark):
    f = lambda c: text.digit_tokens(text.tokenize(c))
    assert one(spark, "42-B 7m 007 42", f)[0] == ["007", "42"]


@pytest.mark.parametrize(
    "value, present, head, middle, tail",
    [
        (None, False, None, [], None),
        (",, ,", False, None, [], None),
        ("Paris", True, "paris", [], "paris"),
        ("12 rue x, Paris", True, "12 rue x", [], "paris"),
        ("a, b, c", True, "a", ["b"], "c"),
        ("a,, b,,, -c-, d", True, "a", ["b", "c"], "d"),
    ],
)
def test_address(spark, value, present, head, middle, tail):
    a = one(spark, value, text.address_struct)[0]
    assert (a["present"], a["head"], a["middle"], a["tail"]) == (present, head, middle, tail)


@pytest.mark.parametrize(
    "value, core",
    [
        ("12 rue des travailleurs, lille", "travailleurs"),
        ("il, chicago, 1840 blue island avenue", "blue island"),
        ("81st st, new york", "81st"),
        ("plot 7, 44c", ""),
        ("nowhere", ""),
        (None, ""),
    ],
)
def test_street_core(spark, value, core):
    assert one(spark, value, text.street_core)[0] == core


def test_acronym_parts(spark):
    f = lambda c: text.initials(text.tokenize(c))
    g = lambda c: text.compact(text.tokenize(c))
    assert one(spark, "art forces comite eurl", f, g) == ("afc", "artforcescomite")
    assert one(spark, "group services", f, g) == ("", "")


def test_trigrams_are_bounded_by_words(spark):
    assert sorted(one(spark, "ab a", text.trigrams)[0]) == [" a ", " ab", "ab "]


def test_street_component_and_city(spark):
    assert tuple(one(spark, "lille, 12 rue x, nord", text.street_component)[0]) == (1, "12 rue x", "12")
    assert tuple(one(spark, "lille", text.street_component)[0]) == (-1, "", "")
    assert one(spark, "nord, 12 rue x, lille", text.city_key)[0] == "lille,nord"


def test_clean_records_keeps_rows_and_ids(spark):
    raw = spark.createDataFrame([("S1-1", "ACME Ltd 42", None, " US "), ("S2-1", None, "1 main st, x", None)], "entity_id string, business_name string, business_address string, country string")
    rows = {r["entity_id"]: r for r in text.clean_records(raw).collect()}
    assert set(rows) == {"S1-1", "S2-1"}
    a, b = rows["S1-1"], rows["S2-1"]
    assert (a["country"], a["name_tokens"], a["name_digit_tokens"], a["address_present"], a["address_head"]) == ("US", ["acme", "ltd", "42"], ["42"], False, None)
    assert (b["country"], b["name_original_normalized"], b["address_head"], b["address_tail"]) == ("", "", "1 main st", "x")
