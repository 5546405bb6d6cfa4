"""Synthetic examples, places by hash, and values by place: properties and plain Python."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import exports, metrics, sampling
from tessera.operators.keys import CAND, PAIR, S1


def applied(spark, edit, texts, by=0):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", edit(F.col("t"), F.lit(by).cast("long")).alias("x")).orderBy("i").collect()]


def test_each_edit(spark):
    e = exports.EDITS
    assert applied(spark, e["legal form"], ["lutins sas, ltd bio", "sarl"]) == ["lutins bio", ""]
    accented = "été çà ñandú e\u0301 Ħ 日"
    assert applied(spark, e["accents"], [accented]) == ["ete ca nandu e Ħ 日"]
    assert applied(spark, e["street word"], ["12 avenue foch avenue x", "3 av de la paix", "none"]) == ["12 av foch avenue x", "3 avenue de la paix", "none"]
    assert applied(spark, e["street word"], ["9 rue x, 2 r y"], by=2) == ["9 r x, 2 r y"]
    assert applied(spark, e["articles"], ["rue de la paix de la mer", "rue d'orsay", "des halles"]) == ["rue paix de la mer", "rue orsay", "des halles"]
    assert applied(spark, e["repetition mark"], ["12 bis rue x", "bisou"]) == ["12 rue x", "bisou"]
    swaps = {"lutins"[:j] + "lutins"[j + 1] + "lutins"[j] + "lutins"[j + 2 :] for j in range(5)}
    made = spark.range(0, 4000, 64).select(e["letters"](F.lit("ab lutins 12345 d'or"), F.col("id")).alias("x")).collect()
    assert {r["x"] for r in made} == {f"ab {w} 12345 d'or" for w in swaps}
    assert applied(spark, e["letters"], ["a bc def 1234"]) == ["a bc def 1234"]


def test_copies_have_one_or_two_edits(spark):
    value = "lutins comité sas, 12 bis avenue de la paix"
    plain = {
        "legal form": lambda t: " ".join(w for w in t.split(" ") if w.strip(",") != "sas"),
        "accents": lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)),
        "street word": lambda t: t.replace(" avenue ", " av "),
        "articles": lambda t: t.replace(" de la ", " "),
        "repetition mark": lambda t: t.replace(" bis ", " "),
    }
    rows = spark.range(600).select(F.lit("s").alias(S1), F.col("id").alias(CAND), F.lit("a").alias("text_a"), F.lit(value).alias("text_b"), F.lit(1).alias("label"))
    made = exports.synthetic_positives(rows).collect()
    assert len(made) == 600 and all(r["label"] == 1 and r["text_a"] == "a" and r[CAND].startswith("synthetic_pos:") for r in made)
    assert made == exports.synthetic_positives(rows.repartition(7)).collect() or sorted(map(tuple, made)) == sorted(map(tuple, exports.synthetic_positives(rows.repartition(7)).collect()))
    seen = {}
    for r in made:
        got = r["text_b"]
        letters = sorted(got.replace(" ", ""))
        fits = []
        for names in exports.EDIT_SETS:
            t = value
            for n in exports.EDITS:
                t = plain[n](t) if n in names and n in plain else t
            same = got == t if "letters" not in names else len(got) == len(t) and letters == sorted(t.replace(" ", "")) and sum(x != y for x, y in zip(got, t)) in (0, 2)
            street = "street word" in names and got == (lambda u: u)(t.replace(" av ", " avenue "))  # another kind of street word was chosen
            if same or street or ("letters" in names and "street word" in names):
                fits.append(names)
        assert fits, got
        for n in fits[0]:
            seen[n] = seen.get(n, 0) + 1
    assert len(seen) >= 5
    none = rows.limit(1).withColumn("text_b", F.lit(""))
    assert exports.synthetic_positives(none).count() == 0


def street_of(address):
    for c in address.split(","):
        number = next((w for w in c.split() if w.isdigit()), None)
        if number is not None:
            return number, " ".join(w for w in c.split() if w != number)
    return None


def test_negatives(spark):
    rng = random.Random(4)
    words = ["comite", "institut", "boulangerie", "garage", "ecole"]
    rows = []
    for i in range(1500):
        address = f"{rng.randint(1, 99)} rue {rng.choice('abcdef')}, lille" if i % 5 else "lille" if i % 10 else f"{rng.randint(1, 9)} rue same, nice"
        rows.append((f"s{i}", f"c{i}", "text a", f"lutins {rng.choice(words)} sas" if i % 3 else "no such word", address))
    df = spark.createDataFrame(rows, f"{S1} string, {CAND} string, text_a string, name string, address string")
    vocabulary = spark.createDataFrame([(w, 300) for w in words], "word string, n long")
    made = exports.synthetic_negatives(df, vocabulary).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, exports.synthetic_negatives(df.repartition(5), vocabulary).collect()))
    by = {r[1]: r for r in rows}
    kinds = {"word": 0, "street": 0}
    for r in made:
        _, _, a, name, address = by[r[CAND].removeprefix("synthetic_neg:")]
        kinds[r["kind"]] += 1
        assert r["label"] == 0 and r["text_a"] == a
        got_name, _, got_address = r["text_b"].partition(", ")
        if r["kind"] == "word":
            old, new = name.split(" "), got_name.split(" ")
            changed = [(x, y) for x, y in zip(old, new) if x != y]
            assert got_address == address and len(old) == len(new) and len(changed) == 1 and {*changed[0]} <= set(words)
        else:
            (number, street), (new_number, new_street) = street_of(address), street_of(got_address)
            assert got_name == name and number == new_number and street != new_street and got_address.endswith(address.rpartition(",")[2])
            assert "same" not in street  # all streets of that place differ by number alone
    # of 1500 pairs two thirds have a word, which is another one in four of five tries; four of five have a street
    assert abs(kinds["word"] - 1500 * 2 / 3 * 0.8 * 0.8) < 60 and abs(kinds["street"] - 1500 * 0.8 * 0.2 * 5 / 6) < 45
    assert len(made) == len({r[CAND] for r in made})
    assert exports.synthetic_negatives(df.limit(0), vocabulary).count() == 0


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_places_by_hash(spark, monkeypatch, buckets):
    monkeypatch.setattr(sampling, "BUCKETS", buckets)
    monkeypatch.setattr(sampling, "IN_ONE_TASK", 0)
    rng = random.Random(buckets)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([3, -(2**62), 2**62, rng.randint(-1000, 1000)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, h long").repartition(3)
    got = {r["i"]: (r["_place"], r["_total"]) for r in sampling.hash_places(df, F.col("h"), ["i"], ("g",)).collect()}
    for g in ("a", "b", None):
        own = sorted((h, i) for i, k, h in rows if k == g)
        assert [got[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]
    want = {i for _, i in sorted((h, i) for i, _, h in rows)[:137]}
    assert {r["i"] for r in sampling.sample(df, 137, F.col("h"), ["i"]).collect()} == want
    assert sampling.sample(df.limit(0), 5, F.col("h"), ["i"]).count() == 0 and sampling.sample(df, 0, F.col("h"), ["i"]).count() == 0


def test_values_at_places_and_levels(spark):
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(size=700), np.full(50, 0.25), [1e9, -5.0]]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
    ordered = np.sort(values)
    places = [0, 1, 350, 400, len(values) - 2, len(values) - 1]
    assert metrics.values_at(df, "v", places) == {i: ordered[i] for i in places}
    assert metrics.values_at(df.limit(0), "v", [0]) == {}
    levels = sorted(rng.normal(size=23).tolist())
    got = [(r["v"], r["n"]) for r in df.filter("v is not null").select("v", metrics.level_of(F.col("v"), levels).alias("n")).collect()]
    assert all(n == sum(x <= v for x in levels) for v, n in got)


def test_length_order_and_budget(spark):
    rows = [("s", f"c{i}", "x" * (i * 7 % 50), "y" * (i * 3 % 20)) for i in range(200)]
    df = spark.createDataFrame(rows, f"{S1} string, {CAND} string, text_a string, text_b string")
    sizes = [len(r["text_a"]) + len(r["text_b"]) for r in exports.by_length(df, 3).collect()]
    assert sizes == sorted(sizes) and len(sizes) == 200
    rate, n = exports.budget(df, lambda a, b: [0.5] * len(a), 2.0, n=50)
    assert rate > 0 and n == int(rate * 2.0)
