"""Linkage over whole documents: nothing after a text's beginning may be lost."""

import random
import string

from tessera.plans import catalog, views


def words(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(n))


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_records_hold_whole_texts(spark, tmp_path):
    texts = {0: "One. Two\nthree", 1: "no end", 2: "", 3: "line\n" + "x" * 5000, 4: None}
    d = documents(spark, tmp_path, [(i, t, "en") for i, t in texts.items()])
    got = {r["entity_id"]: (r["name"], r["address"]) for r in views.rec(spark, d).collect()}
    assert got[0] == ("One.", " Two\nthree") and got[1] == ("no end", "") and got[4] == (None, None)
    assert all("".join(got[i]) == t for i, t in texts.items() if t is not None)


def test_pair_features_of_texts_that_agree_late(spark, tmp_path):
    rng = random.Random(3)
    late = words(rng, 30)
    rows = [(i, words(rng, 20) + ". " + words(rng, 30) + " " + (late if i in (5, 6) else words(rng, 30)), "en") for i in range(5, 25)]
    d = documents(spark, tmp_path, rows)
    found = {(r["s1"], r["cand"]): r["addr_tok_jaccard"] for r in catalog.QUERIES["pair_features"](spark, d).collect()}
    assert set(found) == {("S1-5", "S2-6")} and abs(found["S1-5", "S2-6"] - 30 / 90) < 1e-6


def test_large_families_keep_their_candidates(spark, tmp_path):
    """A copy has candidates however many targets hold its tokens, as many as the operator keeps."""
    rng = random.Random(4)
    copy = words(rng, 8) + ". " + words(rng, 20)
    copies = [5, *(i for i in range(6, 120) if i % 5)]
    rows = [(i, copy, "en") for i in copies] + [(i, words(rng, 8) + ". " + words(rng, 20), "en") for i in range(120, 140)]
    d = documents(spark, tmp_path, rows)
    found = catalog.QUERIES["pair_features"](spark, d).select("s1", "cand", "addr_tok_jaccard").collect()
    assert len(found) == 40 and {r["s1"] for r in found} == {"S1-5"} and all(r["addr_tok_jaccard"] == 1 for r in found)
