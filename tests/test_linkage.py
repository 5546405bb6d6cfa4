import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import blocking, candidates, decide, exports, features, knn, labels, metrics, reports, sampling, validate, windows
from tessera.operators.keys import CAND, S1

PAIRS = f"{S1} string, {CAND} string, score double"


def records(spark):
    rows = [
        ("S1-1", "blue island bakery ltd", "12 blue island avenue, chicago", "US"),
        ("S1-2", "green valley tools", "7 oak street, dallas", "US"),
        ("S1-3", "lonely shop", "1 far road, nome", "France"),
        ("S2-1", "blue island bakery", "12 blue island ave, chicago", "US"),
        ("S2-2", "green valley tools inc", "7 oak st, dallas", "US"),
        ("S3-1", "blue isle bakery", "12 blue island avenue, chicago", "US"),
        ("S3-2", "other things", "99 elm street, boston", "US"),
    ]
    return text.clean_records(spark.createDataFrame(rows, "entity_id string, name string, address string, country string"), name="name", address="address")


def sides(spark):
    r = records(spark)
    return r.filter("entity_id like 'S1%'"), r.filter("entity_id not like 'S1%'")


def test_blocking_end_to_end(spark):
    a, b = sides(spark)
    found = {(r[S1], r[CAND]): r["score"] for r in blocking.token_blocking(a, b).collect()}
    assert {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")} <= set(found)
    assert ("S1-1", "S3-2") not in found and not any(k[0] == "S1-3" for k in found)
    assert all(v > 0 for v in found.values())
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-2")], f"{S1} string, matched_id string")
    d = {r["country"]: r for r in blocking.diagnostics(a, b, blocking.token_blocking(a, b), truth, blocking.recall_ceiling(truth, *blocking.select_keys(a, b))).collect()}
    assert d["US"]["recall_at_k"] == d["US"]["recall_ceiling"] == 1.0 and "France" not in d


def test_capped_key_leaves_no_keys_and_rarest_win(spark):
    q = spark.createDataFrame([("r", "c", "name", t) for t in "xyz"], "id string, country string, side string, token string")
    w = spark.createDataFrame([("c", "name", "x", 50, 1.0), ("c", "name", "y", 5, 2.0), ("c", "name", "z", 20, 1.5)], "country string, side string, token string, df long, idf double")
    assert {r["token"] for r in blocking.rare_keys(q, w, 100, 2).collect()} == {"y", "z"}
    assert blocking.rare_keys(q, w, 4, 2).count() == 0


def test_top_k_ties_go_to_the_smaller_id(spark):
    p = spark.createDataFrame([("a", c, s) for c, s in (("c0", 0.5), ("c1", 0.5), ("c2", 0.9), ("c3", 0.0))], PAIRS)
    assert {r[CAND] for r in blocking.top_k(p, 2).collect()} == {"c2", "c0"}


def vectors(spark, n=60, dim=8):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    country = ["US"] * 25 + ["India"] * 20 + ["France"] * 15
    rows = [(f"v{i:02d}", country[i], i % 10 == 0, x[i].tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, country string, is_source1 boolean, embedding array<double>")


@pytest.mark.parametrize("k", [3, 100])
def test_knn_equals_brute_force(spark, k):
    rows, df = vectors(spark)
    want = set()
    for i, c, s, x in rows:
        if s:
            others = sorted(((-round(float(np.dot(x, y)), 9), j) for j, d, t, y in rows if not t and d == c))[:k]
            want |= {(i, j, r) for r, (_, j) in enumerate(others)}
    for found in (knn.knn_pairs(df, k), knn.knn_blocks(df, k, block=2, part=7)):
        assert {(r[S1], r[CAND], r["emb_rank"]) for r in found.collect()} == want


def test_candidate_union(spark):
    t = spark.createDataFrame([("a", c, float(s), "US") for c, s in ((10, 5), (20, 4), (30, 3))], f"{S1} string, {CAND} int, score double, country string")
    e = spark.createDataFrame([("a", 30, "US", 0.9, 1), ("a", 40, "US", 0.8, 0)], f"{S1} string, {CAND} int, country string, emb_score double, emb_rank long")
    assert {r[CAND]: (r["score"], r["emb_rank"]) for r in candidates.candidate_union(t, e).collect()} == {10: (5, None), 20: (4, None), 30: (3, 1), 40: (0, 0)}


def test_encoder_sees_each_text_once(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "id string, t string")
    rows = {r["id"]: r["embedding"] for r in knn.encode(df, "t", lambda ts: [[float(len(t))] for t in ts], prefix="q: ").collect()}
    assert rows == {"a": [4.0], "b": [4.0], "c": None}


def test_context(spark):
    p = spark.createDataFrame([("a", "c1", 3.0, 0.2), ("a", "c2", 2.0, 0.9), ("a", "c3", 1.0, None), ("b", "c1", 0.0, 0.1)], f"{PAIRS}, v double")
    rows = {(r[S1], r[CAND]): r for r in windows.context_features(p, gaps=("v",), ranks=("v",)).collect()}
    assert [rows["a", c]["block_rank"] for c in ("c1", "c2", "c3")] == [0, 1, 2]
    assert [rows["a", c]["v_rank"] for c in ("c1", "c2", "c3")] == [1, 0, 2]
    assert rows["a", "c2"]["v_gap"] == 0 and rows["a", "c3"]["v_gap"] is None and rows["a", "c1"]["n_candidates"] == 3
    assert rows["b", "c1"]["block_score_rel"] is None


def test_competition_vectors(spark):
    values = [("x", "r1", 0.9), ("x", "r2", 0.5), ("x", "r3", 0.7), ("y", "r1", 0.4), ("y", "r2", 0.4), ("z", "r1", 0.8), ("w", "r1", None), ("w", "r2", 0.5)]
    p = spark.createDataFrame([(s, c, v) for c, s, v in values], PAIRS)
    rows = {(r[CAND], r[S1]): (r["comp_rank"], None if r["comp_margin"] is None else round(r["comp_margin"], 6), r["comp_n_s1"]) for r in windows.competition(p, "score", "comp").collect()}
    assert rows["x", "r1"] == (0, 0.2, 3) and rows["x", "r2"] == (2, -0.4, 3) and rows["x", "r3"] == (1, -0.2, 3)
    assert rows["y", "r1"] == (0, 0.0, 2) and rows["y", "r2"] == (1, 0.0, 2) and rows["z", "r1"] == (0, None, 1)
    assert rows["w", "r1"] == (1, None, 2) and rows["w", "r2"] == (0, None, 2)


def test_features_identity_and_undefined_address(spark):
    r = records(spark).unionByName(
        text.clean_records(spark.createDataFrame([("S3-9", "blue island bakery ltd", None, "US"), ("S2-9", "blue island bakery ltd", "12 blue island avenue, chicago", "US")], "entity_id string, name string, address string, country string"), name="name", address="address")
    )
    p = spark.createDataFrame([("S1-1", "S2-9", 2.0, "US"), ("S1-1", "S3-9", 1.0, "US")], f"{PAIRS}, country string")
    rows = {x[CAND]: x for x in features.all_features(p, r).collect()}
    same, bare = rows["S2-9"], rows["S3-9"]
    for c in ("name_ratio", "name_token_set_ratio", "name_jaro_winkler", "name_tok_jaccard", "name_char3_dice", "addr_ratio", "addr_tok_idf_cos", "street_core_ratio"):
        assert same[c] == pytest.approx(1.0)
    assert bare["name_ratio"] == 1.0 and bare["addr_ratio"] is None and bare["addr_digit_match"] is None and bare["addr_both_present"] == 0.0
    assert bare["cand_is_source3"] == 1.0 and same["cand_is_source3"] == 0.0
    assert set(features.BASE_FEATURES) <= set(same.asDict()) and len(features.FEATURES) == 57


def test_labels_and_truth(spark):
    t = spark.createDataFrame([("a", "x, y,,"), ("b", ""), ("c", None)], f"{S1} string, matched_entity_ids string")
    pairs = labels.truth_pairs(t)
    assert {tuple(r) for r in pairs.collect()} == {("a", "x"), ("a", "y")}
    p = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0)], PAIRS)
    assert {(r[S1], r["label"]) for r in labels.label_pairs(p, pairs).collect()} == {("a", 1), ("b", 0)}
    assert labels.label_pairs(p.limit(0), pairs).count() == 0
    s1 = spark.createDataFrame([("a", "US"), ("b", "US"), ("z", "US")], "entity_id string, country string")
    good = spark.createDataFrame([("a", "x,y"), ("b", "")], f"{S1} string, matched_entity_ids string")
    assert {(r[S1], r["n_true"]) for r in labels.entity_truth(s1, good).collect()} == {("a", 2), ("b", 0), ("z", 0)}


def test_f05(spark):
    df = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (0, 1, 0), (0, 0, 1)], "tp long, p long, n long")
    got = [r[0] for r in df.select(metrics.f05(F.col("tp"), F.col("p"), F.col("n"))).collect()]
    assert got == pytest.approx([0.7142857, 1.0, 0.0, 0.0])


def test_threshold_sweep_counts_all_entities(spark):
    rng = random.Random(2)
    ents = [(f"e{i}", str(i % 2), rng.randint(0, 2)) for i in range(30)]
    rows = [(f"e{rng.randint(0, 24)}", f"c{k}", rng.randint(0, 20) / 20, rng.randint(0, 1)) for k in range(150)]
    entities = spark.createDataFrame(ents, f"{S1} string, country string, n_true int")
    pairs = spark.createDataFrame(rows, f"{PAIRS}, label int")
    grid = spark.createDataFrame([(i / 20,) for i in range(1, 21)], "threshold double")
    for r in metrics.threshold_sweep(entities, pairs, grid).collect():
        want = []
        for e, _, n in ents:
            own = [x for x in rows if x[0] == e and x[2] >= r["threshold"]]
            tp = sum(x[3] for x in own)
            den = 1.25 * tp + 0.25 * (n - tp) + len(own) - tp
            want.append(1.25 * tp / den if den > 0 else 1.0)
        assert r["macro_f05"] == pytest.approx(sum(want) / len(want))
    best = metrics.best_threshold(spark.createDataFrame([(0.5, 0.7), (0.4, 0.7), (0.9, 0.1)], "threshold double, macro_f05 double")).first()
    assert best["threshold"] == 0.4


def test_select_matches_and_ties(spark):
    p = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.95), ("a", "y", 0.8), ("b", "y", 0.8), ("a", "z", 0.3)], PAIRS)
    assert {(r[S1], r[CAND]) for r in decide.select_matches(p, 0.5).collect()} == {("b", "x"), ("a", "y")}


def brute_best_k(q):
    best, arg = None, 0
    for k in range(len(q) + 1):
        e = 0.0
        for truth in product((0, 1), repeat=len(q)):
            pr = math.prod(p if t else 1 - p for p, t in zip(q, truth))
            tp, n = sum(truth[:k]), sum(truth)
            den = 1.25 * tp + 0.25 * (n - tp) + k - tp
            e += pr * (1.25 * tp / den if den > 0 else 1.0)
        if best is None or e > best + 1e-12:
            best, arg = e, k
    return arg


def test_expected_f_decisions(spark):
    assert decide.best_k(np.array([0.6])) == 1 and decide.best_k(np.array([0.4])) == 0
    rng = random.Random(4)
    for _ in range(40):
        q = sorted((rng.random() for _ in range(rng.randint(1, 7))), reverse=True)
        assert decide.best_k(np.array(q)) == brute_best_k(q)
    p = spark.createDataFrame([("a", "x", 0.6), ("a", "y", 0.1), ("b", "z", 0.99), ("c", "u", 0.1), ("a", "v", 0.005)], PAIRS)
    assert {(r[S1], r[CAND]) for r in decide.expected_f_matches(p, 0.75).collect()} == {("a", "x"), ("b", "z")}


def test_entity_split_sizes(spark):
    e = spark.createDataFrame([(f"e{i}", "US" if i < 90 else "FR") for i in range(100)], f"{S1} string, country string")
    rows = sampling.entity_split(e).groupBy("country", "role").count().collect()
    n = {(r["country"], r["role"]): r["count"] for r in rows}
    assert (n["US", "val"], n["US", "early_stop"], n["US", "fit"]) == (14, 4, 72)
    assert n["FR", "val"] == 2 and n.get(("FR", "early_stop"), 0) == 0
    again = sampling.entity_split(e.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sampling.entity_split(e).collect()))


def test_validation_rules(spark):
    lines = spark.createDataFrame([(x,) for x in (f"{S1}\tids", "S1-1\tS2-1,S3-2", "S1-1\t", "S1-2\tS2-1,S2-1", "S1-3\tS1-9,X-1", "bad line")], "value string")
    rows = validate.parsed(lines, f"{S1}\tids")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-7",)], f"{S1} string")
    found = {r["rule"]: r["n_offenders"] for r in validate.report(rows.filter("not malformed"), required, spark.createDataFrame([("S2-1",), ("S3-2",)], "id string")).collect()}
    assert found == {"malformed": 0, "duplicate": 1, "repeated id": 1, "self match": 1, "unknown source": 1, "missing": 1, "unexpected": 1, "unknown id": 2}
    assert validate.malformed_rows(rows).count() == 1
    assert validate.check_header("a\tb", ("a", "b")) == [] and validate.check_header("", ("a", "b")) and validate.check_header("a,b", ("a", "b"))


def test_error_report(spark):
    scored = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.8, 0), ("b", "z", 0.1, 1)], f"{PAIRS}, label int")
    truth = spark.createDataFrame([("a", "x"), ("b", "z"), ("b", "lost")], f"{S1} string, matched_id string")
    entities = spark.createDataFrame([("a", "US", 1), ("b", "US", 2), ("c", "US", 0)], f"{S1} string, country string, n_true int")
    errors, by = reports.error_report(scored, truth, entities, 0.5)
    assert {(r["error_type"], r[CAND]) for r in errors.collect()} == {("FP", "y"), ("FN", "z"), ("MISS", "lost")}
    kinds = {r["kinds"]: r["loss_points"] for r in reports.error_summary(errors, by).collect()}
    assert set(kinds) == {"FP", "FN+MISS"} and kinds["FN+MISS"] == pytest.approx(1 / 3)


def test_exports(spark):
    scored = spark.createDataFrame([("a", "x", 0.99, 0.99), ("b", "x", 0.99, 0.995), ("a", "y", 0.1, 0.01)], f"{PAIRS}, ce double").withColumn("country", F.lit("US"))
    texts = spark.createDataFrame([(i, f"text {i}") for i in "abxy"], "id string, text string")
    assert {(r[S1], r[CAND], r["label"]) for r in exports.agreement_pairs(scored, texts).collect()} == {("b", "x", 1), ("a", "y", 0)}
    with pytest.raises(ValueError):
        exports.assert_disjoint(scored, scored)
    truth = spark.createDataFrame([("a", "x", "US"), ("b", "q", "US")], f"{S1} string, matched_id string, country string")
    rows = exports.triplets(truth, scored, texts).collect()
    assert {(r["anchor_id"], r["positive_id"], r["negative_id"], r["blocking_found"]) for r in rows} == {("a", "x", "y", True), ("b", "q", "x", False)}
    r = spark.createDataFrame([("1", "lille ecole", "12 rue x, lille"), ("2", "lille club", "9 rue y, lille"), ("3", "autre", "3 rue z, nice")], "id string, name string, address string").withColumn("text", F.col("name"))
    assert {tuple(x)[:2] for x in exports.same_source_negatives(r, by=F.col("id").cast("long")).collect()} == {("1", "2")}
