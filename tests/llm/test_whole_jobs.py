"""Operators do their whole job: no finding is left out by a limit that the contract does not have."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, minhash, mips, toxicity

from test_ops import docs_of


def test_toxicity_uses_significant_grams_of_small_ratio(spark):
    rng = random.Random(11)
    text = lambda share: " ".join(str(rng.random()) for _ in range(5)) + (" moron" if rng.random() < share else "")
    docs = docs_of(spark, [(i, text(0.6 if i % 2 else 0.3)) for i in range(1200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.place.max() >= 0
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, [(1, "a moron"), (2, "a")]), model, ["doc_id"]).collect()}
    assert got[1] > 0.5 > got[2]
    assert (toxicity.MOST_ROWS, toxicity.MOST_FEATURES) == (30_000, 20_000)


def test_pipeline_drops_copies_from_four_fifths_on(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    near = [*words[:94], *(f"x{i}" for i in range(10))]  # 90 shared of 110: 0.818
    docs = docs_of(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"y{i}" for i in range(104)))])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
    assert sorted(r["component_id"] for r in minhash.near_duplicates(docs).collect()) == [1, 2, 3]


def test_vectors_of_any_number_of_lengths(spark, monkeypatch):
    """1,001 numbers of components, three vectors each, two of them by the index."""
    monkeypatch.setattr(mips, "LENGTHS", 2)
    rng, rows = random.Random(5), []
    for dims in range(1, 1002):
        rows += [(3 * dims + j, [rng.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(dims)]) for j in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    by = {}
    for i, v in rows:
        by.setdefault(len(v), []).append((i, v))
    product = lambda v, w: sum(x * y for x, y in zip(v, w))
    want = {}
    for group in by.values():
        for i, v in group:
            if i % 3 == 0:
                want[i] = [j for _, j in sorted((-product(v, w), j) for j, w in group if j != i)]
    for search in (lambda: mips.exact_topk(frame, F.col("vec_id") % 3 == 0, k=2, scale=2), lambda: ann.nearest(frame, F.col("vec_id") % 3 == 0, k=2)):
        got = {}
        for r in search().orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == want
