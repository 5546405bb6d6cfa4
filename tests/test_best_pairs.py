"""The best candidates without a table of all pairs, and link without what its score does not read."""

import random

import pytest

from tessera.operators import blocking, features
from tessera.operators.keys import PAIR
from tessera.plans import linkage

from test_linkage import sides


@pytest.mark.parametrize("block, part", [(10**6, 10**6), (7, 40)])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_best_pairs_are_the_top_of_all_scores(spark, monkeypatch, block, part, k):
    monkeypatch.setattr(blocking, "BLOCK", block)
    monkeypatch.setattr(blocking, "PART", part)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(words[min(39, int(rng.expovariate(0.1)))] for _ in range(6))
    rows = [(None if i == 3 else f"r{i % 60}", text(), text(), rng.choice(["x", "y", None])) for i in range(90)]  # ids repeat, one is null
    rows += [(f"copy{i}", "w0 w1 w9", "w2", "x") for i in range(30)]
    records = spark.createDataFrame(rows, "entity_id string, name string, address_normalized string, country string").selectExpr("*", "split(name, ' ') as name_tokens")
    a, b = records.limit(40), records.filter("entity_id is null or entity_id > 'r2' or entity_id like 'c%'")
    rows_of = lambda df: sorted(map(str, df.select(*PAIR, "score", "country").collect()))
    want = rows_of(blocking.top_k(blocking.pair_scores(*blocking.select_keys(a, b)), k))
    assert want and rows_of(blocking.token_blocking(a, b, k=k)) == want


def test_link_without_a_model_stages_no_features(spark, monkeypatch):
    a, b = sides(spark)
    want = {tuple(r) for r in features.all_features(blocking.token_blocking(a, b), a.unionByName(b)).select(*PAIR, "name_tok_idf_cos").collect()}
    wrote = []
    monkeypatch.setattr(linkage, "staged", lambda df, name, f=linkage.staged: (wrote.append(set(df.columns)), f(df, name))[1])
    monkeypatch.setattr(features, "staged", lambda df, name: pytest.fail("features are not asked for"))
    linkage.link(a, b).collect()
    assert not any({"address_middle", "name_ascii_folded"} & c for c in wrote)
    assert {tuple(r) for r in linkage.scored_pairs(blocking.token_blocking(a, b), a, b).collect()} == want
