"""Training and tuning by country read the pairs from a table that is computed once."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.keys import S1
from tessera.plans import catalog, models

from test_io_and_models import table


def test_pairs_are_computed_once_and_results_are_those_of_each_country(spark, monkeypatch):
    t, entities = table(spark)
    entities = entities.select(S1, "country", "n_true")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    model = models.train_pairs(t, ["v"], role=None, rounds=2)
    monkeypatch.setattr(models, "train_pairs", lambda df, features, **options: model)
    got = models.leave_one_country_out(t.withColumn("v", counted("v")), entities, ["v"]).collect()
    assert seen.value == 400
    for r in got:
        rest, own = t.filter(F.col("country") != r["country"]), t.filter(F.col("country") == r["country"])
        threshold, _ = models.evaluate(model.score(rest), entities.filter(F.col("country") != r["country"]))
        there = entities.filter(F.col("country") == r["country"])
        want = [m.filter("country = 'ALL'").first()["macro_f05"] for m in (models.evaluate(model.score(own), there, threshold)[1], models.evaluate(model.score(own), there)[1])]
        assert [r["threshold"], r["transferred"], r["own"]] == pytest.approx([threshold, *want], abs=1e-12)
    assert [r["country"] for r in got] == ["0", "1"]


def test_the_query_trains_all_rounds(spark, monkeypatch):
    asked, boosted = [], models.boosted
    monkeypatch.setattr(models, "boosted", lambda **options: (asked.append(boosted(**options).getMaxIter()), boosted(rounds=1))[1])
    assert catalog.QUERIES["loco"](spark, "/root/testdata/sf0.001").count() == 3
    assert asked == [boosted().getMaxIter()] * 3 == [40] * 3
