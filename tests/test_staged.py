"""A table in the shared folder leaves no shuffle files behind, and what link writes is tokenized once."""

from pyspark.sql import functions as F

from tessera.operators import blocking
from tessera.plans import linkage
from tessera.sources import stages

from test_linkage import sides


def test_clean_up_is_on_while_a_table_is_written_only(spark, monkeypatch):
    seen, before = [], spark.conf.get(stages.CLEANUP)
    writer = type(spark.range(1).write)
    monkeypatch.setattr(writer, "parquet", lambda self, *a, f=writer.parquet, **b: (seen.append(spark.conf.get(stages.CLEANUP)), f(self, *a, **b))[1])
    rows = stages.staged(spark.range(100).groupBy((F.col("id") % 7).alias("x")).count(), "t").collect()
    assert seen == ["true"] and spark.conf.get(stages.CLEANUP) == before and len(rows) == 7


def test_link_stages_tokens_not_texts(spark, monkeypatch):
    a, b = sides(spark)
    wrote = {}
    monkeypatch.setattr(linkage, "staged", lambda df, name, f=linkage.staged: (wrote.update({name: set(df.columns)}), f(df, name))[1])
    got = sorted(map(str, linkage.link(a, b).collect()))
    assert "address_keys" in wrote["targets"] and "address_normalized" not in wrote["targets"] | wrote["source1"]
    keyed = [r.withColumn("address_keys", blocking.address_keys(r)).drop("address_normalized") for r in (a, b)]
    assert sorted(map(str, blocking.token_blocking(*keyed).collect())) == sorted(map(str, blocking.token_blocking(a, b).collect())) and got
