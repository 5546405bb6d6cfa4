"""Records travel to their pairs packed, in slices that leave no shuffles behind; features are the same however many."""

import random

from pyspark.sql import functions as F

from tessera.operators import features
from tessera.plans import catalog

from test_whole_texts import documents, words


def texts(spark, folder):
    rng = random.Random(5)
    shared = [words(rng, 3) for _ in range(8)]
    rows = [(i, f"{words(rng, 4)} {rng.choice(shared)}. {rng.randrange(99)} {words(rng, 12)}, {rng.choice(shared)} 7, {words(rng, 3)}", "en" if i % 3 else "de") for i in range(40)]
    return documents(spark, folder, [*rows, (40, None, "en"), (41, "", "en"), (42, "one.", None)])


def test_pairs_meet_packed_records_in_slices(spark, tmp_path, monkeypatch):
    d, wrote = texts(spark, tmp_path), {}
    whole = sorted(map(str, catalog.QUERIES["pair_features"](spark, d).collect()))
    inner = features.staged_parts

    def seen(parts, name):
        parts = list(parts)
        wrote[name] = (len(parts), set(parts[0].columns))
        return inner(parts, name)

    monkeypatch.setattr(features, "staged_parts", seen)
    monkeypatch.setattr(features, "SLICE", 11)
    got = sorted(map(str, catalog.QUERIES["pair_features"](spark, d).collect()))
    assert got == whole and len(got) > 20
    assert wrote["corpus"] == (4, {"entity_id", "side", "asked", "found"}) and wrote["features"][0] == 4


def test_a_side_is_the_same_after_its_journey(spark, tmp_path):
    a, b = catalog._cleaned(spark, texts(spark, tmp_path))
    known = features.prepared(a.unionByName(b))
    sizes = known.groupBy("country").agg(F.count("*").alias("n_docs"))
    sides = features.corpus(known, features.repeated_tokens(known, features.TOKENS), sizes)
    inside = [f for f in features.flat(sides).schema if f.name != "entity_id"]
    packed = features.pack(features.flat(sides), [f.name for f in inside], "q")
    back = features.unpack(packed, {"q": features.T.StructType(inside)}).withColumn("q", features.restored("q"))
    cols = [c for c in sides.columns if c != "entity_id"]
    want = {r["entity_id"]: [r[c] for c in cols] for r in sides.collect()}
    assert len(want) == 43 and {r["entity_id"]: [r[c] for c in cols] for r in back.select("entity_id", *(f"q.{c}" for c in cols)).collect()} == want
