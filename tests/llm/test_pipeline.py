"""The pipeline over the smallest tables, each stage against plain Python on its own input."""

import re

import corpus_pipeline
from tessera.llm import minhash, pii, queries
from tessera.llm.common import written

from test_ops import components_of, mix_brute, score_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "toxicity":
            model = queries.toxicity_model(before, queries.table(spark, SF, "labels"))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect() if score_brute(model, r["text"]) < 0.5}
        if name == "near duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = {i for i, (_, c) in components_of(rows, 80).items() if i == c}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "personal data":
            field = pii.train(pii.labelled_table(spark))
            assert pii.digest(pii.find(docs, field)).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
            same = before.join(pii.find(before, field).filter("size(spans) = 0"), "doc_id").join(docs.select("doc_id", docs["text"].alias("after")), "doc_id")
            assert same.filter("text != after").count() == 0
        if name == "mixing":
            rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
            words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            got = {}
            for r in docs.collect():
                got[r["source"]] = got.get(r["source"], 0) + words(r["text"])
            largest = {}
            for _, t, s in rows:
                largest[s] = max(largest.get(s, 0), words(t))
            for s, target in mix_brute(rows).items():
                assert abs(got.get(s, 0) - target) <= largest[s]
    assert counts[0] >= counts[1] > counts[2] == counts[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == counts[4] and out.filter("not same").count() == 0
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_run_registers(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.run(spark, SF).count() > 0
