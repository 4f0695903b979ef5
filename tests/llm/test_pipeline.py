"""run() against the stages' operators worked out by hand on what each is given."""

import corpus_pipeline as p

from shardwell.llm import toxicity
from shardwell.llm.common import fold
from tests.llm.test_free import lower
from tests.llm.test_native import brute
from tests.llm.test_near_copies import kept as near_kept

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [k for k, _ in p.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id") != 0)
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in bad}
    last = {lower(t): i for i, t in sorted(left.items())}
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i in near_kept(list(left.items()))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = {d for d, _ in brute(list(left.items()), items)}
    out = p.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(left) - near
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    for name, stage in p.STAGES:  # an empty corpus
        assert stage(spark, docs.limit(0), SF).count() == 0, name
