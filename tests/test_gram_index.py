"""The q-gram index against plain substring search."""

import random

import pytest
from pyspark.sql import functions as F

from shardwell.operators.gram_index import GramIndex, index_of
from shardwell.plans import ranking  # noqa: F401  registers
from shardwell.sources import corpus

SF = "/root/testdata/sf0.001"
SCHEMA = "key long, field string, part int, value string"
TEXTS = [(1, "a", 0, "The cat sat"), (1, "a", 0, "The cat sat"), (2, "a", 0, "aaaaaaaaaaaaaaaaab"), (3, "b", 0, ""), (4, "b", 0, None), (5, "b", 1, "é\N{GRINNING FACE}thé the"), (5, "b", 2, "x\ny\nTHE"), (None, "a", 0, "no key the")]


def texts(seed=1):
    r = random.Random(seed)
    rows = TEXTS + [(100 + k, r.choice("ab"), k % 3, "".join(r.choices("ab c", k=r.randrange(0, 60)))) for k in range(120)]
    return rows + [(300 + k, "a", 0, "long " * 3000 + f"needle {k}") for k in range(3)]


@pytest.mark.parametrize(("q", "step", "fold"), [(3, 1, False), (3, 1, True), (4, 3, False), (8, 4, True)])
def test_substrings(spark, q, step, fold):
    rows = texts()
    index = GramIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(3), q=q, step=step, buckets=5, fold=fold)
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    r = random.Random(q)
    needles = ["", "a", "the", "The cat", "\ny\n", "thé", "\N{GRINNING FACE}t", "a" * 12, "needle 1", "ng needle", "zzzzzzzzzzzz"] + ["".join(r.choices("ab c", k=n)) for n in range(1, 14)]
    for n in needles:
        want = {(k, f, p) for k, f, p, v in rows if v is not None and low(n) in low(v)}
        assert {tuple(x) for x in index.find(n).collect()} == want, n
        assert {tuple(x) for x in index.find(n, ("b",)).collect()} == {x for x in want if x[1] == "b"}
    asked = spark.createDataFrame([*enumerate(needles), (99, None)], "id long, needle string")
    got = {tuple(x) for x in index.find_all(asked).collect() if x.key is not None}
    assert got == {(i, k, f, p) for i, n in enumerate(needles) for k, f, p, v in rows if v is not None and k is not None and low(n) in low(v)}


def test_only_its_own_folders_are_read(spark):
    index = corpus.registry_index(spark, SF)
    plan = index.of(index.postings(), ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters")[1]
    read = {x.bucket for x in index.of(index.postings(), ["the"]).select("bucket").distinct().collect()}
    assert len(read) == 1


def test_built_once(spark, tmp_path):
    assert corpus.registry_index(spark, SF) is corpus.registry_index(spark, SF)
    out = str(tmp_path / "t")
    make = lambda n: spark.createDataFrame([(k, f"text {k}") for k in range(n)], "id long, t string").write.mode("overwrite").parquet(out)

    def index():
        d = spark.read.parquet(out)
        return index_of(d, d.select(F.col("id").alias("key"), F.lit("t").alias("field"), F.lit(0).alias("part"), F.col("t").alias("value")))

    make(4)
    first = index()
    assert index() is first and first.find("text 3").count() == 1
    make(9)
    assert index().find("text 8").count() == 1  # new files, new index


def test_empty(spark):
    index = GramIndex.build(spark.createDataFrame([], SCHEMA))
    assert index.find("abc").count() == index.find("abcdef").count() == index.find("").count() == 0
    assert index.find_all(spark.createDataFrame([(1, "abc"), (2, ""), (3, "abcdefgh")], "id long, needle string")).count() == 0


def test_no_task_writes_more_as_the_texts_grow(spark, monkeypatch):
    from shardwell.operators import gram_index

    monkeypatch.setattr(gram_index, "FILE_ROWS", 1000, raising=False)
    r = random.Random(5)
    rows = [(k, "a", 0, "".join(r.choices("abcdefghij", k=100))) for k in range(400)]
    index = GramIndex.build(spark.createDataFrame(rows, SCHEMA), q=4, buckets=4)
    for part in (index.postings(), index.counts()):
        files = part.groupBy(F.input_file_name()).count()
        assert files.agg(F.max("count")).first()[0] < 2000
    needle = rows[7][3][20:50]
    assert [x.key for x in index.find(needle).collect()] == [7]
