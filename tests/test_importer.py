"""Import with deduplication: batches against one import of all, filters, replays."""

import random

from shardwell.operators.importer import ImportStore

SCHEMA = "seq long, id string, hash string"


def expected(rows):
    first, edges = {}, set()
    for _, i, h in sorted(rows):
        if h in first and i != first[h]:
            edges.add((i, first[h]))
        first.setdefault(h, i)
    return {(i, h) for h, i in first.items()}, edges


def state(store):
    return {tuple(x) for x in store.table("nodes").select("id", "hash").collect()}, {tuple(x) for x in store.table("edges").filter("edge_type = 'EQUIVALENT_TO'").select("src", "dst").collect()}


def test_batches(spark, tmp_path):
    r = random.Random(9)
    rows = [(k, f"demo:c{k}", f"hash{r.randrange(70) if r.random() < 0.7 else 0}") for k in range(150)]
    store, done = ImportStore(spark, f"file://{tmp_path}/s", buckets=4), []
    for k in range(3):
        part = rows[k * 50 : k * 50 + 50]
        frame = spark.createDataFrame(part, SCHEMA).repartition(3)
        assert store.put(frame, f"b{k}") is not None
        done += part
        assert state(store) == expected(done)
        before = store.manifest()
        assert store.put(frame, f"b{k}") is None and store.manifest() == before


def test_only_folders_that_may_hold_a_hash_are_opened(spark, tmp_path):
    store = ImportStore(spark, f"file://{tmp_path}/s", buckets=8)
    assert store.put(spark.createDataFrame([(k, f"c{k}", f"h{k}") for k in range(100)], SCHEMA), "one") == []  # nothing is there yet
    fresh = spark.createDataFrame([(200 + k, f"d{k}", f"other{k}") for k in range(100)], SCHEMA)
    assert store.possible(fresh.select("hash")).count() < 5  # 100 of 1,048,576 bits are set
    known = spark.createDataFrame([(300, "e", "h7"), (301, "f", "h7")], SCHEMA)
    assert [x.hash for x in store.possible(known.select("hash")).collect()] == ["h7", "h7"]
    assert len(store.put(known, "two")) == 1
    assert {("e", "c7"), ("f", "c7")} == state(store)[1]
    assert store.possible(spark.createDataFrame([(f"h{k}",) for k in range(100)], "hash string")).count() == 100
