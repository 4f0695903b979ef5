"""Garbage collection: marking by brute force; condemning, pardoning, sweeping; whole alias query against the loop."""

import hashlib
import random

from shardwell import catalog
from shardwell.operators.collect import ChunkStore, mark
from shardwell.plans.scalars import alias_arrivals
from tests.test_aliases import loop

SF = "/root/testdata/sf0.001"


def test_mark(spark):
    r = random.Random(5)
    edges = [(f"h{r.randrange(80)}", f"h{r.randrange(80)}") for _ in range(90)] + [("h1", None), (None, "h2")]
    roots = ["h1", "h2", "h2", "elsewhere", None]
    seen, stack = set(), [x for x in roots if x]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += [b for a, b in edges if a == x and b]
    got = mark(spark.createDataFrame([(x,) for x in roots], "hash string"), spark.createDataFrame(edges, "src string, dst string")).collect()
    assert sorted(x.hash for x in got) == sorted(seen)


def test_epochs(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s", buckets=3)
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    chunks = frame([(h(t), t) for t in "abcdef"] + [(h("g"), "not g"), (h("a"), "a")], "hash string, content string")
    assert store.put(chunks, "one") and not store.put(chunks, "one") and store.put(chunks, "two")
    assert store.table("chunks").count() == 7
    edges = frame([(h("a"), h("b")), (h("b"), h("missing"))], "src string, dst string")
    roots = lambda *names: frame([(h(x),) for x in names], "hash string")
    names = {h(x): x for x in "abcdefg"}
    state = lambda t: {names[x.hash] for x in store.table(t).collect()}

    store.collect(roots("a", "c"), edges, 1, grace=2)
    assert state("chunks") == set("abcdef") and state("condemned") == set("def")  # g is corrupt
    store.collect(roots("a", "d"), edges, 2, grace=2)
    assert state("condemned") == set("cef") and state("chunks") == set("abcdef")  # d is pardoned
    before = store.manifest()
    assert not store.collect(roots(), edges, 2, grace=2) and store.manifest() == before
    store.collect(roots("a", "d"), edges, 3, grace=2)
    assert state("chunks") == set("abcd") and state("condemned") == {"c"}
    assert {(names[x.hash], x.epoch, x.reason) for x in store.table("swept").collect()} == {("g", 1, "corrupt"), ("e", 3, "unreachable"), ("f", 3, "unreachable")}
    store.collect(roots(*"abcd"), edges, 4, grace=2)
    assert state("condemned") == set() and state("chunks") == set("abcd")
    assert store.table("chunks", version=2).count() == 7  # versions stay readable


def test_all_aliases(spark):
    import duckdb

    arrivals = [tuple(x) for x in alias_arrivals(spark, SF).collect()]
    used = {x for (x,) in duckdb.sql(f"SELECT p_name || '-' || (p_size % 7 + 1) FROM '{SF}/part.parquet' WHERE p_partkey % 5 = 0").fetchall()}
    assert {x.p_partkey: x.alias for x in catalog.QUERIES["scal39_aliases"](spark, SF).collect()} == loop(arrivals, used)
