"""The versioned graph store against a sequential model; replays, buckets, versions, streams."""

import random

import pytest

from shardwell.operators.graph_store import CHUNK, GraphStore
from shardwell.sources.versioned import Conflict


class Model:
    """The rules, one write after another."""

    def __init__(self):
        self.nodes, self.symbols, self.aliases, self.forward, self.reverse = {}, {}, {}, {}, {}

    def put(self, chunks, registry):
        for c in chunks:
            self.nodes[c[0]] = c
            for s in c[5]:
                self.symbols[s] = c[0]
            for a in c[7]:
                self.aliases[a] = c[0]
            if c[8]:
                self.forward[c[0]] = set(c[8])
            for kind, dst in c[8]:
                self.reverse.setdefault(dst, set()).add((kind, c[0]))
        for c in chunks:
            for wanted in c[6]:
                dst = registry.get(wanted)
                if dst is None and self.symbols.get(wanted) not in (None, c[0]):
                    dst = self.symbols[wanted]
                if dst is not None:
                    self.forward.setdefault(c[0], set()).add(("imports", dst))
                    self.reverse.setdefault(dst, set()).add(("imports", c[0]))

    def delete(self, ids):
        for i in ids:
            if (c := self.nodes.pop(i, None)) is not None:
                for s in c[5]:
                    self.symbols.pop(s, None)
                for a in c[7]:
                    self.aliases.pop(a, None)
                self.forward.pop(i, None)
                self.reverse.pop(i, None)

    def state(self):
        lists = lambda d: {(k, *e) for k, es in d.items() for e in es}
        return {(k, v[1]) for k, v in self.nodes.items()}, set(self.symbols.items()), set(self.aliases.items()), lists(self.forward), lists(self.reverse)


def state(store):
    rows = lambda t, *cs: {tuple(r) for r in store.table(t).select(*cs).collect()}
    return rows("nodes", "chunk_id", "seq"), rows("symbols", "symbol", "owner"), rows("aliases", "alias", "owner"), rows("forward", "src", "edge_type", "dst"), rows("reverse", "dst", "edge_type", "src")


def chunk(i, seq, provides=(), requires=(), aliases=(), outgoing=()):
    return (i, seq, f"h{seq}", "rust", 1, list(provides), list(requires), list(aliases), list(outgoing))


def test_wiring(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s", buckets=3)
    assert state(store) == (set(),) * 5
    rows = [chunk("chunk:a", 1, requires=["helper", "own", "none"], provides=["own"]), chunk("chunk:b", 2, provides=["helper"])]
    registry = spark.createDataFrame([("helper", "chunk:b")], "alias string, owner string")
    store.put(spark.createDataFrame(rows, CHUNK), registry, "one")
    assert state(store)[3] == {("chunk:a", "imports", "chunk:b")} and state(store)[4] == {("chunk:b", "imports", "chunk:a")}


def test_batches_against_the_model(spark, tmp_path):
    r, store, model = random.Random(7), GraphStore(spark, f"file://{tmp_path}/s", buckets=4), Model()
    registry = {"x1": "n3", "x2": "n4"}
    frame = spark.createDataFrame(list(registry.items()), "alias string, owner string")
    seq = 0
    for k in range(3):
        rows = []
        for _ in range(25):
            seq += 1
            pick = lambda p, n, most: [f"{p}{r.randrange(n)}" for _ in range(r.randrange(most))]
            rows.append(chunk(f"n{r.randrange(20)}", seq, pick("s", 15, 3), [*pick("s", 18, 3), *pick("x", 4, 2)], pick("a", 6, 2), {(r.choice(["calls", "imports"]), f"n{r.randrange(24)}") for _ in range(r.randrange(3))}))
        data = spark.createDataFrame(rows, CHUNK).repartition(3)
        assert store.put(data, frame, f"b{k}")
        model.put(rows, registry)
        assert state(store) == model.state()
        before = store.manifest()
        assert not store.put(data, frame, f"b{k}") and store.manifest() == before  # a replay
    ids = ["n1", "n5", "n7", "none"]
    store.delete(spark.createDataFrame([(i,) for i in ids], "chunk_id string"), "gone")
    model.delete(ids)
    assert state(store) == model.state()
    names = {n for n, _ in model.state()[0]}
    assert {tuple(x) for x in store.dangling().collect()} == {(s, d, t) for s, t, d in model.state()[3] if d not in names}
    assert {x.chunk_id for x in store.lookup("nodes", ["n2", "n3", "n1"]).collect()} == names & {"n2", "n3", "n1"}
    assert store.table("nodes", version=1).count() <= 20 and store.manifest(1)["batches"] == ["b0"]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s", buckets=16)
    none = spark.createDataFrame([], "alias string, owner string")
    store.put(spark.createDataFrame([chunk(f"n{k}", k) for k in range(200)], CHUNK), none, "all")
    first = store.manifest()["tables"]["nodes"]
    store.put(spark.createDataFrame([chunk("n7", 999)], CHUNK), none, "one")
    second = store.manifest()["tables"]["nodes"]
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == 16
    assert store.table("nodes").filter("seq = 999").count() == 1 and store.table("nodes").count() == 200


def test_two_writers_of_a_version(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s", buckets=2)
    started = store.start("late")[0]
    store.put(spark.createDataFrame([chunk("n1", 1)], CHUNK), spark.createDataFrame([], "alias string, owner string"), "first")
    with pytest.raises(Conflict):
        store.commit(started)
    assert store.manifest()["batches"] == ["first"]


def test_stream(spark, tmp_path):
    none = spark.createDataFrame([], "alias string, owner string")
    for k in range(3):
        spark.createDataFrame([chunk(f"n{k}", k, provides=[f"s{k}"], requires=[f"s{k - 1}"])], CHUNK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = GraphStore(spark, f"file://{tmp_path}/s", buckets=2)
    store.ingest(stream, none, "files", f"{tmp_path}/c1").awaitTermination()
    assert store.manifest()["version"] == 3 and store.table("nodes").count() == 3
    before = state(store)
    store.ingest(stream, none, "files", f"{tmp_path}/c2").awaitTermination()  # the checkpoint is lost: all batches come again
    assert state(store) == before and store.manifest()["version"] == 3
