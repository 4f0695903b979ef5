"""Strongly connected components against reachability, on random graphs with chains and rings, and on one long ring."""

import random
from collections import Counter

from shardwell.operators.components import components

SCHEMA = "src string, dst string"


def brute(nodes, edges):
    ahead = {n: set() for n in nodes}
    for a, b in edges:
        ahead[a].add(b)

    def reach(start):
        seen, stack = {start}, [start]
        while stack:
            for y in ahead[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        return seen

    reached = {n: reach(n) for n in nodes}
    return {n: min(m for m in reached[n] if n in reached[m]) for n in nodes}


def piece(r, p):
    n = r.randrange(2, 12)
    node = lambda: f"{p}v{r.randrange(n)}"
    edges = [(node(), node()) for _ in range(r.randrange(1, 2 * n))]
    for k in range(r.randrange(4)):
        chain = [f"{p}c{k}x{i}" for i in range(r.randrange(2, 9))]
        edges += zip(chain, chain[1:])
        for chance, edge in ((0.6, (chain[-1], node())), (0.6, (node(), chain[0])), (0.3, (node(), r.choice(chain))), (0.3, (chain[-1], chain[0])), (0.2, (r.choice(chain), node()))):
            if r.random() < chance:
                edges.append(edge)
    return edges


def test_random_graphs(spark):
    r, edges = random.Random(11), []
    for k in range(80):
        edges += piece(r, f"{k}-")
    edges += edges[:20] + [("0-v0", "1-v0"), ("1-v0", "2-v0")]
    nodes = {x for e in edges for x in e} | {"alone"}
    got = {x.node: (x.component, x.size) for x in components(spark.createDataFrame(edges, SCHEMA).repartition(4), spark.createDataFrame([("alone",), ("0-v0",)], "node string")).collect()}
    want = brute(nodes, edges)
    assert {k: v[0] for k, v in got.items()} == want
    members = list(want.values())
    assert all(size == members.count(c) for c, size in got.values()) and max(size for _, size in got.values()) > 5


def test_long_ring_and_path(spark):
    n = 100_000
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    path = spark.range(n).selectExpr(f"{n} + id AS src", f"{n} + id + 1 AS dst")
    tail = spark.createDataFrame([(2 * n, 5)], "src long, dst long")  # the path leads into the ring
    out = components(ring.unionByName(path).unionByName(tail))
    assert {tuple(x) for x in out.groupBy("component").count().filter("count > 1").collect()} == {(0, n)}
    assert out.count() == 2 * n + 1


def test_empty_and_loops(spark):
    assert components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {tuple(x) for x in components(spark.createDataFrame([("a", "a"), ("b", None)], SCHEMA)).collect()} == {("a", "a", 1), ("b", "b", 1)}


def test_rings_end_after_their_own_length(spark, monkeypatch):
    from shardwell.operators import components as module

    edges = []
    for r in range(60):  # rings of 1 to 9 nodes with a tail, beside paths
        ring = [f"r{r}-{k}" for k in range(1 + r % 9)]
        edges += [(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b] + [(f"a{r}-{k}", f"a{r}-{k + 1}") for k in range(3)] + [(f"a{r}-3", ring[0])]
        edges += [(f"p{r}-{k}", f"p{r}-{k + 1}") for k in range(r % 6)]
    label = brute({x for e in edges for x in e}, edges)
    sizes = Counter(label.values())
    want = {x: (c, sizes[c]) for x, c in label.items()}
    made, keep = [], module._keep
    monkeypatch.setattr(module, "_keep", lambda df: made.append(1) or keep(df))
    got = {x.node: (x.component, x.size) for x in module.components(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert got == want
    assert len(made) <= 24  # 40 before


def test_rings_with_ways_into_them_by_skipping(spark, monkeypatch):
    from shardwell.operators import components as module

    r, edges = random.Random(3), []
    for k in range(40):  # every node has one way out: rings of 1 to 40 nodes, trees that lead into them, paths that end
        ring = [f"r{k}-{i}" for i in range(k + 1)]
        r.shuffle(ring)
        edges += [(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]
        tree = list(ring)
        for i in range(k):
            tree.append(f"t{k}-{i}")
            edges.append((tree[-1], r.choice(tree[:-1])))
        edges += [(f"p{k}-{i}", f"p{k}-{i + 1}") for i in range(k % 20)]
    label = brute({x for e in edges for x in e}, edges)
    monkeypatch.setattr(module, "SHORT", 10)
    monkeypatch.setattr(module, "TRIMS", 2)
    got = {x.node: x.component for x in module.components(spark.createDataFrame(edges, SCHEMA)).collect()}
    assert got == label


def test_rounds_of_a_long_ring_shrink(spark, monkeypatch):
    from shardwell.operators import components as module

    n, rows, keep = 20_000, [], module._keep
    monkeypatch.setattr(module, "SHORT", 500, raising=False)
    monkeypatch.setattr(module, "_keep", lambda df: [kept := keep(df), rows.append(kept.count())][0])
    out = module.components(spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst"))
    assert {tuple(x) for x in out.groupBy("component", "size").count().collect()} == {(0, n, n)}
    assert sum(rows) < 10 * n  # 9 times; doubling alone writes all nodes in each of its 15 rounds
