"""Queries over all rows, besides their SQL, by brute force on the smallest tables."""

import duckdb

from shardwell import catalog

SF = "/root/testdata/sf0.001"


def rows(spark, name, sf_dir=SF):
    return [r.asDict() for r in catalog.QUERIES[name](spark, sf_dir).collect()]


def test_equivalents_of_all_documents(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    want = {(a, b) for a in texts for b in texts if a != b and texts[a] == texts[b]}
    members: dict = {}
    for r in rows(spark, "join12_equivalents"):
        members.setdefault(r["class"], []).append(r["doc_id"])
    assert {(a, b) for m in members.values() for a in m for b in m if a != b} == want
    assert any(a >= 100 for a, _ in want)


def test_compatible_pairs_of_all_parts(spark):
    want = set(duckdb.sql(f"SELECT p_partkey, o_orderkey FROM '{SF}/part.parquet' JOIN '{SF}/orders.parquet' ON p_size = o_custkey").fetchall())
    sides: dict = {}
    for r in rows(spark, "join09_compatible"):
        sides.setdefault(r["t"], {"provider": [], "consumer": []})[r["side"]].append(r["id"])
    assert {(p, c) for s in sides.values() for p in s["provider"] for c in s["consumer"]} == want


def test_expansion_of_all_orders(spark):
    from shardwell.operators.graph import AGGRESSIVE, CONSERVATIVE, Policy, simulate
    from shardwell.sources import corpus

    out: dict = {}
    for r in sorted(corpus.edges(spark, SF).collect(), key=lambda r: (r.edge_type, r.dst)):
        out.setdefault(r.src, []).append((r.edge_type, r.dst))
    tokens = {r.node_id: r.tokens for r in corpus.nodes(spark, SF).collect()}
    seeds: dict = {}
    for c, o in duckdb.sql(f"SELECT o_custkey, o_orderkey FROM '{SF}/orders.parquet' ORDER BY ALL").fetchall():
        seeds.setdefault(c, []).append(f"orders:{o}")
    got = {r["grp"]: (r["included"], r["tokens"], r["depth"], r["truncated"]) for r in rows(spark, "grf04_expansion")}
    assert got == {c: simulate(s, out, tokens, Policy()) for c, s in seeds.items()}
    got = {(r["grp"], r["policy"]): (r["n"], r["tokens"], r["depth"], r["truncated"]) for r in rows(spark, "grf05_policies")}
    for name, policy in (("default", Policy()), ("conservative", CONSERVATIVE), ("aggressive", AGGRESSIVE)):
        for c, s in seeds.items():
            included, *rest = simulate(s, out, tokens, policy)
            assert got[c, name] == (len(included), *rest)
    assert any(got[c, "aggressive"] != got[c, "default"] for c in seeds)


def test_members_with_short_first_lines(spark, tmp_path):
    items = [(1, "Thing."), (2, "Rrquell.\nand a second line"), (3, "x"), (4, ""), (5, None), (6, "exactly 12ch"), (7, "longer than twelve"), (8, "é\n"), (9, "Absent.")]
    docs = [(1, "Some Thing. here"), (2, "a\nRrquell.\nand a second line\n"), (3, "Rrquell.\nand another"), (4, ""), (5, None), (6, "x"), (7, "é\nexactly 12ch longer than twelve"), (8, "Thing"), (9, "Thing. Thing.")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, d) for i, item in items for d, text in docs if item is not None and text is not None and item in text)
    assert sorted((r["item_id"], r["doc_id"]) for r in rows(spark, "join05_members", str(tmp_path))) == want


def test_graph_has_the_edges_of_lineitem(spark):
    for name, reached in (("grf01_dependencies", {"part", "supplier"}), ("grf01_dependents", {"part"}), ("grf06_auto_expand", {"part", "supplier"})):
        assert reached <= {r["node_id"].split(":")[0] for r in rows(spark, name)}, name
    assert {"part", "supplier"} <= {r["node"].split(":")[0] for r in rows(spark, "grf13_adjacency")}
    assert any("supplier:" in r["chain"] for r in rows(spark, "grf08_chain"))
