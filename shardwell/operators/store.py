"""The graph store as a log of writes: node, seq, symbols (array), deps (array). What it holds follows from the log.

A write replaces the node. Of writes that define a symbol the last one owns it, even if its node is written again without
it. A node's forward list is that of its last write that has one; entries of reverse lists are only ever added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(writes: DataFrame) -> DataFrame:
    """The last write of each node."""
    return writes.groupBy("node").agg(F.max("seq").alias("seq"), F.max_by("symbols", "seq").alias("symbols"))


def symbol_index(writes: DataFrame) -> DataFrame:
    """symbol, node."""
    return writes.select("seq", "node", F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.max_by("node", "seq").alias("node"))


def forward(writes: DataFrame) -> DataFrame:
    """node, deps."""
    return writes.filter(F.size("deps") > 0).groupBy("node").agg(F.max_by("deps", "seq").alias("deps"))


def reverse(writes: DataFrame) -> DataFrame:
    """node, dependent."""
    return writes.select(F.explode("deps").alias("node"), F.col("node").alias("dependent")).distinct()


def without(writes: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The store after the nodes in gone (node) are deleted: with them go the symbols that they own and their own lists;
    what other nodes' lists say of them stays, dangling."""
    left = lambda df: df.join(gone.select("node"), "node", "left_anti")
    return {"nodes": left(nodes(writes)), "symbols": left(symbol_index(writes)), "forward": left(forward(writes)), "reverse": left(reverse(writes))}


def dangling(store: dict[str, DataFrame]) -> DataFrame:
    """node, missing: entries of forward lists that are no nodes (any more)."""
    each = store["forward"].select("node", F.explode("deps").alias("missing"))
    return each.join(store["nodes"].select(F.col("node").alias("missing")), "missing", "left_anti").select("node", "missing")
