"""The graph store as versioned tables: batches are merged into the buckets of keys that they touch.

Five tables: nodes, symbols, aliases, forward, reverse; a batch changes all of them in one version.

What a batch does: a write replaces its node; of writes that define a symbol or an alias the last one owns it; a list of
outgoing edges that isn't empty replaces the node's forward list; entries of reverse lists are only added. When all nodes are
in, requirements are linked: an alias of the registry first, else the symbol's owner, if that isn't the node itself.
Deleting a node takes its symbols, its aliases and its own lists; what other nodes' lists say of it stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardwell.operators.storage import latest, resolve_requires
from shardwell.sources.versioned import Versioned

CHUNK = "chunk_id string, seq long, content_hash string, language string, size long, provides array<string>, requires array<string>, aliases array<string>, outgoing array<struct<edge_type: string, dst: string>>"
NODE = "chunk_id string, seq long, content_hash string, language string, size long, provides array<string>, aliases array<string>"
#: Table: its key, and its columns.
TABLES = {
    "nodes": ("chunk_id", NODE),
    "symbols": ("symbol", "symbol string, owner string"),
    "aliases": ("alias", "alias string, owner string"),
    "forward": ("src", "src string, edge_type string, dst string"),
    "reverse": ("dst", "dst string, edge_type string, src string"),
}


def names(column: str, rows: DataFrame) -> DataFrame:
    """name, owner of each name in an array column: of several writes the last, by its place within a write."""
    each = rows.select("seq", F.col("chunk_id").alias("owner"), F.posexplode(column).alias("place", "name"))
    return each.groupBy("name").agg(F.max_by("owner", F.struct("seq", "place")).alias("owner"))


@dataclass
class GraphStore(Versioned):
    TABLES: ClassVar[dict[str, tuple[str, str]]] = TABLES

    def put(self, chunks: DataFrame, registry: DataFrame, batch: str) -> bool:
        """Imports chunks (CHUNK), links what they require; registry: alias, owner. False: the batch is there already."""
        started = self.start(batch)
        if started is None:
            return False
        manifest, folder = started
        rows = chunks.select("chunk_id", "seq", "content_hash", "language", "size", "provides", "requires", "aliases", "outgoing")
        over = lambda key, new: lambda old: old.join(new.select(key), key, "left_anti").unionByName(new)
        keyed = lambda df, key: df.select(F.col(key).alias("key"))

        nodes = latest(rows.drop("requires", "outgoing"), "chunk_id", "seq").select("chunk_id", "seq", "content_hash", "language", "size", "provides", "aliases")
        self.merge(manifest, folder, "nodes", keyed(nodes, "chunk_id"), over("chunk_id", nodes))
        for table, column, key in (("symbols", "provides", "symbol"), ("aliases", "aliases", "alias")):
            own = names(column, rows).withColumnRenamed("name", key)
            self.merge(manifest, folder, table, keyed(own, key), over(key, own))

        listed = rows.filter(F.size("outgoing") > 0)
        replaced = latest(listed.select("chunk_id", "seq", "outgoing"), "chunk_id", "seq").select(F.col("chunk_id").alias("src"), F.explode("outgoing").alias("o")).select("src", "o.*")
        wants = rows.select(F.col("chunk_id").alias("src"), F.explode("requires").alias("wanted")).distinct()
        some = {str(r[0]) for r in wants.select(self.bucket(F.col("wanted"))).distinct().collect()}
        symbols = self.read("symbols", {b: f for b, f in manifest["tables"]["symbols"].items() if b in some}).select("symbol", "owner")
        linked = resolve_requires(wants, registry, symbols).select("src", F.lit("imports").alias("edge_type"), "dst").distinct()

        forward = replaced.unionByName(linked).distinct()
        gone = listed.select(F.col("chunk_id").alias("src")).distinct()
        self.merge(manifest, folder, "forward", keyed(forward, "src"), lambda old: old.join(gone, "src", "left_anti").unionByName(forward).distinct())
        reverse = listed.select(F.col("chunk_id").alias("src"), F.explode("outgoing").alias("o")).select("src", "o.*").unionByName(linked).select("dst", "edge_type", "src").distinct()
        self.merge(manifest, folder, "reverse", keyed(reverse, "dst"), lambda old: old.unionByName(reverse).distinct())
        self.commit(manifest)
        return True

    def delete(self, ids: DataFrame, batch: str) -> bool:
        """Deletes nodes (chunk_id) that are there."""
        started = self.start(batch)
        if started is None:
            return False
        manifest, folder = started
        gone = self.read("nodes", manifest["tables"]["nodes"]).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").drop("bucket")
        without = lambda keys, key: lambda old: old.join(keys.select(F.col("key").alias(key)), key, "left_anti")
        own = gone.select(F.col("chunk_id").alias("key"))
        for table, keys in (("symbols", gone.select(F.explode("provides").alias("key"))), ("aliases", gone.select(F.explode("aliases").alias("key"))), ("forward", own), ("reverse", own), ("nodes", own)):
            self.merge(manifest, folder, table, keys, without(keys, TABLES[table][0]))
        self.commit(manifest)
        return True

    def dangling(self) -> DataFrame:
        """src, dst, edge_type of forward entries whose target is no node."""
        return self.table("forward").join(self.table("nodes").select(F.col("chunk_id").alias("dst")), "dst", "left_anti").select("src", "dst", "edge_type")

    def ingest(self, stream: DataFrame, registry: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
        """Imports a stream of chunks, each of its batches once, also when a batch runs again after a failure."""
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, k: self.put(df, registry, f"{name}:{k}")).start()
