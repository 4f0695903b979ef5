"""Import with deduplication: the first chunk of a hash becomes a node, each later one an EQUIVALENT_TO edge to that node.

The index of hashes is kept between batches, in folders by hash. Beside each folder stands a filter of WORDS bitmaps of
32,768 bits: a hash whose bit isn't set was never imported, so that a batch opens only the folders that may hold one of its
hashes, and rewrites only those that get new ones. A chunk is equivalent to all before it of its hash; as these are
one class, the edge leads to the class's node, not to each member.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwell.sources.shared import written
from shardwell.sources.versioned import Versioned

#: Bitmaps of a folder's filter; with 64 folders all filters are 64 x 4 x 4 KB.
WORDS = 4
BITS = 32_768


def _place(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(WORDS * BITS))


@dataclass
class ImportStore(Versioned):
    TABLES: ClassVar[dict[str, tuple[str, str]]] = {
        "hashes": ("hash", "hash string, node string"),
        "filters": ("slot", "slot string, word long, bits binary"),
        "nodes": ("id", "id string, hash string"),
        "edges": ("src", "src string, dst string, edge_type string, hash string"),
    }

    def possible(self, hashes: DataFrame) -> DataFrame:
        """The rows of hashes (hash) whose bit is set in the filter of their folder."""
        asked = hashes.withColumn("_p", _place(F.col("hash"))).withColumn("slot", self.bucket(F.col("hash")).cast("string")).withColumn("word", F.floor(F.col("_p") / BITS))
        at = F.col("_p") % BITS
        octet = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        met = asked.join(F.broadcast(self.table("filters")), ["slot", "word"]).filter(F.floor(octet / F.pow(F.lit(2), at % 8)) % 2 == 1)  # its size is bounded above
        return met.select(*hashes.columns)

    def put(self, chunks: DataFrame, batch: str) -> list[int] | None:
        """Imports chunks (seq, id, hash) in order of seq; the folders of the index that it opened. None: it is there already."""
        started = self.start(batch)
        if started is None:
            return None
        manifest, folder = started
        own = written(chunks.groupBy("hash").agg(F.min_by("id", "seq").alias("first")), "own")
        maybe = written(self.possible(own), "maybe")
        opened = sorted(r[0] for r in maybe.select(self.bucket(F.col("hash"))).distinct().collect())  # no more than there are folders
        index = self.read("hashes", {b: f for b, f in manifest["tables"]["hashes"].items() if int(b) in opened}).select("hash", "node")
        known = written(maybe.select("hash").join(index, "hash"), "known")
        new = written(own.join(known.select("hash"), "hash", "left_anti").select("hash", F.col("first").alias("node")), "new")
        nodes = known.unionByName(new)
        key = lambda df, c: df.select(F.col(c).alias("key"))

        self.merge(manifest, folder, "hashes", key(new, "hash"), lambda old: old.unionByName(new))
        bits = new.select(self.bucket(F.col("hash")).cast("string").alias("slot"), _place(F.col("hash")).alias("p"))
        bits = bits.groupBy("slot", F.floor(F.col("p") / BITS).alias("word")).agg(F.bitmap_construct_agg(F.col("p") % BITS).alias("bits"))
        self.merge(manifest, folder, "filters", key(bits, "slot"), lambda old: old.unionByName(bits).groupBy("slot", "word").agg(F.bitmap_or_agg("bits").alias("bits")))
        made = new.select(F.col("node").alias("id"), "hash")
        self.merge(manifest, folder, "nodes", key(made, "id"), lambda old: old.unionByName(made))
        edges = chunks.join(nodes, "hash").filter("id <> node").select(F.col("id").alias("src"), F.col("node").alias("dst"), F.lit("EQUIVALENT_TO").alias("edge_type"), "hash")
        edges = written(edges.distinct(), "edges")
        self.merge(manifest, folder, "edges", key(edges, "src"), lambda old: old.unionByName(edges).distinct())
        self.commit(manifest)
        return opened
