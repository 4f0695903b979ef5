"""Garbage collection of a chunk store: mark what manifests reach, condemn the rest, sweep what stays condemned.

Marking follows edges from all roots at once, a join a step, with one row a chunk however many roots reach it. A chunk that
nothing reaches is condemned with the epoch of the run, pardoned when a later run reaches it, and swept when it has been
condemned for `grace` epochs: what a writer has stored but not yet named in a manifest isn't lost. A chunk whose content doesn't
have its hash is swept at once. Sweeping rewrites the buckets that have swept chunks, in one version; a run of an epoch that was
already run changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.functions.text import sha256
from shardwell.sources.shared import written
from shardwell.sources.versioned import Versioned


def mark(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """hash of all that the roots (hash) reach over edges (src, dst), themselves included."""
    seen = frontier = written(roots.select("hash").filter("hash IS NOT NULL").distinct(), "mark")
    while not frontier.isEmpty():
        step = frontier.join(edges.select(F.col("src").alias("hash"), "dst"), "hash").select(F.col("dst").alias("hash")).filter("hash IS NOT NULL").distinct()
        frontier = written(step.join(seen, "hash", "left_anti"), "mark")
        seen = seen.unionByName(frontier)
    return seen


@dataclass
class ChunkStore(Versioned):
    TABLES: ClassVar[dict[str, tuple[str, str]]] = {
        "chunks": ("hash", "hash string, content string, size long"),
        "condemned": ("hash", "hash string, since long"),
        "swept": ("hash", "hash string, epoch long, reason string"),
    }

    def put(self, chunks: DataFrame, batch: str) -> bool:
        """Stores chunks (hash, content) that aren't there yet."""
        started = self.start(batch)
        if started is None:
            return False
        manifest, folder = started
        new = chunks.groupBy("hash").agg(F.min("content").alias("content")).withColumn("size", F.octet_length("content").cast("long"))
        self.merge(manifest, folder, "chunks", new.select(F.col("hash").alias("key")), lambda old: old.unionByName(new.join(old.select("hash"), "hash", "left_anti")))
        self.commit(manifest)
        return True

    def collect(self, roots: DataFrame, edges: DataFrame, epoch: int, grace: int = 1) -> bool:
        """One run: roots (hash), edges (src, dst)."""
        started = self.start(f"epoch {epoch}")
        if started is None:
            return False
        manifest, folder = started
        chunks, old = self.table("chunks"), self.table("condemned")
        corrupt = chunks.filter(sha256(F.col("content")) != F.col("hash")).select("hash")
        alone = chunks.select("hash").join(mark(roots, edges), "hash", "left_anti").join(corrupt, "hash", "left_anti")
        since = alone.join(old, "hash", "left").select("hash", F.coalesce("since", F.lit(epoch).cast("long")).alias("since"))
        since = written(since, "since")
        due = since.filter(epoch - F.col("since") >= grace).select("hash", F.lit("unreachable").alias("reason"))
        swept = written(due.unionByName(corrupt.withColumn("reason", F.lit("corrupt"))), "swept")
        key = lambda df: df.select(F.col("hash").alias("key"))
        self.merge(manifest, folder, "chunks", key(swept), lambda rows: rows.join(swept.select("hash"), "hash", "left_anti"))
        left = since.join(swept.select("hash"), "hash", "left_anti")
        self.merge(manifest, folder, "condemned", key(since).unionByName(key(old)), lambda rows: left)
        log = swept.select("hash", F.lit(epoch).cast("long").alias("epoch"), "reason")
        self.merge(manifest, folder, "swept", key(log), lambda rows: rows.unionByName(log))
        self.commit(manifest)
        return True
