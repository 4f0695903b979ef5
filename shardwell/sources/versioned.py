"""Versioned tables in folders by a hash of their key: batches are merged into the buckets that they touch.

One manifest, created under the next version's name, points at the current folder of each bucket of all tables, so that
readers see a whole batch or nothing of it, and of two writers of a version the second fails. The manifest also names the
batches that it holds: a batch that comes again (a stream that restarts) changes nothing.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.sources.shared import file_system


class Conflict(Exception):
    """Another writer made this version."""


@dataclass
class Versioned:
    spark: SparkSession
    path: str
    buckets: int = 64
    #: Table: its key, and its columns.
    TABLES: ClassVar[dict[str, tuple[str, str]]] = {}

    def _versions(self) -> list[int]:
        fs, path = file_system(self.spark, f"{self.path}/manifest")
        return sorted(int(f.getPath().getName().partition(".")[0]) for f in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict:
        """version, batches, and for each table the folder of each bucket."""
        found = self._versions()
        if not found:
            return {"version": 0, "batches": [], "tables": {t: {} for t in self.TABLES}}
        lines = self.spark.read.text(f"{self.path}/manifest/{version if version is not None else found[-1]:012d}.json").collect()
        return json.loads(lines[0][0])

    def commit(self, manifest: dict) -> None:
        fs, path = file_system(self.spark, f"{self.path}/manifest/{manifest['version']:012d}.json")
        if fs.exists(path):
            raise Conflict(str(path))
        try:
            out = fs.create(path, False)  # never over another writer's
        except Exception as e:
            raise Conflict(str(path)) from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.crc32(key.cast("binary")), F.lit(self.buckets)).cast("int")

    def read(self, name: str, folders: dict[str, str]) -> DataFrame:
        schema = self.TABLES[name][1] + ", bucket int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [f"{self.path}/data/{folder}/{name}/bucket={b}" for b, folder in folders.items()]  # as many as there are buckets
        roots = sorted({p.rpartition("/")[0] for p in parts})
        rows = None
        for root in roots:
            some = self.spark.read.schema(schema).option("basePath", root).parquet(*[p for p in parts if p.startswith(root + "/")])
            rows = some if rows is None else rows.unionByName(some)
        return rows

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.read(name, self.manifest(version)["tables"][name]).drop("bucket")

    def lookup(self, name: str, keys: list[str]) -> DataFrame:
        """Rows of some keys; only their buckets are read."""
        own = {str(zlib.crc32(k.encode()) % self.buckets) for k in keys}
        found = {b: f for b, f in self.manifest()["tables"][name].items() if b in own}
        return self.read(name, found).filter(F.col(self.TABLES[name][0]).isin(keys)).drop("bucket")

    def merge(self, manifest: dict, folder: str, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the buckets that keys (key) lie in; change makes a bucket's new rows from its old ones."""
        key, schema = self.TABLES[name]
        touched = sorted(r[0] for r in keys.filter("key IS NOT NULL").select(self.bucket(F.col("key"))).distinct().collect())
        if not touched:
            return
        folders = manifest["tables"][name]
        rows = change(self.read(name, {str(b): folders[str(b)] for b in touched if str(b) in folders}).drop("bucket"))
        rows = rows.filter(F.col(key).isNotNull()).withColumn("bucket", self.bucket(F.col(key))).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}/{name}")
        fs, path = file_system(self.spark, f"{self.path}/data/{folder}/{name}")
        made = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(path)}
        for b in map(str, touched):
            folders.pop(b, None)
            if b in made:
                folders[b] = folder

    def start(self, batch: str) -> tuple[dict, str] | None:
        manifest = self.manifest()
        if batch in manifest["batches"]:
            return None
        manifest["version"] += 1
        manifest["batches"].append(batch)
        return manifest, f"{manifest['version']:012d}-{uuid.uuid4().hex}"
