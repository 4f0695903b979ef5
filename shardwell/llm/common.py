"""What the training-data operators share: word rules, scratch tables, skew-safe joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word rule of the contracts (bytes 0x20 and 0x09-0x0D separate words).
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(c: Column) -> Column:
    """Array of lower-cased words, in native expressions; no words: an empty array."""
    return F.filter(F.split(lower_ascii(c), SPACES), lambda w: w != "")


def fold(name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5; a null id counts as the text "" (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where none is set on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="shardwell-")
        atexit.register(__import__("shutil").rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", f"file://{found}")
        found = f"file://{found}"
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


#: Bytes of rows that a Python worker gets at a time (Spark's own 64 MB stand in memory a few times over, in each task).
ARROW_BYTES = 8 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: their Python may not find the driver's folders. Rows hold
    whole texts, so they travel in small batches, unless the session already has a limit of its own."""
    if spark.conf.get(BATCHES, None) in (None, f"{64 << 20}b"):
        spark.conf.set(BATCHES, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if here.endswith(".zip") or not os.path.isdir(here):
        return
    folder = tempfile.mkdtemp(prefix="shardwell-code-")
    atexit.register(__import__("shutil").rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/shardwell_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.join("shardwell", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(f"{folder}/shardwell_code.zip")


class Scratch:
    """Tables written to the shared folder: lineage ends there, so a lost executor costs no more than one stage."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """The table, written and read back. Nothing else reads the shuffles behind it, so their files go at once."""
        out, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(out)
        finally:
            conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


#: A group at least this share of all rows is heavy; so there are at most HEAVY of them, whatever the input.
HEAVY = 512


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, salt: Column, total: int) -> DataFrame:
    """Left join of rows to groups (one row a key), safe when a few keys hold most rows.

    Groups of total/HEAVY rows or more, at most HEAVY of them, are broadcast; their rows then take part in the
    shuffled join under a key of their own (salt: a string column that spreads them) that meets nothing.
    """
    extra = [c for c in groups.columns if c != key]
    floor = max(2, total // HEAVY)
    heavy = groups.filter(F.col(size) >= floor).select(key, *(F.col(c).alias(f"_h_{c}") for c in extra))
    light = groups.filter(F.col(size) < floor).withColumnRenamed(key, "_k")
    hot = rows.join(F.broadcast(heavy), key, "left")
    met = F.col(f"_h_{size}").isNotNull()
    hot = hot.withColumn("_k2", F.when(met, F.concat(F.lit("#"), salt)).otherwise(F.col(key).cast("string")))
    light = light.withColumn("_k2", F.col("_k").cast("string")).drop("_k")
    out = hot.join(light, "_k2", "left")
    return out.select(*rows.columns, *(F.coalesce(f"_h_{c}", c).alias(c) for c in extra))


def scratch_budget() -> int:
    """Bytes a task may hold before it spills."""
    return int(os.environ.get("SHARDWELL_TASK_BYTES", 64 << 20))
