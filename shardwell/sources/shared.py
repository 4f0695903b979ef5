"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only where none is set on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="shardwell-")
        atexit.register(shutil.rmtree, made, True)
        root = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; the folder goes when the application ends."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = file_system(spark, out)
    fs.deleteOnExit(path)
    return out


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows written to the shared folder (in folders of the columns by) and read again: lineage ends there. Nothing else
    reads the shuffles behind them, so their files go at once."""
    out, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(out)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def signature(df: DataFrame) -> str:
    """Names, sizes and times of the files that a frame reads: equal if nothing was written meanwhile."""
    spark, parts = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        fs, path = file_system(spark, name)
        status = fs.getFileStatus(path)
        parts.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return "\n".join(parts)
