"""The data model's tables as Spark schemas, and readers and writers for them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINES = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
NODE = T.StructType(
    [T.StructField(n, t) for n, t in (("chunk_id", T.StringType()), ("content_hash", T.StringType()), ("primary_alias", T.StringType()), ("aliases", T.ArrayType(T.StringType())), ("symbols_defined", T.ArrayType(T.StringType())), ("symbols_referenced", T.ArrayType(T.StringType())), ("language", T.StringType()), ("granularity", T.StringType()), ("byte_size", T.LongType()), ("token_estimate", T.LongType()), ("source_file", T.StringType()), ("source_lines", LINES), ("metadata", T.MapType(T.StringType(), T.StringType())), ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()))]
)
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "dst", "edge_type")])
SEMANTIC_EDGE = T.StructType([*EDGE.fields, T.StructField("confidence", T.DoubleType()), T.StructField("context", T.StringType())])
REGISTRY = T.StructType(
    [T.StructField("chunk_id", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("name", "description", "language")], T.StructField("concepts", T.ArrayType(T.StringType())), T.StructField("quality", T.DoubleType()), T.StructField("coverage", T.DoubleType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modified, length, content (bytes), encoding, text of the files under a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.withColumn("encoding", F.when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("unknown")).withColumn("text", text)


def write_chunks(df: DataFrame, path: str, hash_col: str = "hash") -> None:
    """Content-addressed Parquet, in folders by the first two digits of the hash."""
    df.withColumn("shard", F.substring(hash_col, 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def read_chunk(spark: SparkSession, path: str, hash_: str, hash_col: str = "hash") -> DataFrame:
    """The rows of one hash; only its folder is read."""
    return spark.read.parquet(path).filter((F.col("shard") == hash_[:2]) & (F.col(hash_col) == hash_)).drop("shard")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def registries(config: str) -> list[dict]:
    """A federation's registries in order of priority, from JSON text; disabled ones are left out."""
    found = json.loads(config).get("registries", [])
    return sorted((r for r in found if r.get("enabled", True)), key=lambda r: r.get("priority", 100))
