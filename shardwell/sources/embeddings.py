"""The embedding store: vectors by chunk, kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "chunk_id string, embedding array<float>"


def save(store: DataFrame, path: str) -> None:
    store.select("chunk_id", "embedding").write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def get(store: DataFrame, chunk_id: str) -> list[float] | None:
    found = store.filter(store["chunk_id"] == chunk_id).first()
    return list(found["embedding"]) if found else None


def insert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the new vectors in place of those of the same chunks."""
    return store.join(new.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "embedding").unionByName(new.select("chunk_id", "embedding"))
