"""Text, vector and hybrid search over the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwell.functions.text import cosine
from shardwell.operators.gram_index import GramIndex


def weigh(name: Column, description: Column, concepts: Column, language: Column, quality: Column, coverage: Column) -> Column:
    """The weights of the fields that mention a query (concepts: how many do), raised by quality and coverage; 1 at most."""
    s = F.when(name, 0.4).otherwise(0.0) + F.when(description, 0.3).otherwise(0.0) + 0.2 * concepts + F.when(language, 0.1).otherwise(0.0)
    return F.least(s * (0.5 + 0.5 * quality) * (0.8 + 0.2 * coverage), F.lit(1.0))


def text_hits(index: GramIndex, query: str, marks: DataFrame, concepts: bool = True) -> DataFrame:
    """doc_id, score of the chunks that mention the query, found by the index. marks: doc_id, quality, coverage."""
    hits = index.find(query, ("name", "description", "language", *(("concept",) if concepts else ())))
    has = lambda field: F.max(F.col("field") == field)
    flags = hits.groupBy(F.col("key").alias("doc_id")).agg(has("name").alias("n"), has("description").alias("d"), has("language").alias("l"), F.count_if(F.col("field") == "concept").alias("c"))
    known = flags.join(marks, "doc_id", "left").fillna(0.0, ["quality", "coverage"])
    return known.select("doc_id", weigh(F.col("n"), F.col("d"), F.col("c"), F.col("l"), F.col("quality"), F.col("coverage")).alias("score"))


def registry_hits(index: GramIndex, query: str) -> DataFrame:
    """doc_id, score: 1 if name and description mention the query, 0.7 if one does."""
    hits = index.find(query, ("name", "description")).groupBy(F.col("key").alias("doc_id")).agg(F.count_distinct("field").alias("n"))
    return hits.select("doc_id", F.when(F.col("n") == 2, 1.0).otherwise(0.7).alias("score"))


def top(rows: DataFrame, score: str, k: int, tie: str = "doc_id") -> DataFrame:
    return rows.filter(F.col(score) > 0).orderBy(F.desc(score), tie).limit(k)


def nearest(vectors: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score of the k most similar vectors; all are scored."""
    return vectors.filter(F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), query), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid(text: DataFrame, semantic: DataFrame, registry: DataFrame, k: int, min_score: float = 0.0) -> DataFrame:
    """0.3 text + 0.5 cosine + 0.2 (quality and coverage, half each); a chunk may come from either side."""
    both = text.select("doc_id", F.col("score").alias("t")).join(semantic.select("doc_id", F.col("score").alias("s")), "doc_id", "full")
    both = both.join(registry.select("doc_id", "quality", "coverage"), "doc_id", "left")
    value = 0.3 * F.coalesce("t", F.lit(0.0)) + 0.5 * F.coalesce("s", F.lit(0.0)) + 0.2 * (0.5 * F.coalesce("quality", F.lit(0.0)) + 0.5 * F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0)))
    return both.select("doc_id", F.round(value, 6).alias("score")).filter(F.col("score") >= min_score).orderBy(F.desc("score"), "doc_id").limit(k)


def federated(hits: DataFrame, key: str, priority: str) -> DataFrame:
    """Of hits of one key the one from the registry that comes first."""
    w = Window.partitionBy(key).orderBy(priority)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
