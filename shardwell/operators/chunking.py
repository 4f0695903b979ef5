"""Chunkers: files and lines to content-addressed pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwell.functions.text import chunk_id, lines


def by_file(docs: DataFrame, key: str, content: str) -> DataFrame:
    """One chunk a file, over lines [0, n)."""
    return docs.select(key, F.lit(0).alias("piece"), F.col(content).alias("content"), F.lit(0).alias("start_line"), F.size(lines(F.col(content))).alias("end_line"), chunk_id(F.col(content)).alias("chunk_id"))


def by_lines(docs: DataFrame, key: str, content: str, per_chunk: int = 100, clamp: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of a number of lines; the last one's end is clamped to the file, unless told otherwise."""
    rows = docs.select(key, *keep, lines(F.col(content)).alias("_lines")).filter(F.size("_lines") > 0)
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(per_chunk))).alias("piece", "start_line"))
    piece = F.array_join(F.slice("_lines", F.col("start_line") + 1, F.lit(per_chunk)), "\n")
    end = F.col("start_line") + per_chunk
    end = F.least(end, F.size("_lines")) if clamp else end
    return rows.select(key, *keep, "piece", piece.alias("content"), "start_line", end.alias("end_line")).withColumn("chunk_id", chunk_id(F.col("content")))


def fixed_size(docs: DataFrame, key: str, content: str, max_size: int = 2000) -> DataFrame:
    """Chunks of max_size / 80 lines, 10 at least; ends are not clamped."""
    return by_lines(docs, key, content, max(max_size // 80, 10), clamp=False)


def semantic(docs: DataFrame, key: str, content: str, boundary: Callable[[Column], Column], overlap: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that end where a definition begins; boundary is a predicate on a line. All within the row, without a shuffle.

    What follows the last boundary is not emitted, blank chunks are skipped, and a file without a boundary is one chunk.
    overlap lines before a chunk are prepended to its content after its id is taken.
    """
    rows = docs.select(key, *keep, F.col(content).alias("_content"), lines(F.col(content)).alias("_lines"))
    at = F.filter(F.transform("_lines", lambda x, i: F.when(boundary(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_cuts", at)
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.col("_cuts")), F.col("_cuts"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inner = F.filter(spans, lambda s: s["b"].isNotNull() & (s["b"] > s["a"]))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(None).cast("int").alias("b")))
    cut = rows.withColumn("s", F.explode(F.when(F.size("_cuts") == 0, whole).otherwise(inner)))
    alone, start = F.col("s.b").isNull(), F.greatest(F.col("s.a") - overlap, F.lit(0))
    body = F.when(alone, F.col("_content")).otherwise(F.array_join(F.slice("_lines", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")), "\n"))
    cut = cut.withColumn("_body", body).filter(alone | (F.trim("_body") != ""))
    lead = F.array_join(F.slice("_lines", start + 1, F.col("s.a") - start), "\n")
    shown = F.when(~alone & (F.col("s.a") > start), F.concat(lead, F.lit("\n"), F.col("_body"))).otherwise(F.col("_body"))
    return cut.select(key, *keep, shown.alias("content"), F.col("s.a").alias("start_line"), F.coalesce("s.b", F.size("_lines")).alias("end_line"), chunk_id(F.col("_body")).alias("chunk_id"), chunk_id(F.col("_content")).alias("_whole"))


def hierarchical(docs: DataFrame, key: str, content: str, boundary: Callable[[Column], Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """The file's own chunk, and the semantic ones with it as their parent."""
    text = F.col(content)
    parent = docs.select(key, *keep, text.alias("content"), F.lit(0).alias("start_line"), F.size(lines(text)).alias("end_line"), chunk_id(text).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"))
    return parent.unionByName(semantic(docs, key, content, boundary, keep=keep).withColumnRenamed("_whole", "parent_id"))
