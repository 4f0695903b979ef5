"""Store operations as DataFrame transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwell.functions.text import verify


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns), F.lit(False))


def scan(files: DataFrame, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that match no exclude pattern and, if there are include patterns, one of those."""
    out = files.filter(~any_match(F.col(path), exclude or []))
    return out.filter(any_match(F.col(path), include)) if include else out


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: one aggregation, no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def append_edges(edges: DataFrame, more: DataFrame, tasks: int | None = None) -> DataFrame:
    """Both without what repeats; tasks: over how many tasks it is found."""
    key = ["src", "dst", "edge_type"]
    rows = edges.unionByName(more)
    return (rows.repartition(tasks, *key) if tasks else rows).dropDuplicates(key)


def put(rows: DataFrame, id_col: str, content: str, max_bytes: int) -> DataFrame:
    """success, error of storing each row: its id must be its content's, then its size must be allowed."""
    error = F.when(~verify(F.col(content), F.col(id_col)), "hash mismatch").when(F.octet_length(content) > max_bytes, "too large")
    return rows.withColumn("error", error).withColumn("success", F.col("error").isNull())


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of changes replace those of rows where they are not null."""
    new = [c for c in changes.columns if c != key]
    joined = rows.join(changes.select(key, *(F.col(c).alias(f"_n_{c}") for c in new)), key, "left")
    return joined.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in new else F.col(c) for c in rows.columns))


def read_through(rows: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Stored embeddings, and length-based stand-ins where there are none."""
    n = F.octet_length(text).cast("float")
    made = F.array(n, n * 2, n / 2, F.lit(0.0), F.lit(1.0)).cast("array<float>")
    out = rows.join(known.withColumn("cached", F.lit(True)), key, "left")
    return out.withColumns({"embedding": F.coalesce("embedding", made), "cached": F.coalesce("cached", F.lit(False))})


def expired(cache: DataFrame, days: int) -> DataFrame:
    """Entries older than so many days at the time of the newest one."""
    now = cache.agg(F.max("modified").alias("_now"))
    return cache.crossJoin(F.broadcast(now)).filter(F.col("_now") - F.col("modified") > F.expr(f"INTERVAL {days} DAYS")).drop("_now")  # one row


def resolve_requires(requires: DataFrame, aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, wanted, dst of each requirement: an alias, or else a symbol; a symbol of the chunk itself does not count."""
    a = requires.join(aliases.select(F.col("alias").alias("wanted"), F.col("owner").alias("_a")), "wanted", "left")
    b = a.join(symbols.select(F.col("symbol").alias("wanted"), F.col("owner").alias("_s")), "wanted", "left")
    found = F.coalesce("_a", F.when(F.col("_s") != F.col("src"), F.col("_s")))
    return b.select("src", "wanted", found.alias("dst")).filter("dst IS NOT NULL")


def running_within(rows: DataFrame, group: list[str], order: list, size: Column, most: int) -> DataFrame:
    """The rows of each group before the first one that would take the running sum over the limit."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_size", size).withColumn("_sum", F.sum("_size").over(w))
    return out.withColumn("_over", F.max((F.col("_sum") > most).cast("int")).over(w)).filter("_over = 0").drop("_size", "_over").withColumnRenamed("_sum", "running")


def relate(edges: DataFrame) -> DataFrame:
    """Edges as a graph database keeps them, sure of each."""
    return edges.select("src", "dst", F.col("edge_type").alias("relation"), F.lit(1.0).alias("confidence"))
