"""Tables of the engine's data model, read from the given Parquet tables (the role mapping of FIXTURES.md)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.functions.text import chunk_id, lines, token_estimate
from shardwell.operators.gram_index import GramIndex, index_of
from shardwell.sources.shared import signature, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where each becomes a text that is worked on.
SPREAD = 5_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt evenly over tasks, as many as they need: a few bytes of a table become much work, so the table's files
    say nothing of it (a file of one row group is one task, whatever its rows)."""
    return rows.repartition(max(1, -(-rows.count() // SPREAD)), key)


#: Rows of a task that finds distinct ones.
DISTINCT = 100_000


def distinct_in_parts(rows: DataFrame, n: int) -> DataFrame:
    """The distinct ones of n rows, in tasks whose number grows with n, so that the memory of each does not."""
    return rows.repartition(max(1, -(-n // DISTINCT)), *rows.columns).distinct()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk_id, content, language, source, size, tokens."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chunk_id(F.col("text")).alias("chunk_id"), F.col("text").alias("content"), F.col("lang").alias("language"), "source", F.octet_length("text").cast("long").alias("size"), token_estimate(F.col("text")).alias("tokens"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name (first line), description (second line), language, quality, coverage."""
    d = table(spark, sf_dir, "documents")
    first = lines(F.col("text"))
    rows = d.select("doc_id", F.coalesce(F.get(first, 0), F.lit("")).alias("name"), F.coalesce(F.get(first, 1), F.lit("")).alias("description"), F.col("lang").alias("language"))
    return rows.join(marks(spark, sf_dir), "doc_id", "left").fillna(0.0, ["quality", "coverage"])


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, quality, coverage of the documents that have labels."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), (1.0 - F.col("toxic")).alias("coverage"))


def registry_index(spark: SparkSession, sf_dir: str) -> GramIndex:
    """The registry's searchable fields: id, hash, name, description, language, and concepts (language and source)."""
    d = table(spark, sf_dir, "documents")
    first = lines(F.col("text"))
    value = lambda field, part, c: F.struct(F.lit(field).alias("field"), F.lit(part).alias("part"), c.alias("value"))
    fields = [value("id", 0, F.col("doc_id").cast("string")), value("hash", 0, F.sha2("text", 256)), value("name", 0, F.coalesce(F.get(first, 0), F.lit(""))), value("description", 0, F.coalesce(F.get(first, 1), F.lit("")))]
    fields += [value("language", 0, F.col("lang")), value("concept", 0, F.col("lang")), value("concept", 1, F.col("source"))]
    return index_of(d, d.select(F.col("doc_id").alias("key"), F.explode(F.array(*fields)).alias("v")).select("key", "v.*"), fold=True)


def text_index(spark: SparkSession, sf_dir: str) -> GramIndex:
    """Whole texts of the documents, by grams of eight characters at every fourth place."""
    d = table(spark, sf_dir, "documents")
    return index_of(d, d.select(F.col("doc_id").alias("key"), F.lit("text").alias("field"), F.lit(0).alias("part"), F.col("text").alias("value")), q=8, step=4)


REGISTRY_SQL = """reg AS (
  SELECT d.doc_id, split_part(text, chr(10), 1) AS name, split_part(text, chr(10), 2) AS description, lang AS language,
         coalesce(CAST(quality AS DOUBLE), 0.0) AS quality, coalesce(1.0 - CAST(toxic AS DOUBLE), 0.0) AS coverage
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, alias, language (the table), granularity, size, tokens."""
    parts = []
    for name, key, alias in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderpriority")):
        parts.append(table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("node_id"), F.col(alias).alias("alias"), F.lit(name).alias("language")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumns({"size": F.octet_length("alias").cast("long"), "tokens": token_estimate(F.col("alias"))})


NODES_SQL = """nodes AS (
  SELECT node_id, alias, language, CAST(strlen(alias) AS BIGINT) AS size, CAST(strlen(alias) // 4 AS BIGINT) AS tokens FROM (
    SELECT 'region:' || r_regionkey AS node_id, r_name AS alias, 'region' AS language FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, p_name, 'part' FROM part
    UNION ALL SELECT 'orders:' || o_orderkey, o_orderpriority, 'orders' FROM orders))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, edge_type: foreign keys as typed edges."""

    def edge(name: str, a: str, ka: str, b: str, kb: str, kind: str, distinct: bool = False) -> DataFrame:
        pairs = table(spark, sf_dir, name).select(ka, kb)
        pairs = distinct_in_parts(pairs, pairs.count()) if distinct else pairs  # as keys, a fraction of their names
        return pairs.select(F.concat(F.lit(f"{a}:"), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(kb).cast("string")).alias("dst"), F.lit(kind).alias("edge_type"))

    parts = [
        edge("nation", "nation", "n_nationkey", "region", "n_regionkey", "extends"),
        edge("customer", "customer", "c_custkey", "nation", "c_nationkey", "imports"),
        edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "imports"),
        edge("orders", "orders", "o_orderkey", "customer", "o_custkey", "type_ref"),
    ]
    parts += [edge("lineitem", "orders", "l_orderkey", "part", "l_partkey", "calls", True), edge("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "generic_ref", True)]
    return reduce(DataFrame.unionByName, parts)


_WRITTEN: dict[tuple, DataFrame] = {}


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges written once, for what reads them again and again; anew only if files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, *(signature(table(spark, sf_dir, t)) for t in ("nation", "customer", "supplier", "orders", "lineitem")))
    if key not in _WRITTEN:
        _WRITTEN[key] = written(edges(spark, sf_dir), "edges")
    return _WRITTEN[key]


_FK_SQL = """SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'extends' AS edge_type FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'imports' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'imports' FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'type_ref' FROM orders"""
EDGES_SQL = f"""edges AS ({_FK_SQL}
  UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'generic_ref' FROM lineitem)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path, parent, imports (hrefs)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").alias("path"), F.regexp_extract("url", r"^(.*)/", 1).alias("parent"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("imports"))


FILES_SQL = """files AS (
  SELECT page_id, url AS path, regexp_extract(url, '^(.*)/', 1) AS parent, regexp_extract_all(html, 'href="([^"]*)"', 1) AS imports FROM pages)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, key, modified, size, kind, props: the event log as a cache index."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("key"), F.col("ts").alias("modified"), F.col("value").alias("size"), F.col("event_type").alias("kind"), "props")
