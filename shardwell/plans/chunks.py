"""Chunking queries."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.operators import chunking
from shardwell.sources.corpus import table

LINES = "list_filter(list_transform(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)), lambda x: regexp_replace(x, '\\r$', '')), lambda x: true)"
DOCS = f"docs AS (SELECT doc_id, lang, text, CASE WHEN text = '' THEN [] ELSE {LINES} END AS ls FROM documents)"


def pieces(k: int, end: str) -> str:
    return f"""WITH {DOCS}, p AS (
      SELECT doc_id, lang, CAST(s // {k} AS INTEGER) AS piece, array_to_string(ls[s + 1 : s + {k}], chr(10)) AS content, CAST(s AS INTEGER) AS start_line, CAST({end} AS INTEGER) AS end_line
      FROM docs, unnest(range(0, len(ls), {k})) AS u(s))"""


@query(
    "flagship_chunk_summary",
    pieces(5, "least(s + 5, len(ls))")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY sha256(content) ORDER BY doc_id, piece) AS k FROM p)
    SELECT lang AS language, count(DISTINCT doc_id) AS files, count(*) AS chunks, count(*) FILTER (k = 1) AS first_seen, count(*) FILTER (k > 1) AS duplicates,
           CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(strlen(content) // 4) AS BIGINT) AS tokens FROM r GROUP BY lang""",
)
def flagship(spark, sf_dir):
    """A chunk is first seen in the language of its first place; ids of documents are unique, so files are first pieces."""
    p = chunking.by_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 5, keep=("lang",))
    size = F.octet_length("content").cast("long")
    sums = p.groupBy(F.col("lang").alias("language")).agg(F.count_if(F.col("piece") == 0).alias("files"), F.count("*").alias("chunks"), F.sum(size).alias("bytes"), F.sum(F.floor(size / 4)).cast("long").alias("tokens"))
    first = p.groupBy("chunk_id").agg(F.min_by("lang", F.struct("doc_id", "piece")).alias("language")).groupBy("language").agg(F.count("*").alias("first_seen"))
    out = sums.join(first, "language", "left").withColumn("first_seen", F.coalesce("first_seen", F.lit(0)))
    return out.select("language", "files", "chunks", "first_seen", (F.col("chunks") - F.col("first_seen")).alias("duplicates"), "bytes", "tokens")


@query("chk01_by_file", f"WITH {DOCS} SELECT doc_id, 0 AS piece, text AS content, 0 AS start_line, CAST(len(ls) AS INTEGER) AS end_line, 'chunk:sha256:' || sha256(text) AS chunk_id FROM docs")
def chk01(spark, sf_dir):
    return chunking.by_file(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("chk03_fixed_size", pieces(25, "s + 25") + " SELECT doc_id, piece, content, start_line, end_line, 'chunk:sha256:' || sha256(content) AS chunk_id FROM p")
def chk03(spark, sf_dir):
    return chunking.fixed_size(table(spark, sf_dir, "documents"), "doc_id", "text", 2000)


@query("chk05_by_lines", pieces(100, "least(s + 100, len(ls))") + " SELECT doc_id, piece, content, start_line, end_line, 'chunk:sha256:' || sha256(content) AS chunk_id FROM p")
def chk05(spark, sf_dir):
    return chunking.by_lines(table(spark, sf_dir, "documents"), "doc_id", "text", 100)
