"""Unions, distinct and differences."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.operators import search
from shardwell.sources import corpus
from shardwell.sources.corpus import EDGES_SQL, table


@query("set01_both_directions", f"WITH {EDGES_SQL} SELECT 'nation:4' AS node, dst AS other FROM edges WHERE src = 'nation:4' UNION SELECT 'nation:4', src FROM edges WHERE dst = 'nation:4'")
def set01(spark, sf_dir):
    e = corpus.edges(spark, sf_dir)
    out = e.filter("src = 'nation:4'").select(F.col("src").alias("node"), F.col("dst").alias("other"))
    return out.unionByName(e.filter("dst = 'nation:4'").select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


@query("set02_chunks_and_compositions", "SELECT 'chunk' AS kind, doc_id AS id, lang FROM documents UNION ALL SELECT 'composition', item_id, NULL FROM benchmark")
def set02(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("composition").alias("kind"), F.col("item_id").alias("id")), allowMissingColumns=True)


@query("set04_federated_search", "SELECT sha256(text) AS id, source, doc_id FROM documents WHERE contains(lower(text), 'the') QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY CAST(substr(source, 4) AS INTEGER), doc_id) = 1")
def set04(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("the")))
    d = d.select(F.sha2("text", 256).alias("id"), "source", "doc_id").withColumn("p", F.struct(F.substring("source", 4, 9).cast("int"), "doc_id"))
    return search.federated(d, "id", "p").drop("p")


@query("set05_federated_fetch", "SELECT sha256(text) AS id, min(CAST(substr(source, 4) AS INTEGER)) AS registry FROM documents GROUP BY 1")
def set05(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("id")).agg(F.min(F.substring("source", 4, 9).cast("int")).alias("registry"))


@query("set06_references", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ' ') AS refs FROM pages")
def set06(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("page_id", F.array_join(F.array_sort(F.array_distinct("imports")), " ").alias("refs"))


@query("set07_concepts", "SELECT source, array_to_string(list_sort(list_distinct(list(lang))), ',') AS concepts FROM documents GROUP BY source")
def set07(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("concepts"))


@query("jdiff_ghosts", "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def ghosts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("part")).distinct().join(li.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("part")), "part", "left_anti")
