"""Grouped summaries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.sources import corpus
from shardwell.sources.corpus import EDGES_SQL, FILES_SQL, NODES_SQL, table


@query("agg01_language_counts", "SELECT lang, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang")
def agg01(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("agg03_modules", f"WITH {FILES_SQL} SELECT parent, count(*) AS files, CAST(sum(len(imports)) AS BIGINT) AS exports, bool_or(ends_with(path, '.html')) AS entry FROM files GROUP BY parent")
def agg03(spark, sf_dir):
    return corpus.files(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("files"), F.sum(F.size("imports")).alias("exports"), F.bool_or(F.endswith("path", F.lit(".html"))).alias("entry"))


@query("agg04_import_frequency", f"WITH {FILES_SQL} SELECT i AS import, count(*) AS n FROM files, unnest(imports) AS u(i) GROUP BY i HAVING count(*) >= 3")
def agg04(spark, sf_dir):
    return corpus.files(spark, sf_dir).select(F.explode("imports").alias("import")).groupBy("import").agg(F.count("*").alias("n")).filter("n >= 3")


@query("agg05_category_counts", "SELECT p_type AS category, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY p_type")
def agg05(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("agg06_compositions", f"WITH {FILES_SQL}, m AS (SELECT parent AS name, count(*) AS members FROM files GROUP BY parent HAVING count(*) >= 2) SELECT * FROM m UNION ALL SELECT 'test-suite', count(*) FROM files WHERE contains(path, 'ads') HAVING count(*) >= 2")
def agg06(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    m = f.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("members")).filter("members >= 2")
    tests = f.filter(F.contains("path", F.lit("ads"))).agg(F.lit("test-suite").alias("name"), F.count("*").alias("members")).filter("members >= 2")
    return m.unionByName(tests)


@query("agg07_composition_id", "SELECT source, sha256(string_agg('chunk:sha256:' || sha256(text), '' ORDER BY doc_id)) AS id, CAST(sum(strlen(text)) AS BIGINT) AS size, count(*) AS members FROM documents GROUP BY source HAVING count(*) >= 2")
def agg07(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "chunk_id"))), lambda x: x["chunk_id"]), "")
    return c.groupBy("source").agg(F.sha2(ids, 256).alias("id"), F.sum("size").alias("size"), F.count("*").alias("members")).filter("members >= 2")


@query("agg08_dedup_index", "SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS prior, first_value(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)")
def agg08(spark, sf_dir):
    w = Window.partitionBy("h").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.select("doc_id", (F.row_number().over(w) - 1).alias("prior"), F.first("doc_id").over(w).alias("first"))


@query("agg09_store_stats", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT alias) FROM nodes) AS symbols, count(DISTINCT src) AS sources, count(*) AS edges FROM edges")
def agg09(spark, sf_dir):
    n = corpus.nodes(spark, sf_dir).agg(F.count("*").alias("nodes"), F.count_distinct("alias").alias("symbols"))
    e = corpus.edges(spark, sf_dir).agg(F.count_distinct("src").alias("sources"), F.count("*").alias("edges"))
    return n.crossJoin(e)  # one row each


@query("agg10_cache_stats", "SELECT event_type AS kind, count(*) AS entries, round(sum(value), 2) AS bytes, round(max(value), 2) AS largest FROM events GROUP BY event_type")
def agg10(spark, sf_dir):
    return corpus.cache(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("entries"), F.round(F.sum("size"), 2).alias("bytes"), F.round(F.max("size"), 2).alias("largest"))


@query("agg11_tokens", f"WITH {NODES_SQL} SELECT language, CAST(sum(tokens) AS BIGINT) AS tokens FROM nodes GROUP BY language")
def agg11(spark, sf_dir):
    return corpus.nodes(spark, sf_dir).groupBy("language").agg(F.sum("tokens").alias("tokens"))


@query(
    "agg12_policy",
    f"""WITH {NODES_SQL}, {EDGES_SQL}, d AS (SELECT node_id, language, tokens, (SELECT count(*) FROM edges WHERE src = node_id) AS deps FROM nodes)
    SELECT language, CASE WHEN avg(deps) < 2 AND sum(tokens) < 1000 THEN 'conservative' WHEN avg(deps) > 5 OR sum(tokens) > 5000 THEN 'wide' ELSE 'default' END AS policy FROM d GROUP BY language""",
)
def agg12(spark, sf_dir):
    deps = corpus.edges(spark, sf_dir).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deps"))
    n = corpus.nodes(spark, sf_dir).join(deps, "node_id", "left").fillna(0, ["deps"])
    return n.groupBy("language").agg(F.avg("deps").alias("a"), F.sum("tokens").alias("t")).select("language", F.when((F.col("a") < 2) & (F.col("t") < 1000), "conservative").when((F.col("a") > 5) | (F.col("t") > 5000), "wide").otherwise("default").alias("policy"))


@query("agg13_publish_counts", "SELECT source, count(*) FILTER (strlen(text) <= 5000) AS published, count(*) FILTER (strlen(text) > 5000) AS failed, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def agg13(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    return c.groupBy("source").agg(F.count_if(F.col("size") <= 5000).alias("published"), F.count_if(F.col("size") > 5000).alias("failed"), F.sum("size").alias("bytes"))


@query("agg14_scrape_totals", "SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages")
def agg14(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).alias("bytes"))


@query("agg15_hit_rate", "SELECT count(*) AS total, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS share FROM events")
def agg15(spark, sf_dir):
    return corpus.cache(spark, sf_dir).agg(F.count("*").alias("total"), F.round(F.count_if(F.col("kind") == "view") / F.count("*"), 6).alias("share"))
