"""Predicates, lookups and edge filters."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions.text import mentions
from shardwell.operators import edge_types as et
from shardwell.sources import corpus
from shardwell.sources.corpus import EDGES_SQL, NODES_SQL, REGISTRY_SQL, table


@query("fil01_get_node", f"WITH {NODES_SQL} SELECT * FROM nodes WHERE node_id IN ('nation:3', 'part:10', 'missing:1')")
def fil01(spark, sf_dir):
    return corpus.nodes(spark, sf_dir).filter(F.col("node_id").isin("nation:3", "part:10", "missing:1"))


@query("fil02_token_estimate", f"WITH {NODES_SQL} SELECT w.id AS node_id, coalesce(tokens, 0) AS tokens FROM (VALUES ('customer:3'), ('part:7'), ('missing:1')) w(id) LEFT JOIN nodes ON w.id = node_id")
def fil02(spark, sf_dir):
    wanted = spark.createDataFrame([("customer:3",), ("part:7",), ("missing:1",)], "node_id string")
    return F.broadcast(wanted).join(corpus.nodes(spark, sf_dir), "node_id", "left").select("node_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


@query("fil03_neighbours", f"WITH {EDGES_SQL} SELECT 'out' AS way, dst AS other, edge_type FROM edges WHERE src = 'customer:5' UNION ALL SELECT 'in', src, edge_type FROM edges WHERE dst = 'customer:5'")
def fil03(spark, sf_dir):
    e = corpus.edges(spark, sf_dir)
    out = e.filter("src = 'customer:5'").select(F.lit("out").alias("way"), F.col("dst").alias("other"), "edge_type")
    return out.unionByName(e.filter("dst = 'customer:5'").select(F.lit("in").alias("way"), F.col("src").alias("other"), "edge_type"))


@query("fil04_edges_of_type", f"WITH {EDGES_SQL} SELECT * FROM edges WHERE edge_type = 'imports'")
def fil04(spark, sf_dir):
    return et.of_type(corpus.edges(spark, sf_dir), ["imports"])


KIND = "CASE WHEN edge_type IN ('imports', 'type_ref', 'implements', 'extends') THEN 'strong' WHEN edge_type IN ('calls', 'doc_ref', 'tests', 'macro_use') THEN 'weak' ELSE 'neither' END"


@query("fil05_strength", f"WITH {EDGES_SQL} SELECT edge_type, {KIND} AS strength, count(*) AS n FROM edges GROUP BY 1, 2")
def fil05(spark, sf_dir):
    e = corpus.edges(spark, sf_dir)
    return e.groupBy("edge_type", et.strength(F.col("edge_type")).alias("strength")).agg(F.count("*").alias("n"))


@query("fil06_auto_expand", f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n FROM edges WHERE edge_type IN ('imports', 'type_ref', 'generic_ref') GROUP BY 1")
def fil06(spark, sf_dir):
    return et.of_type(corpus.edges(spark, sf_dir), et.AUTO_EXPAND).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("fil12_hybrid_post_filter", f"WITH {REGISTRY_SQL} SELECT doc_id, quality FROM reg WHERE quality >= 0.5 AND language = 'en'")
def fil12(spark, sf_dir):
    return corpus.registry(spark, sf_dir).filter("quality >= 0.5 AND language = 'en'").select("doc_id", "quality")


@query("fil13_list_chunks", f"WITH {REGISTRY_SQL} SELECT CAST(doc_id AS VARCHAR) || ':' || name AS chunk_id, CAST(strlen(description) AS BIGINT) AS size FROM reg WHERE contains(CAST(doc_id AS VARCHAR), '42') OR contains(name, 'the')")
def fil13(spark, sf_dir):
    """Case counts here, so that the index (which folds it) proposes and the name decides."""
    index = corpus.registry_index(spark, sf_dir)
    keys = index.find("42", ("id",)).select("key").unionByName(index.find("the", ("name",)).select("key")).distinct()
    own = index.texts().join(keys, "key").groupBy("key").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("id", "name", "description")))
    hit = own.filter(F.contains("id", F.lit("42")) | F.contains("name", F.lit("the")))
    return hit.select(F.concat_ws(":", "id", "name").alias("chunk_id"), F.octet_length("description").cast("long").alias("size"))


@query("fil14_paged_search", "SELECT sha256(text) AS id, count(*) OVER () AS total FROM documents WHERE contains(sha256(text), 'ab') ORDER BY id, doc_id LIMIT 10 OFFSET 5")
def fil14(spark, sf_dir):
    index = corpus.registry_index(spark, sf_dir)
    hits = index.find("ab", ("hash",))
    d = hits.join(index.texts().filter("field = 'hash'"), ["key", "field", "part"]).select(F.col("key").alias("doc_id"), F.col("value").alias("id"))
    total = hits.agg(F.count("*").alias("total"))
    return d.orderBy("id", "doc_id").offset(5).limit(10).crossJoin(F.broadcast(total)).select("id", "total")


@query("fil15_with_embedding", "SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id WHERE embedding IS NOT NULL")
def fil15(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id")


@query("fil17_composable", f"WITH {REGISTRY_SQL} SELECT doc_id, quality FROM reg WHERE contains(lower(description), 'the') ORDER BY quality DESC, doc_id LIMIT 20")
def fil17(spark, sf_dir):
    return corpus.registry(spark, sf_dir).filter(mentions(F.col("description"), "the")).orderBy(F.desc("quality"), "doc_id").limit(20).select("doc_id", "quality")


@query("fil18_find_symbol", "SELECT p_name AS symbol, max(p_partkey) AS owner FROM part GROUP BY p_name")
def fil18(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_name").alias("symbol")).agg(F.max_by("p_partkey", "p_partkey").alias("owner"))


@query("fil20_resolve_alias", "SELECT regexp_extract(url, '[^/]*$') AS alias, url, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY alias ORDER BY url, page_id) = 1")
def fil20(spark, sf_dir):
    """Every alias (the last part of a path), and the first url that ends with it."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "[^/]*$", 0).alias("alias"), F.struct("url", "page_id").alias("p"))
    return p.groupBy("alias").agg(F.min("p").alias("p")).select("alias", "p.url", "p.page_id")


@query("fil24_alias_search", f"WITH {NODES_SQL} SELECT node_id, alias FROM nodes WHERE contains(lower(alias), 'ring') OR contains(lower(node_id), 'nation:1')")
def fil24(spark, sf_dir):
    return corpus.nodes(spark, sf_dir).filter(mentions(F.col("alias"), "ring") | mentions(F.col("node_id"), "nation:1")).select("node_id", "alias")


@query("fil26_alias_available", "SELECT DISTINCT p_type AS alias FROM part WHERE p_type NOT IN (SELECT p_brand FROM part) AND p_type <> 'ECONOMY'")
def fil26(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    used = p.select(F.col("p_brand").alias("alias")).unionByName(spark.createDataFrame([("ECONOMY",)], "alias string"))
    return p.select(F.col("p_type").alias("alias")).distinct().join(used, "alias", "left_anti")


@query("ui03_any_tag", "SELECT page_id FROM pages WHERE len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: contains(lower(x), 'the'))) > 0")
def ui03(spark, sf_dir):
    return corpus.files(spark, sf_dir).filter(F.exists("imports", lambda x: F.contains(F.lower(x), F.lit("the")))).select("page_id")


@query("ui02_page", "SELECT page_id, url, CAST(ceil((SELECT count(*) FROM pages) / 10.0) AS BIGINT) AS pages FROM pages ORDER BY page_id LIMIT 10 OFFSET 20")
def ui02(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    total = p.agg(F.ceil(F.count("*") / 10).alias("pages"))
    return p.orderBy("page_id").offset(20).limit(10).crossJoin(F.broadcast(total))


@query("ui05_row_mapping", "SELECT page_id, list_last(string_split(url, '/')) AS name, CASE WHEN ends_with(url, '.html') THEN 'html' ELSE 'unknown' END AS language FROM pages")
def ui05(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("name"), F.when(F.endswith("url", F.lit(".html")), "html").otherwise("unknown").alias("language"))
