"""Joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.operators import edge_types as et
from shardwell.operators.storage import resolve_requires
from shardwell.sources import corpus
from shardwell.sources.corpus import EDGES_SQL, FILES_SQL, NODES_SQL, REGISTRY_SQL, table


@query("join01_hits_with_metadata", f"WITH {REGISTRY_SQL} SELECT vec_id AS chunk_id, coalesce(name, 'Unknown') AS name, coalesce(description, 'No description') AS description FROM embeddings LEFT JOIN reg ON vec_id + 300 = doc_id")
def join01(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") + 300).alias("doc_id"))
    return hits.join(corpus.registry(spark, sf_dir), "doc_id", "left").select("chunk_id", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("description", F.lit("No description")).alias("description"))


@query("join02_score_merge", "SELECT coalesce(d.doc_id, e.vec_id) AS chunk_id, round(coalesce(0.3::DOUBLE * (d.n_chars % 10), 0) + coalesce(0.5::DOUBLE * label, 0), 6) AS score FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id")
def join02_all(spark, sf_dir):
    return merged_scores(spark, sf_dir, table(spark, sf_dir, "documents"))


def merged_scores(spark, sf_dir, documents):
    a = documents.select(F.col("doc_id").alias("chunk_id"), (0.3 * (F.col("n_chars") % 10)).alias("t"))
    b = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (0.5 * F.col("label")).alias("s"))
    return a.join(b, "chunk_id", "full").select("chunk_id", F.round(F.coalesce("t", F.lit(0.0)) + F.coalesce("s", F.lit(0.0)), 6).alias("score"))


@query(
    "join03_requirements",
    """WITH r AS (SELECT 'orders:' || o_orderkey AS src, o_orderpriority AS wanted FROM orders UNION ALL SELECT 'part:' || p_partkey, p_type FROM part),
    a AS (SELECT 'a:' || min(s_suppkey) AS owner, '1-URGENT' AS alias FROM supplier),
    s AS (SELECT p_type AS symbol, 'part:' || max(p_partkey) AS owner FROM part GROUP BY p_type)
    SELECT r.src, r.wanted, coalesce(a.owner, CASE WHEN s.owner <> r.src THEN s.owner END) AS dst FROM r LEFT JOIN a ON r.wanted = a.alias LEFT JOIN s ON r.wanted = s.symbol
    WHERE coalesce(a.owner, CASE WHEN s.owner <> r.src THEN s.owner END) IS NOT NULL""",
)
def join03(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    wants = o.select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("src"), F.col("o_orderpriority").alias("wanted"))
    wants = wants.unionByName(p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("src"), F.col("p_type").alias("wanted")))
    alias = table(spark, sf_dir, "supplier").agg(F.concat(F.lit("a:"), F.min("s_suppkey").cast("string")).alias("owner"), F.lit("1-URGENT").alias("alias"))
    symbol = p.groupBy(F.col("p_type").alias("symbol")).agg(F.concat(F.lit("part:"), F.max("p_partkey").cast("string")).alias("owner"))
    return resolve_requires(wants, alias, symbol)


@query("join04_resolve_imports", f"WITH {FILES_SQL}, i AS (SELECT page_id, unnest(imports) AS symbol FROM files) SELECT i.page_id, symbol, coalesce(CAST(p.page_id AS VARCHAR), 'unresolved') AS target FROM i LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p ON symbol = url")
def join04(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    index = f.groupBy(F.col("path").alias("symbol")).agg(F.min("page_id").cast("string").alias("target"))
    return f.select("page_id", F.explode("imports").alias("symbol")).join(index, "symbol", "left").select("page_id", "symbol", F.coalesce("target", F.lit("unresolved")).alias("target"))


@query("join05_members", "SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)")
def join05(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("needle"))
    return corpus.text_index(spark, sf_dir).find_all(items).select(F.col("id").alias("item_id"), F.col("key").alias("doc_id"))


@query("join07_ghosts", f"WITH {EDGES_SQL}, req AS (SELECT 'customer:' || c_custkey AS id FROM customer) SELECT DISTINCT dst AS ghost FROM edges JOIN req ON src = id WHERE dst NOT IN (SELECT id FROM req)")
def join07_all(spark, sf_dir):
    req = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    e = corpus.edges(spark, sf_dir).join(req, F.col("src") == F.col("id"))
    return e.select(F.col("dst").alias("ghost")).distinct().join(req, F.col("ghost") == F.col("id"), "left_anti")


@query("join08_explanation", f"WITH {EDGES_SQL} SELECT dst AS ghost, min(src) AS because FROM edges WHERE src LIKE 'customer:%' AND edge_type IN ('imports', 'type_ref') GROUP BY dst")
def join08(spark, sf_dir):
    e = et.of_type(corpus.edges(spark, sf_dir), ["imports", "type_ref"]).filter(F.startswith("src", F.lit("customer:")))
    w = Window.partitionBy("dst").orderBy("src")
    return e.withColumn("n", F.row_number().over(w)).filter("n = 1").select(F.col("dst").alias("ghost"), F.col("src").alias("because"))


@query("join09_compatible", "SELECT p_size AS t, 'provider' AS side, p_partkey AS id FROM part WHERE p_size IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'consumer', o_orderkey FROM orders WHERE o_custkey IN (SELECT p_size FROM part)")
def join09_all(spark, sf_dir):
    """All members of every type that has both sides; each provider fits each consumer of its type, and pairs are not listed."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("t"), F.lit("provider").alias("side"), F.col("p_partkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t"), F.lit("consumer").alias("side"), F.col("o_orderkey").alias("id"))
    have = lambda x: x.select("t").distinct()
    return p.join(have(o), "t", "left_semi").unionByName(o.join(have(p), "t", "left_semi"))


@query("join10_any_input", f"WITH {FILES_SQL} SELECT DISTINCT f.page_id AS consumer, p.page_id AS provider FROM files f, unnest(f.imports) AS u(i) JOIN (SELECT page_id, '/' || regexp_extract(url, '[^/]*$') AS out FROM pages) p ON i = p.out")
def join10(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    provides = f.select(F.col("page_id").alias("provider"), F.concat(F.lit("/"), F.regexp_extract("path", "[^/]*$", 0)).alias("i"))
    return f.select(F.col("page_id").alias("consumer"), F.explode(F.array_distinct("imports")).alias("i")).join(provides, "i").select("consumer", "provider").distinct()


@query("join12_equivalents", "SELECT doc_id, min(doc_id) OVER w AS class, count(*) OVER w AS n FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY sha256(text)) QUALIFY n > 1")
def join12_all(spark, sf_dir):
    """All documents whose text occurs again, with the smallest id of the text as class; equivalents are the others of the class."""
    h = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    classes = h.groupBy("h").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")).filter("n > 1")
    return h.join(classes, "h").select("doc_id", "class", "n")


@query("join14_plan_actions", "SELECT o_orderkey AS node, CASE WHEN l.k IS NULL THEN 'build' ELSE 'cached' END AS action FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') l ON o_orderkey = k")
def join14(spark, sf_dir):
    cached = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("node")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")).join(cached, "node", "left").select("node", F.when(F.col("hit"), "cached").otherwise("build").alias("action"))


@query("join15_publish_new", "WITH have AS (SELECT sha256(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT count(*) AS published, (SELECT count(*) FROM documents) - count(*) AS skipped FROM documents WHERE sha256(text) NOT IN (SELECT h FROM have)")
def join15(spark, sf_dir):
    """The remote has the chunks of the labelled documents; the others are published."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    have = h.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("h").distinct().withColumn("hit", F.lit(True))
    return h.join(have, "h", "left").agg(F.count_if(F.col("hit").isNull()).alias("published"), F.count_if(F.col("hit")).alias("skipped"))


@query("join16_referential", "SELECT l_orderkey AS target, 'missing part' AS problem FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey + 5 NOT IN (SELECT p_partkey FROM part)) UNION ALL SELECT doc_id, 'duplicate' FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1)")
def join16(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), (F.col("l_partkey") + 5).alias("p_partkey"))
    missing = li.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "left_anti").select("target").distinct().withColumn("problem", F.lit("missing part"))
    twice = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("target"), F.count("*").alias("n")).filter("n > 1")
    return missing.unionByName(twice.select("target", F.lit("duplicate").alias("problem")))


NEED = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in et.NEED.items()) + " END"


@query("join17_dependencies", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT src, count(*) AS deps, count(*) FILTER ({NEED} = 'high') AS high, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM edges LEFT JOIN nodes ON dst = node_id WHERE src LIKE 'part:%' GROUP BY src")
def join17(spark, sf_dir):
    e = corpus.edges(spark, sf_dir).filter(F.startswith("src", F.lit("part:"))).withColumn("need", et.looked_up(F.col("edge_type"), et.NEED))
    joined = e.join(corpus.nodes(spark, sf_dir).select(F.col("node_id").alias("dst"), "tokens"), "dst", "left")
    return joined.groupBy("src").agg(F.count("*").alias("deps"), F.count_if(F.col("need") == "high").alias("high"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))


@query("join18_drawing", f"WITH {NODES_SQL}, {EDGES_SQL}, v AS (SELECT node_id FROM nodes WHERE language = 'nation' ORDER BY node_id LIMIT 50) SELECT src, dst, n.alias FROM edges JOIN v ON src = v.node_id JOIN nodes n ON dst = n.node_id")
def join18(spark, sf_dir):
    n = corpus.nodes(spark, sf_dir)
    seen = n.filter("language = 'nation'").orderBy("node_id").limit(50).select(F.col("node_id").alias("src"))
    return corpus.edges(spark, sf_dir).join(F.broadcast(seen), "src").join(n.select(F.col("node_id").alias("dst"), "alias"), "dst").select("src", "dst", "alias")
