"""Further queries, by the same rules."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions import code
from shardwell.functions import text as t
from shardwell.operators import edge_types as et
from shardwell.operators import graph as g
from shardwell.operators.importer import ImportStore
from shardwell.plans.graph import order_groups
from shardwell.sources import corpus
from shardwell.sources.corpus import EDGES_SQL, FILES_SQL, NODES_SQL, REGISTRY_SQL, table
from shardwell.sources.shared import new_folder


def case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in values.items()) + " END"


@query("src30_embedding_store", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings")
def src30(spark, sf_dir):
    sq = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.round(sq, 6).alias("norm2"))


@query("src35_save_names", "SELECT doc_id, substr(sha256(text), 1, 16) || '.json' AS file FROM documents")
def src35(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(F.sha2("text", 256), 1, 16), F.lit(".json")).alias("file"))


@query("src36_first_five", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def src36(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(5).select("doc_id", "lang")


@query("src39_fetch_tier", "SELECT o_orderkey AS node FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def src39(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("node"))


@query("fil07_assembly_priority", f"WITH {EDGES_SQL} SELECT edge_type, {case('edge_type', et.ASSEMBLY)} AS priority, count(*) AS n FROM edges GROUP BY 1, 2")
def fil07(spark, sf_dir):
    return corpus.edges(spark, sf_dir).groupBy("edge_type", et.looked_up(F.col("edge_type"), et.ASSEMBLY).alias("priority")).agg(F.count("*").alias("n"))


@query("fil08_need", f"WITH {EDGES_SQL} SELECT {case('edge_type', et.NEED)} AS need, count(*) AS n FROM edges GROUP BY 1")
def fil08(spark, sf_dir):
    return corpus.edges(spark, sf_dir).groupBy(et.looked_up(F.col("edge_type"), et.NEED).alias("need")).agg(F.count("*").alias("n"))


@query("fil09_follow_all", f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def fil09(spark, sf_dir):
    return et.of_type(corpus.edges(spark, sf_dir), None).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("fil10_filtered_traversal", f"WITH {EDGES_SQL} SELECT src AS node_id, 1 AS depth FROM edges WHERE dst = 'nation:3' AND src LIKE 'supplier:%'")
def fil10(spark, sf_dir):
    q = g.GraphQuery.dependents("nation:3").filtered("language", "supplier").with_limit(10**6).with_depth(2)
    return g.traverse(q, corpus.nodes(spark, sf_dir), corpus.edge_table(spark, sf_dir)).filter("depth > 0").select("node_id", "depth")


@query("fil11_at_depth", f"WITH {EDGES_SQL} SELECT DISTINCT b.src AS node_id FROM edges a JOIN edges b ON b.dst = a.src WHERE a.dst = 'region:1'")
def fil11(spark, sf_dir):
    q = g.GraphQuery.dependents("region:1").with_depth(2).with_limit(10**6)
    return g.traverse(q, corpus.nodes(spark, sf_dir), corpus.edge_table(spark, sf_dir)).filter("depth = 2").select("node_id")


@query("fil16_interface_name", "SELECT p_partkey, p_name FROM part WHERE p_name = 'small ring'")
def fil16(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("interface", F.struct(F.col("p_name").alias("name")))
    return p.filter(F.col("interface.name") == "small ring").select("p_partkey", "p_name")


@query("fil19_alias_exact", f"WITH {NODES_SQL} SELECT node_id FROM nodes WHERE alias = 'NATION_7'")
def fil19(spark, sf_dir):
    return corpus.nodes(spark, sf_dir).filter("alias = 'NATION_7'").select("node_id")


@query("ui01_browser_filter", f"WITH {NODES_SQL} SELECT node_id FROM nodes WHERE language = 'part' AND (contains(lower(alias), 'ring') OR contains(lower(node_id), '77'))")
def ui01(spark, sf_dir):
    n = corpus.nodes(spark, sf_dir).filter("language = 'part'")
    return n.filter(t.mentions(F.col("alias"), "ring") | t.mentions(F.col("node_id"), "77")).select("node_id")


@query("ui04_category", "SELECT p_partkey FROM part WHERE list_contains([p_type, p_brand], 'ECONOMY')")
def ui04(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.array_contains(F.array("p_type", "p_brand"), "ECONOMY")).select("p_partkey")


@query("join06_shared_utilities", f"WITH {FILES_SQL}, i AS (SELECT replace(x, '/', '') AS stem, count(*) AS n FROM files, unnest(imports) AS u(x) GROUP BY 1 HAVING count(*) >= 3) SELECT page_id, path FROM files WHERE regexp_extract(path, '([^/.]+)([.][^/]*)?$', 1) IN (SELECT stem FROM i)")
def join06(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    often = f.select(F.explode("imports").alias("x")).groupBy(F.replace("x", F.lit("/"), F.lit("")).alias("stem")).agg(F.count("*").alias("n")).filter("n >= 3")
    return f.withColumn("stem", F.regexp_extract("path", r"([^/.]+)([.][^/]*)?$", 1)).join(often, "stem", "left_semi").select("page_id", "path")


@query("topk05_vector_topk", "SELECT vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 0), 6) AS score FROM embeddings WHERE label = 2 ORDER BY score DESC, vec_id LIMIT 5")
def topk05(spark, sf_dir):
    from shardwell.operators.search import nearest

    e = table(spark, sf_dir, "embeddings")
    return nearest(e.filter("label = 2").crossJoin(F.broadcast(e.filter("vec_id = 7").select(F.col("embedding").alias("q")))), F.col("q"), 5)


@query("grf05_policies")
def grf05(spark, sf_dir):
    """Each customer's orders as a group, over the complete graph."""
    groups, nodes, edges = order_groups(spark, sf_dir), corpus.nodes(spark, sf_dir), corpus.edge_table(spark, sf_dir)
    out = None
    for name, policy in (("default", g.Policy()), ("conservative", g.CONSERVATIVE), ("aggressive", g.AGGRESSIVE)):
        part = g.expand(groups, nodes, edges, policy).select("grp", F.lit(name).alias("policy"), F.size("included").alias("n"), "tokens", "depth", "truncated")
        out = part if out is None else out.unionByName(part)
    return out


@query("grf12_direct", f"WITH {EDGES_SQL} SELECT dst, edge_type, 1.0::DOUBLE AS confidence FROM edges WHERE src = 'orders:42'")
def grf12(spark, sf_dir):
    return corpus.edges(spark, sf_dir).filter("src = 'orders:42'").select("dst", "edge_type", F.lit(1.0).alias("confidence"))


@query("chk07_scrape_rows", "SELECT doc_id, 'titled:' || trim(split_part(text, chr(10), 1)) AS concept, sha256(text) AS id, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def chk07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("titled:"), F.trim(F.split("text", "\n")[0])).alias("concept"), F.sha2("text", 256).alias("id"), F.octet_length("text").cast("long").alias("size"))



@query("scal12_mock_embedding", "SELECT doc_id, array_to_string(list_transform([strlen(text), strlen(text) * 2, strlen(text) / 2.0, 0, 1], lambda x: CAST(round(x * 2) AS BIGINT)), ',') AS vector FROM documents")
def scal12(spark, sf_dir):
    n = F.octet_length("text").cast("double")
    v = F.array(n, n * 2, n / 2, F.lit(0.0), F.lit(1.0))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(v, lambda x: F.round(x * 2).cast("long").cast("string")), ",").alias("vector"))


@query("scal26_description", "SELECT doc_id, list_first(list_filter(string_split(text, chr(10))[2:], lambda x: trim(x) <> '' AND NOT starts_with(x, '#'))) AS description FROM documents")
def scal26(spark, sf_dir):
    rest = F.split("text", "\n")
    good = F.filter(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(good, 0).alias("description"))


@query("scal41_link_map", f"WITH {FILES_SQL}, i AS (SELECT f.page_id, x, min(p.page_id) AS target FROM files f, unnest(f.imports) AS u(x) JOIN pages p ON x = p.url GROUP BY 1, 2) SELECT page_id, string_agg(x || '=link:' || target, ',' ORDER BY x) AS links FROM i GROUP BY page_id")
def scal41(spark, sf_dir):
    f = corpus.files(spark, sf_dir)
    index = f.groupBy(F.col("path").alias("x")).agg(F.min("page_id").alias("target"))
    i = f.select("page_id", F.explode(F.array_distinct("imports")).alias("x")).join(index, "x")
    entry = F.concat("x", F.lit("=link:"), F.col("target").cast("string"))
    return i.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("links"))


@query("scal51_transform_inputs", "SELECT l_orderkey AS step, string_agg('pending:' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS inputs FROM lineitem GROUP BY 1")
def scal51_all(spark, sf_dir):
    return pending_inputs(table(spark, sf_dir, "lineitem"))


def pending_inputs(li):
    inputs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("pending:"), x["l_partkey"].cast("string")))
    return li.groupBy(F.col("l_orderkey").alias("step")).agg(F.array_join(inputs, ",").alias("inputs"))


@query("udf09_import_dedup", "SELECT CASE WHEN n = 1 THEN 'node' ELSE 'EQUIVALENT_TO' END AS made, count(*) AS rows FROM (SELECT row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) GROUP BY 1")
def udf09(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").withColumn("n", F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")))
    return d.groupBy(F.when(F.col("n") == 1, "node").otherwise("EQUIVALENT_TO").alias("made")).agg(F.count("*").alias("rows"))


@query(
    "udf09_import_batches",
    "SELECT CASE WHEN doc_id = first THEN 'node' ELSE 'EQUIVALENT_TO' END AS made, 'docs:' || doc_id AS id, 'docs:' || first AS node FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)",
)
def udf09_batches(spark, sf_dir):
    """Three batches one after another give what one over all would."""
    store = ImportStore(spark, new_folder(spark, "import"), buckets=4)
    d = table(spark, sf_dir, "documents")
    last = d.agg(F.max("doc_id")).first()[0]
    rows = d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("docs:"), F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("hash"))
    for k in range(3):
        store.put(rows.filter(F.floor(F.col("seq") * 3 / (last + 1)) == k), f"batch {k}")
    nodes = store.table("nodes").select(F.lit("node").alias("made"), "id", F.col("id").alias("node"))
    return nodes.unionByName(store.table("edges").select(F.col("edge_type").alias("made"), F.col("src").alias("id"), F.col("dst").alias("node")))


@query("reg01_coverage", f"WITH {REGISTRY_SQL} SELECT language, count(*) FILTER (quality > 0) AS rated, round(avg(coverage), 6) AS coverage FROM reg GROUP BY language")
def reg01(spark, sf_dir):
    return corpus.registry(spark, sf_dir).groupBy("language").agg(F.count_if(F.col("quality") > 0).alias("rated"), F.round(F.avg("coverage"), 6).alias("coverage"))
