"""Graph queries over foreign keys."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.operators import graph as g
from shardwell.operators.components import components
from shardwell.sources import corpus
from shardwell.sources.corpus import EDGES_SQL, NODES_SQL, table


def bfs(start: str, depth: int, a: str = "src", b: str = "dst", where: str = "true", edges: str = EDGES_SQL) -> str:
    return f"""WITH RECURSIVE {NODES_SQL}, {edges}, w AS (
      SELECT '{start}' AS node_id, 0 AS depth UNION SELECT e.{b}, w.depth + 1 FROM w JOIN edges e ON e.{a} = w.node_id WHERE w.depth < {depth} AND {where})
      SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE node_id IN (SELECT node_id FROM nodes) GROUP BY node_id"""


def whole(spark, sf_dir):
    return corpus.nodes(spark, sf_dir), corpus.edge_table(spark, sf_dir)


@query("grf01_dependencies", bfs("orders:0", 3))
def grf01_all(spark, sf_dir):
    return g.traverse(g.GraphQuery.dependencies("orders:0").with_limit(None), *whole(spark, sf_dir)).select("node_id", "depth")


@query("grf01_dependents", bfs("region:0", 3, "dst", "src"))
def grf01b_all(spark, sf_dir):
    return g.traverse(g.GraphQuery.dependents("region:0").with_limit(None), *whole(spark, sf_dir)).select("node_id", "depth")


@query("grf02_strong_typed", bfs("orders:5", 2, where="edge_type IN ('imports', 'type_ref', 'implements', 'extends')"))
def grf02(spark, sf_dir):
    return g.traverse(g.GraphQuery.dependencies("orders:5").strong_only().with_depth(2).with_limit(None), *whole(spark, sf_dir)).select("node_id", "depth")


@query(
    "grf03_paths",
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT 'orders:7' AS node, ['orders:7'] AS path UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM w JOIN edges e ON e.src = w.node WHERE len(w.path) <= 3)
    SELECT node, min(array_to_string(path, '>')) AS path, CAST(min(len(path)) - 1 AS INTEGER) AS depth FROM w GROUP BY node""",
)
def grf03(spark, sf_dir):
    return g.paths(whole(spark, sf_dir)[1], "orders:7", 3).select("node", F.array_join("path", ">").alias("path"), "depth")


def order_groups(spark, sf_dir):
    """Each customer's orders as a group of seeds."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("seed"), F.col("o_orderkey").alias("pos"))


@query("grf04_expansion")
def grf04_all(spark, sf_dir):
    return g.expand(order_groups(spark, sf_dir), corpus.nodes(spark, sf_dir), corpus.edge_table(spark, sf_dir))


@query("grf06_auto_expand", bfs("orders:3", 2, where="edge_type IN ('imports', 'type_ref', 'generic_ref', 'calls')"))
def grf06_all(spark, sf_dir):
    """'calls' too: an order reaches parts, and so 'generic_ref', by it alone."""
    q = g.GraphQuery.dependencies("orders:3").of("imports", "type_ref", "generic_ref", "calls").with_depth(2).with_limit(None)
    return g.traverse(q, *whole(spark, sf_dir)).select("node_id", "depth")


def chains(e):
    second = e.filter("edge_type = 'imports'").select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    two = e.select(F.col("src").alias("source"), F.col("dst").alias("mid")).join(second, "mid")
    return two.groupBy("source").agg(F.min(F.concat_ws(" -> ", "source", "mid", "end")).alias("chain"))


@query(
    "grf09_closure",
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT 'customer:' || c_custkey AS root, 'customer:' || c_custkey AS node FROM customer
      UNION SELECT w.root, e.dst FROM w JOIN edges e ON e.src = w.node) SELECT root, count(*) AS reached FROM w GROUP BY root""",
)
def grf09_all(spark, sf_dir):
    roots = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("root"))
    return g.closure(corpus.edge_table(spark, sf_dir), roots).groupBy("root").agg(F.count("*").alias("reached"))


@query("grf10_transitive", bfs("orders:11", 5).replace("SELECT node_id, CAST(min(depth) AS INTEGER) AS depth", "SELECT node_id, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS kind").replace("GROUP BY node_id", "GROUP BY node_id HAVING min(depth) > 0"))
def grf10(spark, sf_dir):
    t = g.traverse(g.GraphQuery.dependencies("orders:11").with_depth(5).with_limit(None), *whole(spark, sf_dir)).filter("depth > 0")
    return t.select("node_id", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind"))


@query("grf13_adjacency", f"WITH {EDGES_SQL} SELECT dst AS node, count(*) AS fan_in, min(src) AS first FROM edges GROUP BY dst")
def grf13_all(spark, sf_dir):
    return adjacency(whole(spark, sf_dir)[1])


def adjacency(e):
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"), F.min("src").alias("first"))


@query(
    "topk12_topological",
    f"""WITH {NODES_SQL} SELECT node_id AS node, CASE language WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'supplier' THEN 2
      WHEN 'part' THEN CASE WHEN node_id IN (SELECT 'part:' || l_partkey FROM lineitem) THEN 3 ELSE 0 END
      ELSE CASE WHEN node_id IN (SELECT 'orders:' || l_orderkey FROM lineitem) THEN 4 ELSE 3 END END AS level FROM nodes""",
)
def topk12(spark, sf_dir):
    nodes, edges = whole(spark, sf_dir)
    return g.topological(edges, nodes.select(F.col("node_id").alias("node")))


@query(
    "grf11_shortest_path",
    f"""WITH RECURSIVE {EDGES_SQL}, w AS (SELECT 'orders:9' AS node, ['orders:9'] AS path UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM w JOIN edges e ON e.src = w.node WHERE len(w.path) <= 6)
    SELECT node, min(array_to_string(path, '>')) AS path FROM w WHERE node LIKE 'region:%' GROUP BY node""",
)
def grf11(spark, sf_dir):
    """The smallest of the shortest paths to every region that is reached."""
    return g.paths(whole(spark, sf_dir)[1], "orders:9", 6).filter("node LIKE 'region:%'").select("node", F.array_join("path", ">").alias("path"))


HOP = "e{0}.edge_type || chr(2) || e{0}.dst"
CHAIN_SQL = " UNION ALL ".join(
    f"SELECT e1.src AS start, e{n}.dst AS target, " + " || chr(1) || ".join(HOP.format(k) for k in range(1, n + 1)) + " AS key, e1.src || ' -> ' || " + " || ' -> ' || ".join(f"e{k}.dst" for k in range(1, n + 1))
    + " AS chain FROM edges e1 " + " ".join(f"JOIN edges e{k} ON e{k - 1}.dst = e{k}.src" for k in range(2, n + 1)) + f" WHERE e{n}.edge_type IN ('imports', 'type_ref')"
    for n in (1, 2, 3)
)


@query("grf08_chain", f"WITH {EDGES_SQL} SELECT start, target, min_by(chain, key) AS chain FROM ({CHAIN_SQL}) WHERE start LIKE 'orders:%' GROUP BY start, target")
def grf08(spark, sf_dir):
    """From every order to whatever three hops reach: its customer, and nations by its customer or by its parts."""
    nodes, edges = whole(spark, sf_dir)
    return g.chains(edges, nodes.filter("language = 'orders'").select(F.col("node_id").alias("start")))


@query(
    "grf14_scaffold_imports",
    """WITH d AS (SELECT c_custkey AS grp, ['typescript', 'python', 'rust', 'cobol'][c_custkey % 4 + 1] AS language, 'nation:' || n_nationkey AS id, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT c_custkey, ['typescript', 'python', 'rust', 'cobol'][c_custkey % 4 + 1], 'region:' || r_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT CAST(grp AS BIGINT) AS grp, language, string_agg(CASE language WHEN 'typescript' THEN 'import { ' || name || ' } from ''./chunks/' || id || ''';' || chr(10)
      WHEN 'python' THEN 'from .chunks.' || id || ' import ' || name || chr(10) WHEN 'rust' THEN 'use chunks::' || id || '::' || name || ';' || chr(10) END, '' ORDER BY id) AS code FROM d GROUP BY grp, language""",
)
def grf14(spark, sf_dir):
    """The imports of each customer, in its own language; of a language without imports there are none."""
    nodes, edges = whole(spark, sf_dir)
    key = F.col("c_custkey").cast("long")
    language = F.element_at(F.array(*map(F.lit, ["typescript", "python", "rust", "cobol"])), (key % 4 + 1).cast("int"))
    groups = table(spark, sf_dir, "customer").select(key.alias("grp"), language.alias("language"), F.concat(F.lit("customer:"), key.cast("string")).alias("seed"))
    return g.scaffold_imports(groups, nodes, edges)


RINGS = 100_000


@query(
    "join11_components",
    f"""WITH {EDGES_SQL}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges UNION SELECT 'orders:' || o_orderkey FROM orders),
    c AS (SELECT node, CASE WHEN node LIKE 'orders:%' THEN 'ring ' || substr(node, 8)::BIGINT // {RINGS} ELSE node END AS label FROM n)
    SELECT node, min(node) OVER w AS component, count(*) OVER w AS size FROM c WINDOW w AS (PARTITION BY label)""",
)
def join11_components(spark, sf_dir):
    """The whole graph, and rings of 100,000 orders each: each order leads to the next one of its ring, the last to the first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    ends = o.groupBy(F.floor(F.col("k") / RINGS).alias("ring")).agg(F.min("k").alias("first"), F.max("k").alias("last"))
    ring = o.withColumn("ring", F.floor(F.col("k") / RINGS)).join(ends, "ring").select("k", F.when(F.col("k") < F.col("last"), F.col("k") + 1).otherwise(F.col("first")).alias("next"))
    name = lambda c: F.concat(F.lit("orders:"), F.col(c).cast("string"))
    edges = corpus.edge_table(spark, sf_dir).select("src", "dst").unionByName(ring.select(name("k").alias("src"), name("next").alias("dst")))
    return components(edges, o.select(name("k").alias("node")))


@query(
    "grf09_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT 'n' || user_id AS src, unnest(['n' || (event_id % 50), 'n' || ((event_id * 7) % 400)]) AS dst FROM events WHERE event_id % 3 <> 0),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT dst AS root, dst AS node FROM e UNION SELECT w.root, e.dst FROM w JOIN e ON e.src = w.node),
    m AS (SELECT a.root AS node, min(a.node) AS component FROM w a JOIN w b ON a.root = b.node AND a.node = b.root GROUP BY a.root),
    c AS (SELECT node, coalesce(component, node) AS component FROM n LEFT JOIN m USING (node)) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""",
)
def grf09_components(spark, sf_dir):
    """Cycles among the users of the event log."""
    e = table(spark, sf_dir, "events").filter("event_id % 3 <> 0")
    to = F.explode(F.array(F.concat(F.lit("n"), (F.col("event_id") % 50).cast("string")), F.concat(F.lit("n"), (F.col("event_id") * 7 % 400).cast("string"))))
    return components(e.select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("src"), to.alias("dst")))
