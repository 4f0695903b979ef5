"""Build specs, plans and trust: a customer is a spec, its orders are components, line items their signatures."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions.text import chunk_id, verify
from shardwell.operators import builds
from shardwell.operators.representations import steps
from shardwell.sources.corpus import table


@query("bld07_scaffold", "SELECT source, count(*) AS written FROM documents WHERE strlen(text) > 0 GROUP BY source")
def bld07(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0).groupBy("source").agg(F.count("*").alias("written"))


KINDS = {"F": "reuse", "O": "generate", "P": "search"}
# every seventh customer has no name, every tenth component waits for one that isn't there, some ids are given twice
COMPONENTS_SQL = """comp AS (SELECT o_custkey AS spec, 'c' || (o_orderkey - CASE WHEN o_custkey % 11 = 0 THEN o_orderkey % 2 ELSE 0 END) AS id,
    CASE o_orderstatus WHEN 'F' THEN 'reuse' WHEN 'O' THEN 'generate' ELSE 'search' END AS kind, 'chunk:' || o_orderkey AS source,
    CASE WHEN o_orderkey % 3 = 0 THEN 'small ring' ELSE 'no such part' END AS query,
    CASE WHEN o_custkey % 10 = 0 THEN 'c-' ELSE 'c' END || o_orderkey AS dep FROM orders)"""


def components(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    shift = F.when(F.col("o_custkey") % 11 == 0, key % 2).otherwise(0)
    kind = F.coalesce(*[F.when(F.col("o_orderstatus") == k, v) for k, v in KINDS.items()])
    waits = F.array(F.concat(F.when(F.col("o_custkey") % 10 == 0, "c-").otherwise("c"), key.cast("string")))
    return o.select(F.col("o_custkey").cast("long").alias("spec"), F.concat(F.lit("c"), (key - shift).cast("string")).alias("id"), kind.alias("kind"), F.concat(F.lit("chunk:"), key.cast("string")).alias("source"), F.when(key % 3 == 0, "small ring").otherwise("no such part").alias("query"), waits.alias("depends_on"))


def found(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_name").alias("query"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("chunk"), F.col("p_size").alias("score"))


RESOLVED_SQL = COMPONENTS_SQL + """, best AS (SELECT p_name AS query, max_by('part:' || p_partkey, (p_size, 'part:' || p_partkey)) AS best FROM part GROUP BY p_name),
    res AS (SELECT comp.*, CASE kind WHEN 'reuse' THEN source WHEN 'search' THEN best END AS chunk, CASE WHEN kind = 'search' AND best IS NULL THEN 'No results found for query: ' || query END AS error FROM comp LEFT JOIN best USING (query))"""


@query("bld01_manifest_nodes", f"WITH {RESOLVED_SQL} SELECT CAST(spec AS BIGINT) AS spec, id, chunk, CASE kind WHEN 'reuse' THEN 'prefer_source' WHEN 'search' THEN 'best_match' END AS strategy FROM res WHERE error IS NULL")
def bld01(spark, sf_dir):
    return builds.manifest_nodes(builds.resolved(components(spark, sf_dir), found(spark, sf_dir)))


@query("bld01_manifest_edges", f"WITH {COMPONENTS_SQL} SELECT CAST(spec AS BIGINT) AS spec, id AS src, dep AS dst, 'depends_on' AS relation FROM comp WHERE kind = 'generate'")
def bld01_edges(spark, sf_dir):
    return builds.manifest_edges(components(spark, sf_dir))


@query("bld02_plan_lists", f"WITH {RESOLVED_SQL}, g AS (SELECT spec, coalesce(string_agg(id || '=' || chunk, ',' ORDER BY id || '=' || chunk) FILTER (kind <> 'generate'), '') AS reuse, coalesce(string_agg(id, ',' ORDER BY id) FILTER (kind = 'generate'), '') AS generate, min(error) AS error FROM res GROUP BY spec) SELECT CAST(spec AS BIGINT) AS spec, CASE WHEN error IS NULL THEN reuse ELSE '' END AS reuse, CASE WHEN error IS NULL THEN generate ELSE '' END AS generate, error FROM g")
def bld02(spark, sf_dir):
    p = builds.plan(builds.resolved(components(spark, sf_dir), found(spark, sf_dir)))
    return p.select("spec", F.array_join("reuse", ",").alias("reuse"), F.array_join("generate", ",").alias("generate"), "error")


@query(
    "src41_spec_problems",
    f"""WITH {COMPONENTS_SQL}, ids AS (SELECT DISTINCT spec, id FROM comp), s AS (SELECT c_custkey AS spec, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name, c_custkey % 13 * 10 AS min_reuse FROM customer),
      twice AS (SELECT spec, min(id) AS twice FROM (SELECT spec, id FROM comp GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
      loose AS (SELECT spec, min((id, dep)) AS loose FROM comp c WHERE kind = 'generate' AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.spec = c.spec AND i.id = dep) GROUP BY 1)
    SELECT CAST(spec AS BIGINT) AS spec, CASE WHEN name = '' THEN 'Project name is required' WHEN twice IS NOT NULL THEN 'Duplicate component ID: ' || twice
      WHEN spec % 5 = 0 THEN 'Target ''app'' references undefined component ''none''' WHEN loose IS NOT NULL THEN 'Component ''' || loose[1] || ''' depends on undefined ''' || loose[2] || ''''
      WHEN min_reuse > 100 THEN 'min_reuse_percentage must be 0-100' END AS problem FROM s LEFT JOIN twice USING (spec) LEFT JOIN loose USING (spec)""",
)
def src41(spark, sf_dir):
    key = F.col("c_custkey").cast("long")
    c = table(spark, sf_dir, "customer")
    specs = c.select(key.alias("spec"), F.when(key % 7 == 0, "").otherwise(F.col("c_name")).alias("name"), (key % 13 * 10).alias("min_reuse"))
    targets = c.filter(key % 5 == 0).select(key.alias("spec"), F.lit("app").alias("target"), F.array(F.lit("none")).alias("components"))
    return builds.problems(specs, components(spark, sf_dir), targets)


@query(
    "bld03_execute",
    """WITH r AS (SELECT o_custkey AS plan, o_orderkey AS n, CASE WHEN o_orderstatus = 'F' THEN 'cached' WHEN o_totalprice > 300000 THEN 'failed' ELSE 'built' END AS result FROM orders),
      b AS (SELECT *, coalesce(max(CASE WHEN result = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT plan, n, result FROM b WHERE before = 0""",
)
def bld03(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("n"), "o_orderstatus", "o_totalprice")
    return builds.execute(steps, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000).select("plan", "n", "result")


@query(
    "bld04_trust",
    """WITH s AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS tested FROM lineitem GROUP BY 1),
      c AS (SELECT o_orderkey AS chunk, o_custkey % 3 AS target, coalesce(n, 0) AS n, coalesce(tested, 0) AS tested, o_orderpriority AS signer, date_diff('day', o_orderdate, TIMESTAMP '2001-01-01') AS age, o_orderkey % 9 <> 0 AS receipt FROM orders LEFT JOIN s ON o_orderkey = k)
    SELECT chunk, CASE WHEN n < CASE target WHEN 1 THEN 3 ELSE 2 END THEN 'too few signatures' WHEN NOT receipt THEN 'missing build receipt'
      WHEN target = 2 AND tested = 0 THEN 'missing attestation tested' WHEN target = 1 AND signer <> '1-URGENT' THEN 'missing required signer' WHEN age > 2000 THEN 'signature too old' END AS violation FROM c""",
)
def bld04(spark, sf_dir):
    """Defaults: two signatures, 2,000 days. Of three targets one wants three signatures and a signer, one an attestation."""
    kinds = "struct<minimum_signatures:int,attestation_types:array<string>,signers:array<string>,max_age_days:int>"
    set_ = lambda n, types, signers, age: F.struct(F.lit(n).alias("minimum_signatures"), F.array(*map(F.lit, types)).alias("attestation_types"), (F.array(*map(F.lit, signers)) if signers else F.lit(None)).alias("signers"), F.lit(age).alias("max_age_days")).cast(kinds)
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("tested"))
    o = table(spark, sf_dir, "orders").join(s, "o_orderkey", "left")
    age = F.datediff(F.lit("2001-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    receipt = F.when(F.col("o_orderkey") % 9 != 0, F.struct(F.when(F.col("tested") == 1, F.array(F.lit("tested"))).otherwise(F.array().cast("array<string>")).alias("attestations"), F.col("o_orderpriority").alias("signer"), age.alias("age_days")))
    target = F.col("o_custkey") % 3
    own = F.when(target == 1, set_(3, [], ["1-URGENT"], None)).when(target == 2, set_(None, ["tested"], None, None)).otherwise(set_(None, [], None, None))
    policy = builds.effective(own, set_(2, [], None, 2000))
    return o.select(F.col("o_orderkey").alias("chunk"), builds.violation(policy, F.coalesce("n", F.lit(0)), receipt).alias("violation"))


@query("bld06_verify_chunks", "SELECT doc_id, n_chars = length(text) AS size_ok, doc_id % 4 <> 0 AS hash_ok FROM documents")
def bld06(spark, sf_dir):
    """Every fourth chunk's content is not what its id was made of."""
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.select("doc_id", (F.col("n_chars") == F.length("text")).alias("size_ok"), verify(content, chunk_id(F.col("text"))).alias("hash_ok"))


@query(
    "scal50_ladder",
    """WITH n AS (SELECT o_orderkey AS k, 'orders:' || o_orderkey AS id, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN {'form': 'source', 'arch': NULL, 'chunk': 's' || o_orderkey} END,
        CASE WHEN o_orderkey % 3 = 0 THEN {'form': 'intermediate', 'arch': 'wasm', 'chunk': 'i' || o_orderkey} END, CASE WHEN o_orderkey % 5 < 2 THEN {'form': 'binary', 'arch': o_orderstatus, 'chunk': 'b' || o_orderkey} END,
        CASE WHEN o_orderkey % 7 = 0 THEN {'form': 'container', 'arch': 'F', 'chunk': 'c' || o_orderkey} END], lambda x: x IS NOT NULL) AS reps,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'intermediate' WHEN '2-HIGH' THEN 'binary' END AS preferred, CASE o_orderstatus WHEN 'F' THEN ['container', 'source'] WHEN 'O' THEN ['none', 'intermediate'] END AS prefer,
        CASE WHEN o_orderkey % 11 = 0 THEN 'x' || o_orderkey END AS source, CASE WHEN o_orderkey % 13 = 0 THEN 'y' || o_orderkey END AS ir, CASE WHEN o_orderkey % 2 = 1 THEN 'z' || o_orderkey END AS blob FROM orders),
      r AS (SELECT *, coalesce(list_filter(reps, lambda x: x.form = preferred)[1], list_filter(reps, lambda x: x.form = prefer[1])[1], list_filter(reps, lambda x: x.form = prefer[2])[1], list_filter(reps, lambda x: x.arch = 'F')[1], reps[1]) AS rep FROM n),
      d AS (SELECT l_orderkey AS k, string_agg('dependency pending:part:' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS pending FROM lineitem GROUP BY l_orderkey)
    SELECT id, rep.form AS form, CASE WHEN rep.form IN ('source', 'intermediate') THEN 'compile:F' WHEN rep.form IN ('binary', 'container') THEN 'custom:fetch' WHEN source IS NOT NULL OR ir IS NOT NULL THEN 'compile:F' ELSE 'bundle:default' END AS transform,
      concat_ws(',', 'main ' || coalesce(rep.chunk, source, ir, blob), pending) AS inputs FROM r LEFT JOIN d USING (k)""",
)
def scal50_ladder(spark, sf_dir):
    """Every order as a node with some of four representations and two kinds of preference; its parts are what it depends on."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    one = lambda when, form, arch, letter: F.when(when, F.struct(F.lit(form).alias("form"), arch.cast("string").alias("architecture"), F.concat(F.lit(letter), key).alias("chunk")))
    reps = F.filter(F.array(one(k % 2 == 0, "source", F.lit(None), "s"), one(k % 3 == 0, "intermediate", F.lit("wasm"), "i"), one(k % 5 < 2, "binary", F.col("o_orderstatus"), "b"), one(k % 7 == 0, "container", F.lit("F"), "c")), lambda x: x.isNotNull())
    preferred = F.when(F.col("o_orderpriority") == "1-URGENT", "ir").when(F.col("o_orderpriority") == "2-HIGH", "binary")
    prefer = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("container"), F.lit("source"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("none"), F.lit("embed")))
    loose = lambda when, letter: F.when(when, F.concat(F.lit(letter), key))
    nodes = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders:"), key).alias("id"), reps.alias("representations"), preferred.alias("preferred"), prefer.alias("prefer"), F.lit("F").alias("platform"), loose(k % 11 == 0, "x").alias("source"), loose(k % 13 == 0, "y").alias("ir"), loose(k % 2 == 1, "z").alias("blob"))
    deps = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("id"), F.struct("l_linenumber", "l_partkey").alias("pos"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dep"))
    out = steps(nodes, deps)
    return out.select("id", "form", "transform", F.array_join(F.transform("inputs", lambda x: F.concat_ws(" ", x["role"], x["chunk"])), ",").alias("inputs"))
