"""Walks of project trees, project types, manifests and suggestions, on paths made of the parts."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions import code, text
from shardwell.operators import builds, projects
from shardwell.operators import graph as g
from shardwell.plans.build import RESOLVED_SQL, components, found
from shardwell.plans.sourcecode import ATOMS
from shardwell.sources.code_files import code_files, values
from shardwell.sources.corpus import table

#: path and size, by the part's key modulo their number
PATHS = [
    ("src/a{k}.rs", 100), ("node_modules/x/b{k}.js", 100), (".git/c{k}.rs", 100), ("lib/d{k}.min.js", 100), ("app/e{k}.lock", 100), ("app/f{k}.toml", 100), ("build/g{k}.py", 100), ("docs/h{k}.md", 100), ("x/.hidden/i{k}.py", 100),
    ("big/j{k}.json", 11 << 20), ("k{k}.exe", 100), ("pkg/l{k}.pyi", 100), ("go/m{k}.go", 100), ("go/m{k}.mod", 100), ("t/n{k}.txt", 100), ("deep/target/o{k}.rs", 100), ("x{k}/dist", 100), ("y{k}/.DS_Store", 100),
]


def paths(spark, sf_dir):
    shape, key = (F.col("p_partkey") % len(PATHS) + 1).cast("int"), F.col("p_partkey").cast("string")
    path = F.replace(F.element_at(F.array(*(F.lit(p) for p, _ in PATHS)), shape), F.lit("{k}"), key)
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.element_at(F.array(*(F.lit(n) for _, n in PATHS)), shape).alias("size"))


def listed(shapes: list[int]) -> str:
    return values([(k, PATHS[k][0]) for k in shapes], "path").replace("% 14 = shape", f"% {len(PATHS)} = shape")


@query("src02_scan_patterns", listed([0, 2, 7, 15]))
def src02(spark, sf_dir):
    return projects.scan(paths(spark, sf_dir), "path", include=["*.rs", "docs/**"]).select("p_partkey", "path")


@query("src03_default_excludes", listed([k for k in range(len(PATHS)) if k not in (16, 17)]))
def src03(spark, sf_dir):
    return projects.scan(paths(spark, sf_dir), "path").select("p_partkey", "path")


@query("src07_project_walk", listed([0, 5, 7, 11, 12]))
def src07(spark, sf_dir):
    return paths(spark, sf_dir).filter(projects.walked(F.col("path"), F.col("size"))).select("p_partkey", "path")


LEGACY = {"rust": [0, 5], "python": [11], "go": [12, 13], "unknown": [7, 9, 14], "typescript": [3, 9], "javascript": [3, 9]}


@query("src08_legacy_walk", " UNION ALL ".join(f"SELECT '{t}' AS project, * FROM ({listed(s)})" for t, s in LEGACY.items()))
def src08(spark, sf_dir):
    p = paths(spark, sf_dir)
    kinds = F.array_compact(F.array(*[F.when(projects.legacy_walked(F.col("path"), t), t) for t in projects.LEGACY_EXTENSIONS]))
    return p.select(F.explode(kinds).alias("project"), "p_partkey", "path")


@query("src10_encoding", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'utf-8' END AS encoding FROM documents")
def src10(spark, sf_dir):
    """Every fourth text gets a byte that no UTF-8 has."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 4 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return d.select("doc_id", F.when(F.is_valid_utf8(raw.cast("string")), "utf-8").otherwise("unknown").alias("encoding"))


LANGUAGES = ["rust", "typescript", "javascript", "cpp", "c"]
MARKERS = ["Cargo.toml", "tsconfig.json", "package.json", "setup.py", "go.mod", "Makefile", "pom.xml", "README.md", "README.md"]


@query(
    "agg02_project_type",
    f"""WITH n AS (SELECT p_size AS project, {LANGUAGES}[p_partkey % 5 + 1] AS lang, count(*) AS n FROM part WHERE p_size % 9 <> 7 OR p_partkey % 5 < 2 GROUP BY ALL),
      w AS (SELECT project, {MARKERS}[project % 9 + 1] AS m, coalesce(max(n) FILTER (lang = 'typescript'), 0) AS ts, coalesce(max(n) FILTER (lang = 'javascript'), 0) AS js, coalesce(max(n) FILTER (lang = 'cpp'), 0) AS cpp, coalesce(max(n) FILTER (lang = 'c'), 0) AS c, count(*) AS kinds, min(lang) FILTER (n = top) AS common
        FROM (SELECT *, max(n) OVER (PARTITION BY project) AS top FROM n) GROUP BY project)
    SELECT project, CASE m WHEN 'Cargo.toml' THEN 'Rust' WHEN 'tsconfig.json' THEN 'TypeScript' WHEN 'package.json' THEN CASE WHEN ts > js THEN 'TypeScript' ELSE 'JavaScript' END WHEN 'setup.py' THEN 'Python' WHEN 'go.mod' THEN 'Go'
        WHEN 'Makefile' THEN CASE WHEN cpp > c THEN 'Cpp' ELSE 'C' END WHEN 'pom.xml' THEN 'Java' ELSE CASE WHEN kinds > 2 THEN 'Mixed' ELSE 'Unknown' END END AS type,
      CASE m WHEN 'Cargo.toml' THEN 'rust' WHEN 'tsconfig.json' THEN 'typescript' WHEN 'package.json' THEN CASE WHEN ts > js THEN 'typescript' ELSE 'javascript' END WHEN 'setup.py' THEN 'python' WHEN 'go.mod' THEN 'go'
        WHEN 'Makefile' THEN CASE WHEN cpp > c THEN 'cpp' ELSE 'c' END WHEN 'pom.xml' THEN 'java' ELSE common END AS language FROM w""",
)
def agg02(spark, sf_dir):
    """Projects of a size, with parts as files; those of one remainder have two languages only."""
    p = table(spark, sf_dir, "part").filter("p_size % 9 <> 7 OR p_partkey % 5 < 2")
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    n = p.groupBy(F.col("p_size").alias("project"), lang.alias("lang")).agg(F.count("*").alias("n"))
    counts = n.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts"))  # languages at most
    marker = F.array(F.element_at(F.array(*map(F.lit, MARKERS)), (F.col("project") % 9 + 1).cast("int")))
    return counts.select("project", projects.project_type(marker, F.col("counts")).alias("t")).select("project", "t.*")


@query("fil23_kinds", values([(s, n, k in ("struct", "class"), k in ("import", "header"), k in ("function", "async_function")) for s, n, k, _, _ in ATOMS], "name, is_type, is_dependency, is_executable"))
def fil23(spark, sf_dir):
    a = code_files(spark, sf_dir).select("p_partkey", F.explode(code.any_atoms("language", "content")).alias("a"))
    k = F.col("a.kind")
    return a.select("p_partkey", "a.name", k.isin("struct", "class", "trait", "interface", "enum", "type_alias").alias("is_type"), k.isin("import", "header").alias("is_dependency"), k.isin("function", "async_function", "method").alias("is_executable"))


@query("join11_mutual", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey // 3 = b.p_partkey // 3 AND a.p_partkey <> b.p_partkey WHERE a.p_partkey // 3 IN (SELECT p_partkey // 3 FROM part GROUP BY 1 HAVING count(*) = 3)")
def join11(spark, sf_dir):
    """Parts point to the next of three, the last to the first: a ring where all three are there."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    to = F.when(F.col("k") % 3 == 2, F.col("k") - 2).otherwise(F.col("k") + 1)
    edges = p.select(F.col("k").alias("src"), to.alias("dst")).join(p.withColumnRenamed("k", "dst"), "dst", "left_semi").select("src", "dst")
    return g.mutual(edges, p.select(F.col("k").alias("root")))


@query("chk24_manifest_dependencies", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'npm:a' || p_partkey || '@^1.0,npm:b@*' ELSE 'crates:name,crates:serde' END AS dependencies FROM part")
def chk24(spark, sf_dir):
    p, even = table(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 0
    content = F.when(even, F.format_string('{"main": "x", "dependencies": {"a%d": "^1.0", "b": "*"}}', "p_partkey")).otherwise(F.format_string('[package]\nname = "p%d"\n# c = 1\n[dependencies]\nserde = "1"\n', "p_partkey"))
    name = F.when(even, "package.json").otherwise("Cargo.toml")
    return p.select("p_partkey", F.array_join(F.array_sort(projects.dependencies(name, content)), ",").alias("dependencies"))


@query("topk10_suggest", "SELECT 'chunk:sha256:' || p_partkey || ['', '_todo', '_react', '_todo_react_rust'][p_partkey % 4 + 1] AS name, [0, 10, 10, 25][p_partkey % 4 + 1] AS score FROM part WHERE score > 0 ORDER BY score DESC, name LIMIT 5")
def topk10(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, ["", "_todo", "_React", "_todo_react_rust"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("chunk_sha256_"), F.col("p_partkey").cast("string"), ends, F.lit(".chunk")).alias("file"))
    return projects.suggestions(names, "file", "a TODO list in React", "rust")


@query("topk11_best_per_component", f"WITH {RESOLVED_SQL} SELECT CAST(spec AS BIGINT) AS spec, id, chunk, error FROM res WHERE kind = 'search'")
def topk11(spark, sf_dir):
    return builds.resolved(components(spark, sf_dir), found(spark, sf_dir)).filter("kind = 'search'").select("spec", "id", "chunk", "error")


@query(
    "scal46_human_sizes",
    """SELECT doc_id, k, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024) ELSE printf('%d B', n) END AS size
       FROM (SELECT doc_id, k, strlen(text) * k AS n FROM documents, unnest([1, 700, 700000]) AS u(k))""",
)
def scal46(spark, sf_dir):
    """Sizes of the texts, and of 700 and 700,000 times as much."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"), F.explode(F.array(F.lit(1), F.lit(700), F.lit(700_000))).alias("k"))
    return d.select("doc_id", "k", text.human_bytes(F.col("n") * F.col("k")).alias("size"))


@query("scal04_lenient_verify", "SELECT doc_id, doc_id % 3 AS given, doc_id % 3 < 2 AS ok FROM documents")
def scal04(spark, sf_dir):
    """Given are the first sixteen digits, more than the hash, or other ones."""
    h, k = F.sha2("text", 256), F.col("doc_id") % 3
    given = F.when(k == 0, F.substring(h, 1, 16)).when(k == 1, F.concat(h, F.lit("00"))).otherwise(F.reverse(h))
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("given"), text.lenient_verify(h, given).alias("ok"))
