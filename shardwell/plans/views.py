"""Budgeted views: turns of conversations and nodes of the graph as atoms."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.operators import views
from shardwell.operators.views import ViewConfig
from shardwell.sources import corpus
from shardwell.sources.code_files import CODE_FILES_SQL, code_files, values
from shardwell.sources.corpus import NODES_SQL, table

ROLES = {"system": "type", "user": "import", "assistant": "function"}


def atoms(spark, sf_dir):
    c, key = table(spark, sf_dir, "conversations"), F.concat_ws(":", F.lit("chunk"), "conv_id", "turn")
    kind = F.coalesce(*[F.when(F.col("role") == k, v) for k, v in ROLES.items()], F.lit("other"))
    language = F.when(F.col("conv_id") % 2 == 1, "python").otherwise("rust")
    alias = F.when(F.col("turn") % 3 != 0, F.concat_ws("/", "conv_id", "turn"))
    return c.select(F.col("conv_id").alias("view"), F.col("turn").alias("pos"), key.alias("chunk_id"), alias.alias("alias"), kind.alias("granularity"), language.alias("language"), F.col("text").alias("content"), F.array("role").alias("symbols"))


def lines_in(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 WHEN ends_with({c}, chr(10)) THEN len(string_split({c}, chr(10))) - 1 ELSE len(string_split({c}, chr(10))) END"


def assembled(atoms_sql: str, budget: int, order: str, text: str = "content") -> str:
    """SQL: table f of fragments of the table a (view, pos, r, label, mark, content, symbol)."""
    return f"""{atoms_sql}, s AS (SELECT *, strlen(content) // 4 AS tk, sum(strlen(content) // 4) OVER (PARTITION BY view ORDER BY {order}) AS running FROM a),
      o AS (SELECT *, max(CASE WHEN running > {budget} THEN 1 ELSE 0 END) OVER (PARTITION BY view ORDER BY {order}) AS over_ FROM s),
      k AS (SELECT *, {text} AS shown, row_number() OVER (PARTITION BY view ORDER BY {order}) - 1 AS place FROM o WHERE over_ = 0),
      m AS (SELECT *, CASE WHEN place > 0 THEN mark || ' --- ' || label || ' ---' || chr(10) ELSE '' END AS sep, {lines_in("shown")} AS n FROM k),
      f AS (SELECT *, CAST(coalesce(sum(n + 1 + CASE WHEN place > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY view ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN place > 0 THEN 2 ELSE 1 END AS INTEGER) AS start_line FROM m)"""


WHOLE = """, t AS (SELECT view, string_agg(sep || shown || CASE WHEN ends_with(shown, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY place) AS text, count(*) AS n_atoms, CAST(sum(tk) AS BIGINT) AS tokens FROM f GROUP BY view),
  y AS (SELECT view, string_agg(symbol || '=' || line, ',' ORDER BY symbol) AS symbols FROM (SELECT view, symbol, max(start_line) AS line FROM f GROUP BY view, symbol) GROUP BY view)"""
TURNS = """a AS (SELECT conv_id AS view, turn AS pos, CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 WHEN 'assistant' THEN 4 ELSE 10 END AS r, coalesce(CASE WHEN turn % 3 <> 0 THEN conv_id || '/' || turn END, 'chunk:' || conv_id || ':' || turn) AS label,
  CASE WHEN conv_id % 2 = 1 THEN '#' ELSE '//' END AS mark, text AS content, role AS symbol FROM conversations)"""


def symbols():
    return F.array_join(F.array_sort(F.transform(F.map_entries("symbols"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias("symbols")


@query("view01_assemble", f"WITH {assembled(TURNS, 400, 'r, pos')}{WHOLE} SELECT view, text, n_atoms, tokens, tokens >= 400 AS truncated, CASE WHEN view % 2 = 1 THEN 'python' ELSE 'rust' END AS language, symbols FROM t JOIN y USING (view)")
def view01(spark, sf_dir):
    return views.assemble(atoms(spark, sf_dir), ViewConfig(max_tokens=400)).select("view", "text", "n_atoms", "tokens", "truncated", "language", symbols())


@query("topk06_assembly_order", "WITH " + assembled(TURNS, 400, "r, pos") + " SELECT view, pos, CAST(place AS INTEGER) AS place, CAST(tk AS BIGINT) AS tokens, CAST(running AS BIGINT) AS running, start_line, CAST(start_line + n - 1 AS INTEGER) AS end_line FROM f")
def topk06(spark, sf_dir):
    return views.fragments(atoms(spark, sf_dir), ViewConfig(max_tokens=400)).select("view", "pos", "place", "tokens", "running", "start_line", "end_line")


CUSTOMERS = f"""{NODES_SQL}, g AS (SELECT c_nationkey AS view, 'customer:' || c_custkey AS node, 0 AS depth FROM customer UNION SELECT c_nationkey, 'nation:' || c_nationkey, 1 FROM customer),
  a AS (SELECT view, row_number() OVER (PARTITION BY view ORDER BY depth, node) AS pos, 10 AS r, alias AS label, '//' AS mark, alias AS content, alias AS symbol FROM g JOIN nodes ON node = node_id)"""


def by_nation(spark, sf_dir, config):
    """The customers of each nation, and what views follow from them: the nation, not its region (an 'extends')."""
    n = corpus.nodes(spark, sf_dir)
    n = n.select(F.col("node_id").alias("chunk_id"), "alias", "granularity" if "granularity" in n.columns else F.lit("row").alias("granularity"), "language", F.col("alias").alias("content"), F.array("alias").alias("symbols"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("view"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    return views.view(asked, n, corpus.edge_table(spark, sf_dir), config).select("view", "text", "n_atoms", "tokens", "truncated")


@query("view02_expanded", f"WITH {assembled(CUSTOMERS, 4000, 'r, pos')}{WHOLE} SELECT CAST(view AS BIGINT) AS view, text, n_atoms, tokens, tokens >= 4000 AS truncated FROM t")
def view02(spark, sf_dir):
    return by_nation(spark, sf_dir, ViewConfig(expansion_depth=2))


@query("view05_context", f"WITH {assembled(CUSTOMERS, 6, 'pos')}{WHOLE} SELECT CAST(view AS BIGINT) AS view, text, n_atoms, tokens, tokens >= 6 AS truncated FROM t")
def view05(spark, sf_dir):
    return by_nation(spark, sf_dir, ViewConfig(max_tokens=6, sort_by_type=False, expansion_depth=1))


def source_atoms(spark, sf_dir):
    key = F.col("p_partkey")
    return code_files(spark, sf_dir).select(key.alias("view"), F.lit(0).alias("pos"), "path", F.col("path").alias("chunk_id"), F.col("path").alias("alias"), F.lit("module").alias("granularity"), "language", "content", F.array(F.lit("x")).alias("symbols"))


SIGNED = [
    (0, "pub async fn p{k}(x: i32) -> i32;\nfn main();\nstruct S{k} { a: u8 }\n"), (1, "export function f{k}();\n"), (2, "    def _m(self): ...\n\nasync def g{k}(): ...\n"), (10, "fn one{k}();\n"),
    (11, "fn b{k}();\npub struct A{k} {\n" + "  x: u8,\n" * 28 + "}\n"), (12, "def a{k}(): ...\n\ndef b{k}(): ...\n"),
]


@query("view03_signatures", f"WITH {CODE_FILES_SQL}, v AS ({values(SIGNED, 'signed')}) SELECT p_partkey AS view, coalesce(signed, content) || chr(10) AS text FROM code_files LEFT JOIN v USING (p_partkey)")
def view03(spark, sf_dir):
    return views.assemble(source_atoms(spark, sf_dir), ViewConfig(format="signatures")).select("view", "text")


@query("view03_for_symbol", "SELECT DISTINCT 'about ' || p_name AS view, max('part:' || p_partkey) OVER (PARTITION BY p_name) AS node FROM part")
def view03_symbol(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.array("p_name").alias("symbols"))
    wanted = p.select(F.concat(F.lit("about "), "p_name").alias("view"), F.col("p_name").alias("symbol")).distinct()
    return views.of_symbols(wanted, nodes)


MINIMAL = "array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '//') AND NOT starts_with(trim(x), '#')), lambda x: x || chr(10)), '')"


@query("view04_formats", f"WITH {CODE_FILES_SQL} SELECT p_partkey AS view, {MINIMAL} AS minimal, content AS json FROM code_files")
def view04(spark, sf_dir):
    a = source_atoms(spark, sf_dir)
    made = {f: views.formatted(F.col("content"), F.col("language"), f) for f in ("minimal", "json")}
    return a.select("view", *(c.alias(f) for f, c in made.items()))


@query("scal44_separator", "SELECT conv_id, turn, '// --- ' || conv_id || ':' || turn || ' ---' AS separator FROM conversations")
def scal44(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("// --- %d:%d ---", "conv_id", "turn").alias("separator"))
