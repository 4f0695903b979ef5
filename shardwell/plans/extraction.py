"""Extraction from sources. The tables hold no code, so sources are made of their rows; tests hold the functions to literals."""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions import code
from shardwell.sources.corpus import spread, table


def rust(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    body = F.format_string("pub fn p%d(x: i32) -> i32 {\n  x + %d // %s\n}\n\nstruct S%d { a: u8 }\n", "p_partkey", "p_size", "p_name", "p_partkey")
    return p.select("p_partkey", body.alias("source"))


@query("chk14_rust_atoms", "SELECT p_partkey, 'p' || p_partkey AS name, 'function' AS kind, 1 AS start_line, 3 AS end_line FROM part UNION ALL SELECT p_partkey, 'S' || p_partkey, 'struct', 4, 5 FROM part")
def chk14(spark, sf_dir):
    a = rust(spark, sf_dir).select("p_partkey", F.explode(code.atom_column("rust")("source")).alias("a"))
    return a.select("p_partkey", "a.name", "a.kind", "a.start_line", "a.end_line")


def python_atoms(o):
    source = F.format_string("def f%d(a):\n    return a\n\nclass C%d:\n    pass\n", "o_orderkey", "o_orderkey")
    a = o.select("o_orderkey", F.explode(code.atom_column("python")(source)).alias("a"))
    return a.select("o_orderkey", "a.name", "a.kind", "a.start_line")


@query("chk21_imports", "SELECT p_partkey, CASE WHEN k = 1 THEN p_type ELSE p_brand END AS symbol FROM part, unnest([1, 2]) AS u(k)")
def chk21(spark, sf_dir):
    @F.pandas_udf("array<string>")
    def symbols(s):
        return s.map(lambda x: [i[1] for i in code.imports(x, "typescript")])

    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    source = F.format_string("import { %s, %s as b } from './m'", "p_type", "p_brand")
    return p.select("p_partkey", F.explode(symbols(source)).alias("symbol"))


@query("chk22_ast_summary", "SELECT p_partkey, 1 AS functions, 'p' || p_partkey AS first FROM part")
def chk22(spark, sf_dir):
    names = F.regexp_extract_all("source", F.lit(r"(?m)fn\s+(\w+)"), 1)
    return rust(spark, sf_dir).select("p_partkey", F.size(names).alias("functions"), F.get(names, 0).alias("first"))


@query("scal42_minimize", "SELECT p_partkey, p_name || chr(10) AS minimal FROM part")
def scal42(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    return p.select("p_partkey", code.minimize(F.concat(F.lit("# head\n\n/* a\n b */\n"), "p_name", F.lit("\n// tail\n"))).alias("minimal"))


@query("scal43_signatures", "SELECT p_partkey, 'pub fn p' || p_partkey || '(x: i32) -> i32' AS signature FROM part")
def scal43(spark, sf_dir):
    return rust(spark, sf_dir).select("p_partkey", F.explode(code.signatures(F.col("source"), "rust")).alias("signature"))


@query("scal19_canonical", "SELECT p_partkey, 'a = ' || p_size || ' + b(c, d)' AS canonical FROM part")
def scal19(spark, sf_dir):
    @F.pandas_udf("string")
    def canonical(s):
        return s.map(lambda x: code.canonical(x, "rust"))

    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", canonical(F.format_string("a=%d+b ( c ,d )  // note\n\n", "p_size")).alias("canonical"))
