"""Functions against literals."""

import hashlib

from pyspark.sql import functions as F

from shardwell import catalog
from shardwell.functions import code, metadata, text


def test_identity(spark):
    row = spark.range(1).select(text.chunk_id(F.lit("hello world")).alias("id"), text.token_estimate(F.lit("x" * 1000)).alias("n"), text.human_bytes(F.lit(1536)).alias("h")).first()
    assert row["id"] == "chunk:sha256:" + hashlib.sha256(b"hello world").hexdigest()
    assert row["n"] == 250 and row["h"] == "1.50 KB"


def test_kebab(spark):
    words = spark.createDataFrame([("HelloWorld",), ("snake_case",), ("already-kebab",), ("With Space",)], "w string")
    assert [r[0] for r in words.select(text.kebab_case(F.col("w"))).collect()] == ["hello-world", "snake-case", "already-kebab", "with-space"]


def test_lines(spark):
    rows = spark.createDataFrame([("a\nb\n",), ("",), ("a\r\nb",), ("a\n\n",)], "t string").select(text.lines(F.col("t")).alias("l")).collect()
    assert [r["l"] for r in rows] == [["a", "b"], [], ["a", "b"], ["a", ""]]


def test_semantic_hash_ignores_names_and_comments():
    a = "fn add(a: i32, b: i32) -> i32 { a + b } // sum"
    b = "fn plus(x: i32,   y: i32) -> i32 {\n  x+y /* the\nsum */ }\n"
    assert code.canonical(code.rename("let a = a;", "rust"), "rust") == "let _var0 = _var0;"
    assert code.canonical("a  =  b ( c , d )", "rust") == "a = b(c, d)"
    assert code.strip_comments("x = 'http://a' // b", "rust") == "x = 'http://a' "
    assert code.strip_comments("x = 1 # b\ny", "python") == "x = 1 \ny"
    assert code.semantic_hash(a.split(" //")[0], "rust") != code.semantic_hash("fn f() {}", "rust")
    assert code.rename(a.split(" //")[0], "rust").split("{")[0].split() == code.rename(b, "rust").split("{")[0].split()


def test_atoms():
    source = 'async fn go() { let s = "}"; }\nstruct P {\n  a: u8\n}\n'
    assert [a[:2] for a in code.atoms(source, "rust")] == [("go", "async_function"), ("P", "struct")]
    assert code.atoms(source, "rust")[0][3] == source.index("\n")
    python = "def f(a):\n    x\n\n    y\nclass C:\n    pass\n"
    assert [(a[0], a[4], a[5]) for a in code.atoms(python, "python")] == [("f", 1, 5), ("C", 5, 7)]
    assert code.atoms("plain", "text")[0][:2] == ("module", "module")


def test_imports():
    assert [i[:3] for i in code.imports("use a::{b, c as d};\nuse x::y;", "rust")] == [("a", "b", None), ("a", "c", "d"), ("x::y", "y", None)]
    assert [i[1] for i in code.imports("import { a, b as c } from 'm'\nimport D from \"n\"\nimport * as E from 'o'", "typescript")] == ["a", "b", "D", "E"]
    assert [i[0] for i in code.imports("from x.y import a, b\nimport os, sys", "python")] == ["x.y", "x.y", "os", "sys"]
    assert [i[0] for i in code.imports('#include <stdio.h>\n#include "a.h"', "c")] == ["stdio.h", "a.h"]


def test_minimize():
    assert code.minimized("a\n\n// b\n/* c\nd */\ne\n") == "a\ne\n"


def test_metadata(spark):
    from pyspark.sql import functions as F

    from shardwell.functions import metadata as m

    texts = ["# # Two  \r\n\r\n#x\n\r\n  text \r\n", "#no\n# ", '{"name": 5, "keywords": ["a", 1], "author": ["x"], "contributors": ["y", null]}', '{"name": "n"} tail', '[package]\nname = "q\\"t"\nauthors = []\n', '[package.x]\nname = "no"', "@tags: a,,b \n x @tag :c", None, ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("p", F.lit("a/b.c.md"))
    out = {r.k: r for r in rows.select("k", m.title(F.col("t"), F.col("p")).alias("title"), m.description(F.col("t")).alias("d"), m.keywords(F.col("t")).alias("kw"), m.authors(F.col("t")).alias("a"), m.tags(F.col("t")).alias("tags")).collect()}
    assert [out[k].title for k in range(9)] == ["Two", "", "b.c", "b.c", 'q"t', "b.c", "b.c", "b.c", "b.c"]
    assert out[0].d == "text" and out[1].d is None and out[2].kw == ["a"] and out[2].a == ["y"] and out[6].tags == ["a", "", "b", "c"] and out[8].kw == []


def test_representation_ladder(spark):
    from pyspark.sql import functions as F

    from shardwell.operators.representations import chosen

    reps = [("source", None, "s"), ("binary", "arm", "b1"), ("binary", "x86", "b2"), ("intermediate", None, "i")]
    asked = [("binary", ["source"], "b1"), ("ir", None, "i"), ("none", ["none", "embed", "source"], "i"), (None, ["none"], "b2"), (None, None, "b2")]
    rows = spark.createDataFrame([(k, reps, p, q) for k, (p, q, _) in enumerate(asked)], "k int, r array<struct<form: string, architecture: string, chunk: string>>, p string, q array<string>")
    got = {x.k: x.c for x in rows.select("k", chosen(F.col("r"), F.col("p"), F.col("q"), F.lit("x86"))["chunk"].alias("c")).collect()}
    assert [got[k] for k in range(5)] == [x[2] for x in asked]
    assert rows.select(chosen(F.col("r"), F.lit(None), F.lit(None).cast("array<string>"), F.lit("none"))["chunk"].alias("c")).first().c == "s"


def test_a_text_is_parsed_once_and_only_if_it_may_be_an_object(spark):
    texts = ['{"a": "b"}', ' \n{"a": "b"}\t', '{"a": "b"} {"a": "c"}', '{"a": "b"},{"a": "c"}', '["a"}', '"}"', "{", "}", "", None, '[{"a": "b"}]', 'x {"a": "b"}', '{"a": 1}', "{}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("doc", metadata.parsed(F.col("t")))
    got = [tuple(r) for r in rows.orderBy("k").select(metadata.json_string(F.col("doc"), "$.a"), F.col("doc").isNotNull()).collect()]
    assert got == [("b", True)] * 2 + [(None, False)] * 10 + [(None, True)] * 2
    plan = catalog.QUERIES["scal25_manifests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") <= 3
