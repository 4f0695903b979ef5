"""Source code functions, the interface language and project walks against literals."""

import re

import pytest
from pyspark.sql import functions as F

from shardwell.functions import code, files, interfaces
from shardwell.operators import projects, views


def test_ends():
    assert code.block_end("f { '}' \"{\" } x", 0) == 13
    assert code.block_end('f { "a\\"}" } x', 0) == 12  # a quote behind a backslash does not close
    assert code.block_end("no braces", 0) == 9
    assert code.statement_end("const a = 1; b", 0) == 12 and code.statement_end("a\nb", 0) == 2 and code.statement_end("ab", 0) == 2
    assert code.indented_end("def f():\n  a\n\n  b\nc\n", 0) == 18


def test_definitions():
    found = code.definitions("/// Doc\npub fn é() {}\nstruct S;\n", "rust")
    assert [(x["name"], x["start"], x["end"], x["visibility"]) for x in found] == [("é", 0, 22, "private"), ("S", 23, 33, "public")]
    assert [x["kind"] for x in code.definitions("async def _f():\n  pass\nclass C: pass", "python")] == ["async_function", "class"]
    assert code.definitions("anything\n", "cobol") == [{"name": "module", "kind": "module", "start": 0, "end": 9, "start_line": 1, "end_line": 1, "visibility": "public"}]
    assert [x["name"] for x in code.import_entities("use a::b;\nfn f() {}\n", "rust")] == ["a::b"]
    assert [x["name"] for x in code.import_entities('import "fmt"\nimport (\n', "go")] == ["fmt"]


def test_interface_language():
    doc = interfaces.parse("""// note
      @interface A { f(x: u8[], y: B) -> C  f() -> D @effects { concurrency: "odd" io: ["a" "b",] } @permissions { } @abi { string_encoding: "utf9" } }
      @interface A { } @impl bare { n: -1.5 ok: true list: [1, {k: null}] } @impl A.one { @x { y { z: 1 } } } @resources { memory: { peak: "" } }""")
    assert doc["interfaces"][0]["methods"][0] == {"name": "f", "params": [{"name": "x", "type": "u8[]"}, {"name": "y", "type": "B"}], "returns": "C"}
    assert doc["implementations"][0]["attributes"] == {"n": -1.5, "ok": True, "list": [1.0, {"k": "null"}]}
    assert [m for m, _ in interfaces.problems(doc)] == [
        "Duplicate method name: f", "Invalid concurrency value: odd", "Permissions annotation is empty", "Invalid string encoding: utf9", "Duplicate interface name: A",
        "Implementation name 'bare' should be in 'Interface.Implementation' format",
    ]
    states = interfaces.parse('@interface P { @protocol { states: ["a", "b"] } @contract { } }')
    assert [m for m, _ in interfaces.problems(states)] == ["Protocol with states must have an initial state", "Contract missing descriptive fields (codec, etc.)"]
    for bad in ("@interface {", "@impl A { x: }", "@interface A { f( -> B }", "plain"):
        with pytest.raises(interfaces.Malformed):
            interfaces.parse(bad)


def test_globs():
    hit = lambda p, s: bool(re.match(projects.glob(p), s))
    assert hit("**/.git", ".git") and hit("**/.git", "a/b/.git") and not hit("**/.git", "a/.git/config")
    assert hit("*.rs", "src/deep/a.rs") and hit("docs/**", "docs/a/b") and hit("a?c", "abc") and not hit("a?c", "abbc")


def test_import_paths(spark):
    rows = [("src/a/b.rs", "crate::x::y::Z", "rust"), ("src/a/b.rs", "super::c::d", "rust"), ("a/b/c.py", "..m.n", "python"), ("a/b.ts", "@app/x", "typescript"), ("a/b.ts", "./c.js", "typescript"), ("b.c", "h.h", "c")]
    frame = spark.createDataFrame(rows, "path string, wanted string, language string")
    got = [r[0] for r in frame.select(files.candidates(F.col("path"), F.col("wanted"), F.col("language"), "root")).collect()]
    assert got[0] == ["root/src/x/y.rs"] and got[1] == ["src/c/d.rs"] and got[2] == ["m/n.py"] and got[3] == ["@app/x"]
    assert got[4][0] == "a/./c.ts" and got[4][-1] == "a/./c.js" and got[5] == ["h.h", "root/include/h.h", "root/src/h.h", "h.h"]


def test_views_end_at_the_budget(spark):
    rows = [("v", 0, "c0", None, "Function", "rust", "x" * 40, ["a"]), ("v", 1, "c1", "al", "import", "python", "y\n", ["b", "a"]), ("v", 2, "c2", None, "function", "rust", "z" * 400, ["c"])]
    atoms = spark.createDataFrame(rows, "view string, pos int, chunk_id string, alias string, granularity string, language string, content string, symbols array<string>")
    v = views.assemble(atoms, views.ViewConfig(max_tokens=50)).first()
    assert v["text"] == "y\n\n" and v["n_atoms"] == 1 and not v["truncated"] and v["language"] == "rust"
    w = views.assemble(atoms, views.ViewConfig(max_tokens=200)).first()
    assert w["text"].startswith("y\n\n// --- c2 ---\n" + "z" * 400 + "\n\n// --- c0 ---\n") and w["symbols"] == {"a": 7, "b": 1, "c": 4}
