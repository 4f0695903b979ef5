"""Source files made of the parts: the given tables hold no code. Fourteen shapes, by the part's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.sources.corpus import spread, table

#: (path, language, text); {k} is the part's key.
SHAPES = [
    ("src/p{k}.rs", "rust", '/// Adds {k}.\npub async fn p{k}(x: i32) -> i32 {\n  let s = "}";\n  x + 1\n}\nstruct S{k} { a: u8 }\nuse std::io::{Read, Write as W};\nuse serde::Serialize;\n#[test]\nfn main() {}\n'),
    ("web/components/C{k}.tsx", "typescript", "import { useState as u, memo } from 'react'\nimport D from './d{k}'\nexport function f{k}() {\n  return `}`\n}\nexport const a{k}: number = 2; const z = 1\nclass C{k} { m() {} }\nconst g{k} = () => 1\n"),
    ("pkg/tests/test_{k}.py", "python", "import os, sys\nfrom .m{k} import a as b\n\nclass T{k}:\n    def _m(self):\n        pass\n\nasync def g{k}():\n    import django\n"),
    ("lib/f{k}.c", "c", "#include <stdio.h>\n#include \"f{k}.h\"\nint f{k}(int a) {\n  if (a) { return 1; }\n}\nstruct P{k} {\n  int x;\n};\n"),
    ("net/models/M{k}.cs", "csharp", "using System.Text;\nnamespace N {\n  public class M{k} {\n    public static int Run{k}(int a) {\n      return a;\n    }\n  }\n}\n"),
    ("look/s{k}.css", "css", "@import 'base.css'\n.a{k}, .b {\n  color: red;\n}\np { margin: 0 }\n"),
    ("web/{k}/index.js", "javascript", "import * as E from \"express\"\nasync function h{k}() { return 1 }\nconst next = h{k}\n"),
    ("gl/s{k}.glsl", "glsl", "#include \"c.glsl\"\nvec4 tint{k}(vec4 c) {\n  return c;\n}\n"),
    ("docs/r{k}.md", "markdown", "# Part {k}\n\ntext\n"),
    ("conf/app{k}.config.json", "json", '{\n "k": {k},\n' + ' "x": 1,\n' * 60 + ' "z": 0\n}\n'),
    ("src/utils/one{k}.rs", "rust", "fn one{k}() {\n" + "  step();\n" * 55 + "}\n"),
    ("src/db/two{k}.rs", "rust", "pub struct A{k} {\n" + "  x: u8,\n" * 28 + "}\nfn b{k}() {\n" + "  step();\n" * 28 + "}\n"),
    ("pkg/big{k}.py", "python", "def a{k}():\n    pass\n\ndef b{k}():\n    pass\n\nclass C{k}:\n" + "    x = 1\n" * 20 + "\n" + "y = 2\n" * 500),
    ("bin/run{k}.rb", "ruby", "puts 1\n" * 60),
]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, path, language, content."""
    shape, key = F.col("p_partkey") % len(SHAPES), F.col("p_partkey").cast("string")
    made = [F.replace(F.element_at(F.array(*(F.lit(s[k]) for s in SHAPES)), (shape + 1).cast("int")), F.lit("{k}"), key) for k in range(3)]
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", made[0].alias("path"), made[1].alias("language"), made[2].alias("content"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """SQL: a row for each part and each of the rows (shape, ...) of its shape; {k} in strings is the part's key."""
    fields = [n.strip() for n in names.split(",")]
    cells = ", ".join("(" + ", ".join("NULL" if c is None else _text(c) if isinstance(c, str) else str(c).lower() if isinstance(c, bool) else str(c) for c in r) + ")" for r in rows)
    text = {n for k, n in enumerate(fields, 1) if any(isinstance(r[k], str) for r in rows)}
    shown = ", ".join(f"replace({n}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS {n}" if n in text else n for n in fields)
    return f"SELECT p_partkey, {shown} FROM part JOIN (VALUES {cells}) AS v(shape, {names}) ON p_partkey % {len(SHAPES)} = shape"


CODE_FILES_SQL = f"code_files AS ({values([(k, *s) for k, s in enumerate(SHAPES)], 'path, language, content')})"
