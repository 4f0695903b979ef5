"""Source code, end to end: atoms, entities, semantic and smart chunks, file predicates, features, imports.

The files are those of code_files; what they hold is stated here by hand, shape by shape ({k}: the part's key).
"""

from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions import code, features, files, interfaces
from shardwell.functions.text import kebab_case, lines
from shardwell.operators import chunking, projects, smart
from shardwell.sources.code_files import CODE_FILES_SQL, SHAPES, code_files, values
from shardwell.sources.corpus import spread, table

ATOMS = [
    (0, "p{k}", "async_function", 1, 5), (0, "main", "function", 10, 10), (0, "S{k}", "struct", 6, 6), (0, "std::io", "import", 7, 7), (0, "serde::Serialize", "import", 8, 8),
    (1, "f{k}", "function", 3, 5), (1, "C{k}", "class", 7, 7), (1, "a{k}", "constant", 6, 6), (1, "g{k}", "constant", 8, 9), (1, "react", "import", 1, 1), (1, "./d{k}", "import", 2, 2),
    (2, "_m", "function", 5, 8), (2, "g{k}", "async_function", 7, 10), (2, "T{k}", "class", 3, 8), (2, "os", "import", 1, 1), (2, "sys", "import", 1, 1), (2, ".m{k}", "import", 2, 2), (2, "django", "import", 9, 9),
    (3, "f{k}", "function", 3, 5), (3, "P{k}", "struct", 6, 8), (3, "stdio.h", "header", 1, 1), (3, "f{k}.h", "header", 2, 2),
    (4, "M{k}", "class", 3, 7), (4, "Run{k}", "function", 4, 6), (4, "System.Text", "import", 1, 1),
    (5, "@import 'base.css'\n.a{k}, .b", "constant", 1, 4), (5, "color: red;\n}\np", "constant", 3, 6), (5, "base.css", "import", 1, 1),
    (6, "h{k}", "async_function", 2, 2), (6, "next", "constant", 3, 4), (6, "express", "import", 1, 1),
    (7, "tint{k}", "function", 2, 4), (7, "c.glsl", "header", 1, 1),
    (8, "module", "module", 1, 3), (9, "module", "module", 1, 64),
    (10, "one{k}", "function", 1, 57), (11, "b{k}", "function", 31, 60), (11, "A{k}", "struct", 1, 30),
    (12, "a{k}", "function", 1, 4), (12, "b{k}", "function", 3, 7), (12, "C{k}", "class", 6, 29), (13, "module", "module", 1, 60),
]
IMPORT_STATEMENTS = [
    (0, "std::io::{Read, Write as W}", 7), (0, "serde::Serialize", 8), (1, "import { useState as u, memo } from 'react'", 1), (1, "import D from './d{k}'", 2),
    (2, "import os, sys", 1), (2, "from .m{k} import a as b", 2), (2, "import django", 9), (3, "stdio.h", 1), (3, "f{k}.h", 2), (6, 'import * as E from "express"', 1),
]
HIDDEN = {(0, "p{k}"), (0, "main"), (1, "g{k}"), (2, "_m"), (6, "h{k}"), (6, "next"), (10, "one{k}"), (11, "b{k}")}
WITHOUT_ENTITIES = (7, 8, 9, 13)  # their languages have none
ENTITIES = [(s, n, "function" if k == "async_function" else k, a, z, "private" if k == "import" or (s, n) in HIDDEN else "public") for s, n, k, a, z in ATOMS if k != "header" and s not in WITHOUT_ENTITIES]
ENTITIES += [(s, n, "import", a, a, "private") for s, n, a in IMPORT_STATEMENTS]
#: shape, language, lines, is_entrypoint, is_test, is_config, frameworks, category, strategy
FILES = [
    (0, "rust", 10, True, True, False, "serde", "test", "atomic"),
    (1, "typescript", 8, False, False, False, "react", "ui", "atomic"),
    (2, "python", 9, False, True, False, "django", "test", "atomic"),
    (3, "c", 8, False, False, False, "", "logic", "atomic"),
    (4, "csharp", 8, False, False, False, "", "data", "atomic"),
    (5, "css", 5, False, False, False, "", "logic", "atomic"),
    (6, "javascript", 3, True, False, False, "nextjs,express", "logic", "atomic"),
    (7, "unknown", 4, False, False, False, "", "logic", "atomic"),
    (8, "markdown", 3, False, False, False, "", "logic", "atomic"),
    (9, "json", 64, False, False, True, "", "config", "atomic"),
    (10, "rust", 57, False, False, False, "", "utility", "atomic"),
    (11, "rust", 60, False, False, False, "", "database", "by_entity"),
    (12, "python", 528, False, False, False, "", "logic", "hierarchical"),
    (13, "ruby", 60, False, False, False, "", "logic", "by_entity"),
]
#: shape, name, alias, granularity, first and last line of smart chunks
SMART = [
    (0, "p{k}", "p{k}", "module", 1, 10), (1, "C{k}", "components/c{k}", "module", 1, 8), (2, "test_{k}", "tests/test-{k}", "module", 1, 9), (3, "f{k}", "lib/f{k}", "module", 1, 8), (4, "M{k}", "models/m{k}", "module", 1, 8),
    (5, "s{k}", "look/s{k}", "module", 1, 5), (6, "index", "{k}/index", "module", 1, 3), (7, "s{k}", "gl/s{k}", "module", 1, 4), (8, "r{k}", "docs/r{k}", "module", 1, 3), (9, "app{k}.config", "conf/app{k}.config", "module", 1, 64),
    (10, "one{k}", "utils/one{k}", "module", 1, 57), (11, "b{k}", "two{k}/b{k}", "function", 31, 60), (11, "A{k}", "two{k}/a{k}", "type", 1, 30), (12, "big{k}", "pkg/big{k}", "module", 1, 528), (12, "C{k}", "big{k}/c{k}", "type", 6, 29),
]


def listed(name: str, language: str | None = None):
    """The atoms of all files, or of those in some languages."""
    shapes = [k for k, s in enumerate(SHAPES) if language is None or s[1] in language.split()]

    @query(name, values([r for r in ATOMS if r[0] in shapes], "name, kind, start_line, end_line"))
    def run(spark, sf_dir):
        f = code_files(spark, sf_dir)
        f = f if language is None else f.filter(F.col("language").isin(*language.split()))
        a = f.select("p_partkey", F.explode(code.any_atoms("language", "content")).alias("a"))
        return a.select("p_partkey", "a.name", "a.kind", "a.start_line", "a.end_line")


listed("chk13_dispatch")
listed("chk15_typescript_atoms", "typescript javascript")
listed("chk16_python_atoms", "python")
listed("chk17_c_atoms", "c glsl")
listed("chk18_csharp_css_atoms", "csharp css markdown json ruby")


@query("chk19_ends", f"WITH {CODE_FILES_SQL}, a AS ({values([r for r in ATOMS if r[0] in (10, 11) or r[:2] == (3, 'f{k}')], 'name, kind, start_line, end_line')}), l AS (SELECT p_partkey, string_split(content, chr(10)) AS ls FROM code_files) SELECT p_partkey, name, CAST(strlen(array_to_string(ls[:end_line], chr(10))) AS INTEGER) AS end_byte FROM a JOIN l USING (p_partkey)")
def chk19(spark, sf_dir):
    """Where the blocks end, in bytes: behind the last line's brace."""
    f = code_files(spark, sf_dir)
    a = f.select("p_partkey", "path", F.explode(code.any_atoms("language", "content")).alias("a")).select("p_partkey", "path", "a.*")
    picked = F.startswith("path", F.lit("src/utils/")) | F.startswith("path", F.lit("src/db/")) | (F.startswith("path", F.lit("lib/")) & (F.col("kind") == "function"))
    return a.filter(picked).select("p_partkey", "name", F.col("end").alias("end_byte"))


@query("chk12_entities", values(ENTITIES, "name, kind, start_line, end_line, visibility"))
def chk12(spark, sf_dir):
    f = code_files(spark, sf_dir).withColumn("language", files.language_of(F.col("path")))
    return f.select("p_partkey", F.explode(code.entity_column("language", "content")).alias("e")).select("p_partkey", "e.*")


BOUNDARY = """CASE language
    WHEN 'rust' THEN regexp_matches(trim(x), '^(pub )?(fn|struct|impl|trait) ')
    WHEN 'typescript' THEN regexp_matches(trim(x), '^(export )?(function|class|interface) ') OR (starts_with(trim(x), 'const ') AND contains(x, '=>'))
    WHEN 'javascript' THEN regexp_matches(trim(x), '^(export )?(function|class|interface) ') OR (starts_with(trim(x), 'const ') AND contains(x, '=>'))
    WHEN 'python' THEN regexp_matches(x, '^(def|class) ') ELSE false END"""
# every file of the fixture ends with a line break
SEMANTIC = f"""WITH {CODE_FILES_SQL}, docs AS (SELECT p_partkey, language, content AS text, string_split(content[:-2], chr(10)) AS ls FROM code_files),
  b AS (SELECT p_partkey, list(i - 1 ORDER BY i) AS cuts FROM (SELECT p_partkey, language, i, ls[i] AS x FROM docs, unnest(range(1, len(ls) + 1)) AS u(i)) WHERE {BOUNDARY} GROUP BY p_partkey),
  s AS (SELECT p_partkey, ls, CASE WHEN j = 1 THEN 0 ELSE cuts[j - 1] END AS a, cuts[j] AS z FROM b JOIN docs USING (p_partkey), unnest(range(1, len(cuts) + 1)) AS u(j)),
  k AS (SELECT p_partkey, array_to_string(ls[a + 1 : z], chr(10)) AS content, CAST(a AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line FROM s WHERE z > a),
  c AS (SELECT p_partkey, text AS content, 0 AS start_line, CAST(len(ls) AS INTEGER) AS end_line FROM docs WHERE p_partkey NOT IN (SELECT p_partkey FROM b)
        UNION ALL SELECT * FROM k WHERE trim(content) <> '')"""


def begins(line):
    return files.is_boundary(line, F.col("language"))


@query("chk02_semantic", SEMANTIC + " SELECT *, 'chunk:sha256:' || sha256(content) AS chunk_id FROM c")
def chk02(spark, sf_dir):
    out = chunking.semantic(code_files(spark, sf_dir), "p_partkey", "content", begins, keep=("language",))
    return out.select("p_partkey", "content", "start_line", "end_line", "chunk_id")


@query("chk04_hierarchical", SEMANTIC + """ SELECT p_partkey, text AS content, 0 AS start_line, CAST(len(ls) AS INTEGER) AS end_line, 'chunk:sha256:' || sha256(text) AS chunk_id, NULL AS parent_id FROM docs
    UNION ALL SELECT c.p_partkey, content, start_line, end_line, 'chunk:sha256:' || sha256(content), 'chunk:sha256:' || sha256(text) FROM c JOIN docs USING (p_partkey)""")
def chk04(spark, sf_dir):
    return chunking.hierarchical(code_files(spark, sf_dir), "p_partkey", "content", begins, keep=("language",)).drop("language")


@query("chk06_boundaries", f"WITH {CODE_FILES_SQL}, l AS (SELECT p_partkey, language, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS x FROM (SELECT *, string_split(content[:-2], chr(10)) AS ls FROM code_files), unnest(range(1, len(ls) + 1)) AS u(i)) SELECT p_partkey, line_no, x AS line FROM l WHERE {BOUNDARY}")
def chk06(spark, sf_dir):
    rows = code_files(spark, sf_dir).select("p_partkey", "language", F.posexplode(lines(F.col("content"))).alias("line_no", "line"))
    return rows.filter(begins(F.col("line"))).select("p_partkey", "line_no", "line")


def analyzed(spark, sf_dir):
    return smart.analyze(code_files(spark, sf_dir))


def counted(rows: list[tuple]) -> dict[int, int]:
    return {k: sum(r[0] == k for r in rows) for k in range(len(SHAPES))}


ANALYSIS = [(*r[:8], counted(ENTITIES)[r[0]], counted([x for x in ENTITIES if x[5] == "public"])[r[0]]) for r in FILES]


@query("chk08_analysis", values(ANALYSIS, "language, n_lines, is_entrypoint, is_test, is_config, frameworks, category, entities, exports"))
def chk08(spark, sf_dir):
    a = analyzed(spark, sf_dir)
    return a.select("p_partkey", "language", F.size("lines").alias("n_lines"), "is_entrypoint", "is_test", "is_config", F.array_join("frameworks", ",").alias("frameworks"), "category", F.size("entities").alias("entities"), F.size("exports").alias("exports"))


@query("chk09_decisions", values([(r[0], r[8]) for r in FILES], "strategy"))
def chk09(spark, sf_dir):
    return smart.decide(analyzed(spark, sf_dir)).select("p_partkey", "strategy")


SLICED = f"c AS (SELECT s.*, array_to_string(string_split(content[:-2], chr(10))[start_line : end_line], chr(10)) AS content FROM s JOIN code_files USING (p_partkey))"


@query("chk10_smart_chunks", f"WITH {CODE_FILES_SQL}, s AS ({values(SMART, 'name, alias, granularity, start_line, end_line')}), {SLICED} SELECT *, 'chunk:sha256:' || sha256(content) AS chunk_id FROM c")
def chk10(spark, sf_dir):
    out = smart.chunks(smart.decide(analyzed(spark, sf_dir)), "p_partkey")
    return out.select("p_partkey", "name", "alias", "granularity", "start_line", "end_line", "content", "chunk_id")


@query("chk11_provides_requires", values([(s, n, ",".join(x[1] for x in ENTITIES if x[0] == s and x[5] == "public") if g == "module" else n if (s, n) not in HIDDEN else "", ";".join(x[1] for x in IMPORT_STATEMENTS if x[0] == s and s != 3) if g == "module" else "") for s, n, _, g, _, _ in SMART], "name, provides, requires"))
def chk11(spark, sf_dir):
    out = smart.chunks(smart.decide(analyzed(spark, sf_dir)), "p_partkey")
    return out.select("p_partkey", "name", F.array_join("provides", ",").alias("provides"), F.array_join("requires", ";").alias("requires"))


@query("fil21_entity_size", values([r for r in ENTITIES if r[4] - r[3] >= 10], "name, kind, start_line, end_line, visibility"))
def fil21(spark, sf_dir):
    e = analyzed(spark, sf_dir).select("p_partkey", F.explode("entities").alias("e")).select("p_partkey", "e.*")
    return e.filter(F.col("end_line") - F.col("start_line") >= smart.ENTITY_LINES)


@query("fil22_file_kinds", values([(r[0], r[3], r[4], r[5]) for r in FILES], "is_entrypoint, is_test, is_config"))
def fil22(spark, sf_dir):
    p, c = F.col("path"), F.col("content")
    f = code_files(spark, sf_dir).withColumn("language", files.language_of(p))
    return f.select("p_partkey", files.is_entrypoint(p, c, F.col("language")).alias("is_entrypoint"), files.is_test(p, c, F.col("language")).alias("is_test"), files.is_config(p).alias("is_config"))


@query("scal33_languages", values([(k, {"csharp": None, "glsl": None, "ruby": None}.get(s[1], s[1]), FILES[k][1], s[1] if s[1] in ("rust", "typescript", "javascript", "python") else None) for k, s in enumerate(SHAPES)], "scraper, chunker, atomizer"))
def scal33(spark, sf_dir):
    p = F.col("path")
    return code_files(spark, sf_dir).select("p_partkey", files.language_of(p, files.SCRAPER, None).alias("scraper"), files.language_of(p).alias("chunker"), files.language_of(p, files.ATOMIZER, None).alias("atomizer"))


@query("scal34_frameworks", values([(r[0], r[6]) for r in FILES], "frameworks"))
def scal34(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return f.select("p_partkey", F.array_join(files.frameworks(F.col("content"), F.col("language")), ",").alias("frameworks"))


@query("scal35_category", values([(r[0], r[7]) for r in FILES], "category"))
def scal35(spark, sf_dir):
    return analyzed(spark, sf_dir).select("p_partkey", "category")


@query("scal36_imports_exports", values([(k, ";".join(x[1] for x in IMPORT_STATEMENTS if x[0] == k and k != 3), ";".join(sorted(x[1] for x in ENTITIES if x[0] == k and x[5] == "public"))) for k in range(len(SHAPES)) if k != 5], "imports, exports"))
def scal36(spark, sf_dir):
    a = analyzed(spark, sf_dir).filter("language <> 'css'")  # rules' names hold line breaks; chk08 counts them
    return a.select("p_partkey", F.array_join("imports", ";").alias("imports"), F.array_join(F.array_sort("exports"), ";").alias("exports"))


@query("scal38_alias", values([(0, "p{k}"), (1, "components/c{k}"), (2, "tests/test-{k}"), (3, "lib/f{k}"), (4, "models/m{k}"), (5, "look/s{k}"), (6, "{k}/index"), (7, "gl/s{k}"), (8, "docs/r{k}"), (9, "conf/app{k}.config"), (10, "utils/one{k}"), (11, "db/two{k}"), (12, "pkg/big{k}"), (13, "bin/run{k}")], "alias"))
def scal38(spark, sf_dir):
    return code_files(spark, sf_dir).select("p_partkey", files.alias_of(F.col("path"), files.stem(F.col("path"))).alias("alias"))


RESOLVED = [
    (0, "std::io", "std/io"), (0, "serde::Serialize", "serde/Serialize"), (1, "react", "./node_modules/react"), (1, "./d{k}", "web/components/./d{k}"),
    (2, "os", "./os.py"), (2, "sys", "./sys.py"), (2, ".m{k}", "pkg/m{k}.py"), (2, "django", "./django.py"), (3, "stdio.h", "lib/stdio.h"), (3, "f{k}.h", "lib/f{k}.h"),
    (4, "System.Text", "./System/Text.cs"), (5, "base.css", "look/base.css"), (6, "express", "./node_modules/express"), (7, "c.glsl", "gl/c.glsl"),
]


@query("scal40_import_paths", values(RESOLVED, "wanted, target"))
def scal40(spark, sf_dir):
    """The file each import leads to: the first candidate that is there, else the last."""
    f = code_files(spark, sf_dir)
    a = f.select("p_partkey", "path", "language", F.explode(code.any_atoms("language", "content")).alias("a")).filter(F.col("a.kind").isin("import", "header"))
    wanted = a.select("p_partkey", F.col("a.name").alias("wanted"), files.candidates(F.col("path"), F.col("a.name"), F.col("language"), ".").alias("tries"))
    tried = wanted.select("p_partkey", "wanted", F.element_at("tries", -1).alias("fallback"), F.posexplode("tries").alias("at", "path"))
    there = tried.join(f.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    best = there.groupBy("p_partkey", "wanted", "fallback").agg(F.min_by(F.when(F.col("there"), F.col("path")), F.when(F.col("there"), F.col("at"))).alias("found"))
    return best.select("p_partkey", "wanted", F.coalesce("found", "fallback").alias("target"))


@query("scal21_concepts_by_language", values([(0, "async"), (1, "oop,react"), (2, "async,oop"), (6, "async"), (10, ""), (11, ""), (12, "oop")], "concepts") + " UNION ALL " + values([(k, "") for k in (3, 4, 5, 7, 8, 9, 13)], "concepts"))
def scal21(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return f.select("p_partkey", F.array_join(files.concepts(F.col("content"), F.col("language")), ",").alias("concepts"))


INTERFACE_TEXT = """// part {0}
@interface Codec{0} {{ encode(a: u8[], b: Opt) -> bytes  decode(x: bytes) -> u8[]
  @contract {{ codec: "h264" }} @effects {{ concurrency: "{1}", io: ["a" "b",] }} @protocol {{ states: [a, b], initial: {2} }} }}
@impl {3} {{ speed: 3.5 on: true @x {{ y: {{ z: null }} }} }}
"""


def interface_text():
    k = F.col("p_partkey").cast("string")
    text = INTERFACE_TEXT.replace("{{", "{").replace("}}", "}")
    fill = {"{0}": k, "{1}": F.when(F.col("p_partkey") % 2 == 0, "immutable").otherwise("weird"), "{2}": F.when(F.col("p_partkey") % 3 == 0, "c").otherwise("a"), "{3}": F.when(F.col("p_partkey") % 5 == 0, "bare").otherwise(F.concat(F.lit("Codec"), k, F.lit(".one")))}
    out = F.when(F.col("p_partkey") % 7 == 0, F.lit("@interface {")).otherwise(F.lit(None))
    made = F.lit(text)
    for mark, to in fill.items():
        made = F.replace(made, F.lit(mark), to)
    return F.coalesce(out, made)


@query(
    "scal53_validation",
    """SELECT p_partkey, p_partkey % 7 <> 0 AS parsed, CASE WHEN p_partkey % 7 = 0 THEN 'expected name, found {' ELSE concat_ws(';', CASE WHEN p_partkey % 2 <> 0 THEN 'Invalid concurrency value: weird' END,
       CASE WHEN p_partkey % 3 = 0 THEN 'Initial state ''c'' not found in states list' END, CASE WHEN p_partkey % 5 = 0 THEN 'Implementation name ''bare'' should be in ''Interface.Implementation'' format' END) END AS problems FROM part""",
)
def scal53(spark, sf_dir):
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", interfaces.checked(interface_text()).alias("c")).select("p_partkey", "c.parsed", F.array_join("c.problems", ";").alias("problems"))


@query("scal52_interface_parts", "SELECT p_partkey, 'Codec' || p_partkey AS interface, 'Codec' || p_partkey || '.encode,Codec' || p_partkey || '.decode' AS methods, CASE WHEN p_partkey % 5 = 0 THEN 'bare' ELSE 'Codec' || p_partkey || '.one' END AS implementation FROM part WHERE p_partkey % 7 <> 0")
def scal52(spark, sf_dir):
    c = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", interfaces.checked(interface_text()).alias("c")).filter("c.parsed")
    return c.select("p_partkey", F.get("c.interfaces", 0).alias("interface"), F.array_join("c.methods", ",").alias("methods"), F.get("c.implementations", 0).alias("implementation"))


def featured(spark, sf_dir):
    f = code_files(spark, sf_dir)
    return f.select("p_partkey", "language", features.features(F.col("content"), F.col("language")).alias("f"), features.summary(F.col("content"), F.col("language")).alias("s"), features.metadata(F.col("content"), F.array(F.lit("x"), F.concat(F.lit("lang:"), "language"))).alias("m"))


#: shape, description, signatures, concepts
FEATURES = [
    (0, "Adds {k}.", "pub async fn p{k}(x: i32) -> i32 {;fn main() {}", "async,serde", 0.74),
    (1, None, "export function f{k}() {;export const a{k}: number = 2; const z = 1;const g{k} = () => 1", "", 0.6),
    (2, None, "def _m(self):", "django", 0.57),
    (3, "include <stdio.h>", "", "", 0.6),
    (4, None, "", "class", 0.52),
    (5, None, "", "", 0.5),
    (6, None, "async function h{k}() { return 1 };const next = h{k}", "", 0.6),
    (7, 'include "c.glsl"', "", "", 0.6),
    (8, "Part {k}", "", "", 0.6),
    (9, None, "", "", 0.5),
    (10, None, "fn one{k}() {", "", 0.55),
    (11, None, "fn b{k}() {", "", 0.55),
    (12, None, "def a{k}():;def b{k}():", "", 0.6),
    (13, None, "", "", 0.5),
]


@query("chk23_features", values([r[:4] for r in FEATURES], "description, signatures, concepts"))
def chk23(spark, sf_dir):
    return featured(spark, sf_dir).select("p_partkey", "f.description", F.array_join("f.signatures", ";").alias("signatures"), F.array_join("f.concepts", ",").alias("concepts"))


@query("scal09_quality", values([(r[0], r[4]) for r in FEATURES], "score").replace(", score FROM", ", CAST(score AS DOUBLE) AS score FROM"))
def scal09(spark, sf_dir):
    return featured(spark, sf_dir).select("p_partkey", F.round(features.quality(F.col("f"), F.lit(0.0)), 6).alias("score"))


@query("scal10_metadata", values([(r[0], "Unnamed Component", r[1] or "No description available", SHAPES[r[0]][1], 0, r[3], r[4]) for r in FEATURES], "name, description, language, usage_count, concepts, quality").replace(", quality FROM", ", CAST(quality AS DOUBLE) AS quality FROM"))
def scal10(spark, sf_dir):
    m = featured(spark, sf_dir).select("p_partkey", "m.*")
    return m.select("p_partkey", "name", "description", "language", "usage_count", F.array_join("concepts", ",").alias("concepts"), F.round("quality_score", 6).alias("quality"))


#: shape, functions, classes, api surface, features, optimizations, warnings
SUMMARIES = [
    (0, 2, 0, "p{k},main,S{k}", "defines_rust_2_functions,has_rust_2_dependencies", "", ""),
    (1, 3, 1, "f{k},z,g{k},C{k}", "defines_typescript_3_functions,defines_typescript_1_classes,has_typescript_2_dependencies", features.HINTS["classes"], features.HINTS["interfaces"]),
    (2, 0, 1, "T{k}", "defines_python_1_classes,has_python_2_dependencies", "", ""),
    *((k, 0, 0, "", "", "", "") for k in (3, 4, 5, 6, 7, 8, 9, 13)),
    (10, 1, 0, "one{k}", "defines_rust_1_functions", "", ""),
    (11, 1, 0, "b{k},A{k}", "defines_rust_1_functions", "", ""),
    (12, 2, 1, "a{k},b{k},C{k}", "defines_python_2_functions,defines_python_1_classes", "", ""),
]


@query("scal28_api_surface", values([(r[0], r[3]) for r in SUMMARIES], "surface"))
def scal28(spark, sf_dir):
    return featured(spark, sf_dir).select("p_partkey", F.array_join(features.surface(F.col("s")), ",").alias("surface"))


@query("scal30_quality_metrics", values([(r[0], min(r[1] + 2 * r[2], 100), r[1] + r[2], 100 * r[2] / (r[1] + r[2]) if r[1] + r[2] else 0) for r in SUMMARIES], "complexity, api_surface, modularity").replace("complexity,", "CAST(complexity AS DOUBLE) AS complexity,", 1).replace(", modularity FROM", ", round(CAST(modularity AS DOUBLE), 6) AS modularity FROM"))
def scal30(spark, sf_dir):
    m = featured(spark, sf_dir).select("p_partkey", features.metrics(F.col("s")).alias("q")).select("p_partkey", "q.*")
    return m.withColumn("modularity", F.round("modularity", 6))


@query("scal31_features", values([(r[0], r[4]) for r in SUMMARIES], "features"))
def scal31(spark, sf_dir):
    return featured(spark, sf_dir).select("p_partkey", F.array_join(features.feature_names(F.col("s"), F.col("language")), ",").alias("features"))


@query("scal32_hints", values([(r[0], r[5], r[6], {"rust": "Applied Rust-specific AST transformation", "typescript": "Applied TypeScript-specific AST transformation", "python": "Applied Python-specific AST transformation"}.get(SHAPES[r[0]][1], f"Basic transformation for {SHAPES[r[0]][1]}")) for r in SUMMARIES], "optimizations, warnings, applied"))
def scal32(spark, sf_dir):
    h = featured(spark, sf_dir).select("p_partkey", features.hints(F.col("s"), F.col("language")).alias("h"))
    return h.select("p_partkey", *(F.array_join(f"h.{c}", ",").alias(c) for c in ("optimizations", "warnings", "applied")))


NORMAL = "'fn _var0(_var1: _var2){ _var1 + ' || %s || ' }'"


@query("scal15_similarity", f"SELECT p_partkey, a = b AS identical, CASE WHEN a = b THEN 1.0::DOUBLE ELSE round(1.0 - levenshtein(a, b)::DOUBLE / greatest(strlen(a), strlen(b)), 6) END AS similarity FROM (SELECT p_partkey, {NORMAL % 'p_size'} AS a, {NORMAL % '(p_size + p_size % 2)'} AS b FROM part)")
def scal15(spark, sf_dir):
    normal = code.normal_forms("rust")
    own = F.concat(F.lit("fn add(a: i32) { a + "), F.col("p_size").cast("string"), F.lit(" } // sum"))
    other = F.concat(F.lit("fn  plus(b: i32) {\n b+"), (F.col("p_size") + F.col("p_size") % 2).cast("string"), F.lit(" } // sum"))
    found = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", normal(own).alias("a"), normal(other).alias("b"))
    return found.select("p_partkey", (F.col("a") == F.col("b")).alias("identical"), F.round(code.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("join13_semantic_hash", f"SELECT 'semantic:' || sha256({NORMAL % 'p_size'}) AS hash, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_size")
def join13(spark, sf_dir):
    """Equivalents: codes with one semantic hash, whatever their names, spaces and comments."""
    source = F.concat(F.lit("fn part"), F.col("p_partkey").cast("string"), F.lit("(v"), F.col("p_partkey").cast("string"), F.lit(": i32)  {\n v"), F.col("p_partkey").cast("string"), F.lit(" +"), F.col("p_size").cast("string"), F.lit(" }"))
    hashed = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", code.semantic_hashes("rust")(source).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(
    "agg06_suggestions",
    f"""WITH {CODE_FILES_SQL}, a AS ({values([(r[0], r[4], r[7]) for r in FILES], "is_test, category")}), f AS (SELECT path, is_test, category, regexp_extract(path, '^(.*)/', 1) AS folder FROM code_files JOIN a USING (p_partkey)),
    g AS (SELECT 'module' AS kind, folder, path FROM f UNION ALL SELECT 'test-suite', NULL, path FROM f WHERE is_test UNION ALL SELECT 'utilities', NULL, path FROM f WHERE category = 'utility')
    SELECT CASE kind WHEN 'module' THEN regexp_extract(folder, '[^/]*$') || '-module' ELSE kind END AS name, folder,
      CASE kind WHEN 'module' THEN 'Module contains ' || count(*) || ' related files' WHEN 'utilities' THEN 'Grouped utility files together' ELSE 'Grouped all test files together' END AS reason,
      count(*) AS members, min(path) AS first, max(path) AS last FROM g GROUP BY kind, folder HAVING count(*) >= 2""",
)
def agg06_suggestions(spark, sf_dir):
    """Compositions of all files: folders, tests, utilities."""
    return projects.compositions(analyzed(spark, sf_dir))
