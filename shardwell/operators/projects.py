"""Walks of project trees as filters on paths, project types, manifests, suggestions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwell.functions import files

# What walks leave out, and what they take.
IGNORED_DIRS = [".git", "node_modules", "target", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".cache", "coverage"]
IGNORED_FILES = ["*.lock", "*.log", ".DS_Store", "*.min.js", "*.min.css", "*.map"]
SOURCE_EXTENSIONS = ["rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "pyi", "go", "c", "h", "cpp", "hpp", "cc", "cxx", "java", "kt", "swift", "rb", "php", "scala", "cs", "zig", "md", "json", "yaml", "yml", "toml", "html", "css", "scss", "sql", "sh"]
MOST_BYTES = 10 * 1024 * 1024
LEGACY_DIRS = ["node_modules", "target", ".git", "__pycache__", "dist", "build", ".next"]
LEGACY_EXTENSIONS = {
    "typescript": ["ts", "tsx", "js", "jsx", "json"],
    "javascript": ["js", "jsx", "mjs", "cjs", "json"],
    "rust": ["rs", "toml"],
    "c": ["c", "h", "cpp", "hpp", "cc", "hh"],
    "python": ["py", "pyi"],
    "go": ["go", "mod", "sum"],
    "unknown": ["txt", "md", "json", "yaml", "yml"],
}
EXCLUDED = ["**/.git", "**/node_modules", "**/target", "**/.venv", "**/dist", "**/build", "**/.DS_Store"]


def glob(pattern: str) -> str:
    """A regular expression of a whole path: ** and * stand for anything, slashes too; **/ may stand for nothing."""
    out = ""
    for part in re.split(r"(\*\*/|\*+|\?)", pattern):
        out += {"**/": "(?:.*/)?", "?": "."}.get(part, ".*" if part.startswith("*") else re.escape(part))
    return f"(?s)^{out}$"


def scan(rows: DataFrame, path: str, include: list[str] | None = None, exclude: list[str] = EXCLUDED) -> DataFrame:
    """Files that match no exclude glob, and one of the include globs if there are any. A glob is held against the file's
    whole path, so one that names a folder leaves its files in."""
    out = rows.filter(~F.exists(F.array(*map(F.lit, map(glob, exclude))), lambda g: F.regexp_like(F.col(path), g))) if exclude else rows
    return out.filter(F.exists(F.array(*map(F.lit, map(glob, include))), lambda g: F.regexp_like(F.col(path), g))) if include else out


def _folders(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)


def _skipped(path: Column, dirs: list[str]) -> Column:
    return F.exists(_folders(path), lambda d: d.isin(dirs) | F.startswith(d, F.lit(".")))


def walked(path: Column, size: Column) -> Column:
    """Whether a project walk takes the file."""
    n = files.name_of(path)
    ignored = F.lit(False)
    for p in IGNORED_FILES:
        ignored = ignored | (F.endswith(n, F.lit(p[1:])) if p.startswith("*") else n == p)
    return ~_skipped(path, IGNORED_DIRS) & ~ignored & (size <= MOST_BYTES) & files.extension(path).isin(SOURCE_EXTENSIONS)


def legacy_walked(path: Column, project_type: str) -> Column:
    return ~_skipped(path, LEGACY_DIRS) & files.extension(path).isin(LEGACY_EXTENSIONS[project_type])


def project_type(markers: Column, counts: Column) -> Column:
    """struct(type, language) by marker files in a fixed order, else by the most common language (of equals the smallest name)."""
    has = lambda *names: F.exists(markers, lambda m: m.isin(*names))
    n = lambda k: F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0))
    pair = lambda t, lang: F.struct(F.lit(t).alias("type"), F.lit(lang).alias("language"))
    entries = F.map_entries(counts)
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    common = F.coalesce(F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == top), lambda e: e["key"])), F.lit("unknown"))
    other = F.struct(F.when(F.size(entries) > 2, "Mixed").otherwise("Unknown").alias("type"), common.alias("language"))
    out = F.when(has("Cargo.toml"), pair("Rust", "rust")).when(has("tsconfig.json"), pair("TypeScript", "typescript"))
    out = out.when(has("package.json"), F.when(n("typescript") > n("javascript"), pair("TypeScript", "typescript")).otherwise(pair("JavaScript", "javascript")))
    out = out.when(has("pyproject.toml", "setup.py"), pair("Python", "python")).when(has("go.mod"), pair("Go", "go"))
    out = out.when(has("CMakeLists.txt", "Makefile"), F.when(n("cpp") > n("c"), pair("Cpp", "cpp")).otherwise(pair("C", "c")))
    return out.when(has("pom.xml", "build.gradle"), pair("Java", "java")).otherwise(other)


def dependencies(name: Column, content: Column) -> Column:
    """Ids of what a manifest file asks for."""
    npm = F.transform(F.map_entries(F.from_json(F.get_json_object(content, "$.dependencies"), "map<string,string>")), lambda e: F.concat(F.lit("npm:"), e["key"], F.lit("@"), e["value"]))
    set_ = F.filter(F.split(content, "\n"), lambda x: F.contains(x, F.lit(" = ")) & ~F.startswith(x, F.lit("[")) & ~F.startswith(x, F.lit("#")))
    crates = F.transform(set_, lambda x: F.concat(F.lit("crates:"), F.trim(F.substring_index(x, "=", 1))))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(name == "package.json", npm).when(name == "Cargo.toml", crates), none)


def suggestions(names: DataFrame, column: str, task: str, language: str | None = None, most: int = 5) -> DataFrame:
    """The best chunk files for a task, by words that task and name share."""
    n, score = F.lower(column), F.lit(0)
    for word, points in (("todo", 10), ("react", 10)):
        if word in task.lower():
            score = score + F.when(F.contains(n, F.lit(word)), points).otherwise(0)
    if language:
        score = score + F.when(F.contains(n, F.lit(language.lower())), 5).otherwise(0)
    shown = F.regexp_replace(F.replace(n, F.lit("chunk_sha256_"), F.lit("chunk:sha256:")), r"(\.chunk)+$", "")
    return names.select(shown.alias("name"), score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "name").limit(most)


def memberships(analyzed: DataFrame) -> DataFrame:
    """kind, folder, path: the groups that an analyzed file (path, category, is_test) belongs to: its folder, tests, utilities."""
    path, none = F.col("path"), F.lit(None).cast("string")
    group = lambda kind, folder: F.struct(F.lit(kind).alias("kind"), folder.alias("folder"))
    belongs = F.array(group("module", files.folder(path)), F.when(F.col("is_test"), group("test-suite", none)), F.when(F.col("category") == "utility", group("utilities", none)))
    return analyzed.select(F.explode(F.filter(belongs, lambda g: g.isNotNull())).alias("g"), "path").select("g.*", "path")


def compositions(analyzed: DataFrame, least: int = 2) -> DataFrame:
    """name, folder, reason, members, first and last path of suggested compositions: every folder of at least so many files, and tests and
    utilities if there are two. The members themselves are rows of memberships(), not lists: a folder may hold most files."""
    kind, folder = F.col("kind"), F.col("folder")
    sized = memberships(analyzed).groupBy("kind", "folder").agg(F.count("*").alias("members"), F.min("path").alias("first"), F.max("path").alias("last"))
    kept = sized.filter(F.col("members") >= F.when(kind == "module", least).otherwise(2))
    name = F.when(kind == "module", F.concat(files.name_of(folder), F.lit("-module"))).otherwise(kind)
    reason = F.when(kind == "module", F.concat(F.lit("Module contains "), F.col("members").cast("string"), F.lit(" related files"))).when(kind == "utilities", "Grouped utility files together").otherwise("Grouped all test files together")
    return kept.select(name.alias("name"), "folder", reason.alias("reason"), "members", "first", "last")
