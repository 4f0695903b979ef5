"""Column functions on files: languages by extension, kinds of files, categories, frameworks, aliases, import paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardwell.functions.text import kebab_case

# Languages by extension in the scraper, in the chunker and in the atomizer.
SCRAPER = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "java": "java", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "html", "htm": "html", "css": "css"}
ATOMIZER = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python"}
CHUNKER = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "java": "java", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "php": "php", "scala": "scala", "zig": "zig",
    "md": "markdown", "markdown": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html", "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "dockerfile": "dockerfile",
}
CONFIG_NAMES = ["Cargo.toml", "package.json", "tsconfig.json", "pyproject.toml", "setup.py", "go.mod", "CMakeLists.txt", "Makefile", ".eslintrc.json", ".prettierrc", "webpack.config.js", "vite.config.ts", "tailwind.config.js"]
FRAMEWORKS = {
    "typescript": [("react", "react"), ("React", "react"), ("@angular", "angular"), ("vue", "vue"), ("next", "nextjs"), ("express", "express")],
    "rust": [("actix", "actix"), ("tokio", "tokio"), ("axum", "axum"), ("serde", "serde")],
    "python": [("django", "django"), ("flask", "flask"), ("fastapi", "fastapi")],
}
FOLDERS = [("api", "/api/"), ("api", "/routes/"), ("ui", "/ui/"), ("ui", "/components/"), ("ui", "/views/"), ("utility", "/utils/"), ("utility", "/helpers/"), ("data", "/models/"), ("data", "/types/"), ("database", "/db/"), ("database", "/database/")]
NAMES = [("utility", "util"), ("utility", "helper"), ("data", "type"), ("data", "model")]
CONCEPTS = {
    "rust": [("async", "async"), ("trait", "trait"), ("macro", "macro"), ("unsafe", "unsafe")],
    "typescript": [("async", "async"), ("class", "oop"), ("react", "react"), ("React", "react"), ("@", "decorators")],
    "python": [("async", "async"), ("@", "decorators"), ("class", "oop")],
}
TYPES = ["struct", "class", "interface", "enum", "type"]
JS = ("typescript", "javascript")


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Behind the last dot of the name; a name that only begins with a dot has none."""
    return F.regexp_extract(name_of(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise("")


def looked_up(key: Column, values: dict[str, str], other: str | None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def language_of(path: Column, values: dict[str, str] = CHUNKER, other: str | None = "unknown") -> Column:
    return looked_up(extension(path), values, other)


def _by_language(language: Column, rules: dict[str, Column]) -> Column:
    out = F.lit(False)
    for k, c in rules.items():
        out = F.when(language.isin(*(JS if k == "typescript" else (k,))), c).otherwise(out)
    return out


def is_entrypoint(path: Column, content: Column, language: Column) -> Column:
    n, has = name_of(path), lambda x: F.contains(content, F.lit(x))
    return _by_language(language, {"rust": (n == "main.rs") | has("fn main()"), "typescript": n.isin("index.ts", "index.tsx", "index.js", "main.ts"), "python": n.isin("__main__.py", "main.py") | has("if __name__"), "go": (n == "main.go") | has("func main()")})


def is_test(path: Column, content: Column, language: Column) -> Column:
    n, has, at = name_of(path), lambda x: F.contains(content, F.lit(x)), lambda x: F.contains(path, F.lit(x))
    js = F.contains(n, F.lit(".test.")) | F.contains(n, F.lit(".spec.")) | at("__tests__")
    py = F.startswith(n, F.lit("test_")) | F.endswith(n, F.lit("_test.py")) | at("/tests/")
    return _by_language(language, {"rust": at("/tests/") | has("#[test]") | has("#[cfg(test)]"), "typescript": js, "python": py, "go": F.endswith(n, F.lit("_test.go"))})


def is_config(path: Column) -> Column:
    n = name_of(path)
    return n.isin(*CONFIG_NAMES) | (extension(path).isin("toml", "yaml", "yml", "json") & (F.contains(n, F.lit("config")) | F.contains(n, F.lit("settings"))))


def _marks(content: Column, language: Column, table: dict[str, list[tuple[str, str]]]) -> Column:
    none = F.array().cast("array<string>")
    out = none
    for k, marks in table.items():
        found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(content, F.lit(x)), name) for x, name in marks])))
        out = F.when(language.isin(*(JS if k == "typescript" else (k,))), found).otherwise(out)
    return out


def frameworks(content: Column, language: Column) -> Column:
    return _marks(content, language, FRAMEWORKS)


def concepts(content: Column, language: Column) -> Column:
    """What a scraped chunk is said to be about."""
    return _marks(content, language, CONCEPTS)


def category(path: Column, kinds: Column, test: Column, config: Column) -> Column:
    """kinds: of the file's entities. Tests and configuration first, then folders, names, and a majority of types."""
    low, n = F.lower(path), F.lower(name_of(path))
    types = F.size(F.filter(kinds, lambda k: k.isin(*TYPES)))
    out = F.when(types > F.floor(F.size(kinds) / 2), "data").otherwise("logic")
    for what, part in reversed(NAMES):
        out = F.when(F.contains(n, F.lit(part)), what).otherwise(out)
    for what, part in reversed(FOLDERS):
        out = F.when(F.contains(low, F.lit(part)), what).otherwise(out)
    return F.when(test, "test").when(config, "config").otherwise(out)


def alias_of(path: Column, name: Column) -> Column:
    """The name, behind the folder's name unless that is empty or src."""
    parent = name_of(folder(path))
    return F.when(parent.isin("", "src"), kebab_case(name)).otherwise(F.concat(kebab_case(parent), F.lit("/"), kebab_case(name)))


def is_boundary(line: Column, language: Column) -> Column:
    """Whether a definition begins on the line, as the semantic chunker sees it."""
    t = F.trim(line)
    begins = lambda c, words: reduce(lambda a, b: a | b, (F.startswith(c, F.lit(w)) for w in words))
    both = lambda more, words: [*(f"{w} " for w in words), *(f"{more} {w} " for w in words)]
    js = begins(t, both("export", ["function", "class", "interface"])) | (F.startswith(t, F.lit("const ")) & F.contains(t, F.lit("=>")))
    return _by_language(language, {"rust": begins(t, both("pub", ["fn", "struct", "impl", "trait"])), "typescript": js, "python": begins(line, ["def ", "class "])})


def _with_extension(path: Column, ext: str) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "") + F.lit("") if not ext else F.concat(F.regexp_replace(path, r"(?<=[^/.])\.[^./]*$", ""), F.lit(f".{ext}"))


def _joined(base: Column, more: Column) -> Column:
    return F.when(F.startswith(more, F.lit("/")), more).when(base == "", more).otherwise(F.concat(base, F.lit("/"), more))


def candidates(path: Column, wanted: Column, language: Column, root: str) -> Column:
    """Where an import may lead, best first; the last one is taken if none of the files is there."""
    top, here = F.lit(root), folder(path)
    slashed = F.replace(wanted, F.lit("::"), F.lit("/"))
    parts = F.split(F.replace(wanted, F.lit("crate::"), F.lit("")), "::")
    inner = F.array_join(F.concat(F.array(F.lit(f"{root}/src")), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), "/")
    above = F.replace(F.substring(wanted, F.lit(len("super::") + 1), F.length(wanted)), F.lit("::"), F.lit("/"))
    rust = F.when(F.startswith(wanted, F.lit("crate::")), F.array(_with_extension(inner, "rs"))).when(F.startswith(wanted, F.lit("super::")), F.array(_with_extension(_joined(folder(here), above), "rs"))).otherwise(F.array(slashed))
    near = _joined(here, wanted)
    tries = F.array(*[_with_extension(near, e) for e in ("ts", "tsx", "js", "jsx", "index.ts", "index.js")], near)
    ts = F.when(F.startswith(wanted, F.lit(".")), tries).when(F.startswith(wanted, F.lit("@")) | F.startswith(wanted, F.lit("~")), F.array(wanted)).otherwise(F.array(_joined(F.lit(f"{root}/node_modules"), wanted)))
    dots = F.length(F.regexp_extract(wanted, r"^(\.*)", 1))
    up = F.aggregate(F.sequence(F.lit(0), dots), path, lambda p, _: folder(p))
    rest = F.replace(F.regexp_replace(wanted, r"^\.+", ""), F.lit("."), F.lit("/"))
    py = F.when(dots > 0, F.array(_with_extension(_joined(up, rest), "py"))).otherwise(F.array(_with_extension(_joined(top, F.replace(wanted, F.lit("."), F.lit("/"))), "py")))
    c = F.array(near, _joined(F.lit(f"{root}/include"), wanted), _joined(F.lit(f"{root}/src"), wanted), near)
    cs = F.array(_with_extension(_joined(top, F.replace(wanted, F.lit("."), F.lit("/"))), "cs"))
    out = F.array(wanted)
    for names, found in ((("rust",), rust), (JS, ts), (("python",), py), (("c", "cpp", "glsl"), c), (("csharp",), cs), (("css",), F.array(near))):
        out = F.when(language.isin(*names), found).otherwise(out)
    return out
