"""Column functions on sources: search features, metadata, a summary by patterns, metrics, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardwell.functions.files import JS
from shardwell.functions.text import lines

# What a source is said to be about, by words in it.
KEYWORDS = {
    "typescript": ["auth", "jwt", "http", "server", "database", "api", "middleware"],
    "rust": ["async", "tokio", "serde", "http", "database", "api"],
    "python": ["flask", "django", "fastapi", "sqlalchemy", "requests", "api"],
    "other": ["function", "class", "method", "api", "service", "handler"],
}
COMMENTS = {"typescript": ["//", "/*"], "rust": ["///"], "other": ["//", "#", "/*"]}


def _switch(language: Column, by: dict[str, Column]) -> Column:
    out = by["other"]
    for k, c in by.items():
        if k != "other":
            out = F.when(language.isin(*(JS if k == "typescript" else (k,))), c).otherwise(out)
    return out


def _first_comment(rows: Column, marks: list[str]) -> Column:
    """The first comment line that says something, without its marks (each of which may be repeated)."""
    begun = F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: F.regexp_like(x, F.lit("^(" + "|".join(m.replace("*", r"\*") for m in marks) + ")")))

    def bare(x: Column) -> Column:
        for m in marks:
            x = F.regexp_replace(x, "^(" + m.replace("*", r"\*") + ")+", "")
        return F.trim(x)

    return F.get(F.filter(F.transform(begun, bare), lambda x: x != ""), 0)


def _docstring(rows: Column) -> Column:
    quoted = F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit('"""')) | F.startswith(x, F.lit("'''")))
    return F.regexp_replace(F.regexp_replace(F.get(quoted, 0), '^"+|"+$', ""), "^'+|'+$", "")


def features(source: Column, language: Column) -> Column:
    """struct(description, signatures, concepts)."""
    rows, low = lines(source), F.lower(source)
    has = lambda x, s: F.contains(x, F.lit(s))
    trimmed = lambda keep: F.transform(F.filter(rows, keep), lambda x: F.trim(x))
    said = _switch(language, {"python": _docstring(rows)} | {k: _first_comment(rows, m) for k, m in COMMENTS.items()})
    none = F.array().cast("array<string>")
    shown = _switch(language, {"typescript": trimmed(lambda x: has(x, "function ") | has(x, "=>") | (has(x, "const ") & has(x, "="))), "rust": trimmed(lambda x: has(x, "fn ")), "python": trimmed(lambda x: F.startswith(F.trim(x), F.lit("def "))), "other": none})
    about = _switch(language, {k: F.array_compact(F.array(*[F.when(has(low, w), w) for w in words])) for k, words in KEYWORDS.items()})
    return F.struct(said.alias("description"), shown.alias("signatures"), about.alias("concepts"))


def quality(found: Column, coverage: Column) -> Column:
    s = 0.5 + F.when(found["description"].isNotNull(), 0.1).otherwise(0.0) + 0.2 * F.coalesce(coverage, F.lit(0.0))
    s = s + F.least(0.05 * F.size(found["signatures"]), F.lit(0.1)) + F.least(0.02 * F.size(found["concepts"]), F.lit(0.1))
    return F.least(s, F.lit(1.0))


def metadata(source: Column, tags: Column) -> Column:
    """struct(name, description, language, usage_count, test_coverage, quality_score, concepts), as a search index keeps it."""
    tagged = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit("lang:"))), 0)
    language = F.coalesce(F.substring(tagged, F.lit(len("lang:") + 1), F.length(tagged)), F.lit("unknown"))
    found = features(source, F.lower(language))
    return F.struct(F.lit("Unnamed Component").alias("name"), F.coalesce(found["description"], F.lit("No description available")).alias("description"), language.alias("language"), F.lit(0).alias("usage_count"), F.lit(0.0).alias("test_coverage"), quality(found, F.lit(0.0)).alias("quality_score"), found["concepts"].alias("concepts"))


# What a summary counts, by language.
SUMMARY = {
    "rust": {"functions": r"(?m)^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "structs": r"(?m)^(?:pub\s+)?struct\s+(\w+)", "traits": r"(?m)^(?:pub\s+)?trait\s+(\w+)", "imports": r"(?m)^use\s+([\w:]+)"},
    "typescript": {
        "functions": r"(?m)(?:export\s+)?(?:async\s+)?function\s+(\w+)|(?:export\s+)?const\s+(\w+)\s*=",
        "classes": r"(?m)(?:export\s+)?class\s+(\w+)",
        "interfaces": r"(?m)(?:export\s+)?interface\s+(\w+)",
        "imports": r"""(?m)^import\s+(?:\{[^}]*\}|[\w*]+)\s+from\s+['"]([^'"]+)['"]""",
    },
    "python": {"functions": r"(?m)^def\s+(\w+)", "classes": r"(?m)^class\s+(\w+)", "imports": r"(?m)^(?:from\s+[\w.]+\s+)?import\s+([\w., ]+)"},
}
PARTS = ("functions", "structs", "traits", "classes", "interfaces", "imports")


def summary(source: Column, language: Column) -> Column:
    """struct of the names that a source defines and imports; only three languages have any."""
    none = F.array().cast("array<string>")
    found = []
    for part in PARTS:
        c = none
        for k, patterns in SUMMARY.items():
            if part in patterns:
                names = F.regexp_extract_all(source, F.lit(patterns[part]), F.lit(1))
                if "|(?:export" in patterns[part]:  # the name is in either group
                    names = F.zip_with(names, F.regexp_extract_all(source, F.lit(patterns[part]), F.lit(2)), lambda a, b: F.concat(a, b))
                c = F.when(language == k, names).otherwise(c)
        found.append(c.alias(part))
    return F.struct(*found)


def surface(s: Column) -> Column:
    return F.concat(s["functions"], s["structs"], s["classes"], s["interfaces"], s["traits"])


def metrics(s: Column) -> Column:
    """struct(complexity, api_surface, modularity)."""
    f, c, t = (F.size(s[k]) for k in ("functions", "classes", "traits"))
    total = f + c + t
    return F.struct(F.least(f + 2.0 * c + 1.5 * t, F.lit(100.0)).alias("complexity"), total.alias("api_surface"), F.when(total == 0, 0.0).otherwise(100.0 * (c + t) / total).alias("modularity"))


def feature_names(s: Column, language: Column) -> Column:
    parts = (("functions", "defines", "functions"), ("classes", "defines", "classes"), ("traits", "uses", "traits"), ("imports", "has", "dependencies"))
    named = [F.when(F.size(s[k]) > 0, F.concat(F.lit(f"{verb}_"), language, F.lit("_"), F.size(s[k]).cast("string"), F.lit(f"_{what}"))) for k, verb, what in parts]
    return F.array_compact(F.array(*named))


# What is said of a source.
HINTS = {
    "async": "Consider using tokio runtime for async code optimization",
    "traits": "High trait count detected - consider trait composition",
    "classes": "Consider using more OOP patterns with classes",
    "interfaces": "No interfaces defined - consider using interfaces for better type safety",
    "style": "Functional style detected - consider using classes for better organization",
}


def hints(s: Column, language: Column) -> Column:
    """struct(applied, optimizations, warnings)."""
    n = {k: F.size(s[k]) for k in PARTS}
    named = F.when(language == "rust", "Applied Rust-specific AST transformation").when(language == "typescript", "Applied TypeScript-specific AST transformation").when(language == "python", "Applied Python-specific AST transformation").otherwise(F.concat(F.lit("Basic transformation for "), language))
    better = F.array_compact(F.array(F.when((language == "rust") & F.exists(s["functions"], lambda f: F.contains(f, F.lit("_async"))), HINTS["async"]), F.when((language == "rust") & (n["traits"] > 5), HINTS["traits"]), F.when((language == "typescript") & (n["functions"] > n["classes"]), HINTS["classes"])))
    warned = F.array_compact(F.array(F.when((language == "typescript") & (n["interfaces"] == 0) & (n["classes"] > 0), HINTS["interfaces"]), F.when((language == "python") & (n["classes"] == 0) & (n["functions"] > 0), HINTS["style"])))
    return F.struct(F.array(named).alias("applied"), better.alias("optimizations"), warned.alias("warnings"))
