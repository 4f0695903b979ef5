"""Metadata of a file from its text: Markdown headings, JSON and TOML manifests, tags in comments, its name.

JSON must be valid as a whole, and only strings count in it. Of TOML the [package] table is read: basic strings, and arrays
of them over any number of lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardwell.functions.files import stem
from shardwell.functions.text import lines

# Licenses by the first of these words that the text has.
LICENSES = {"MIT": "MIT", "Apache": "Apache-2.0", "GPL": "GPL-3.0", "BSD": "BSD-2-Clause", "ISC": "ISC"}
BLANK = r"^\s+|\s+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def parsed(content: Column) -> Column:
    """The object that a JSON text is; null if it is none. (Within brackets, as the parser stops at the end of the first value.)"""
    own = _trim(content)
    likely = F.when(F.startswith(own, F.lit("{")) & F.endswith(own, F.lit("}")), content)  # others cost an error each
    within = F.try_parse_json(F.concat(F.lit("["), likely, F.lit("]")))
    return F.when(F.try_variant_get(within, "$[1]", "variant").isNull(), F.try_variant_get(within, "$[0]", "variant"))


def json_string(doc: Column, path: str) -> Column:
    """The string at a path of a parsed JSON text; null if it is none."""
    found = F.try_variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", found.cast("string"))


def json_strings(doc: Column, path: str) -> Column:
    """The strings of an array at a path of a parsed JSON text; empty if it is none."""
    found = F.try_variant_get(doc, path, "array<variant>")
    return F.coalesce(F.transform(F.filter(found, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string")), F.array().cast("array<string>"))


def _package(content: Column) -> Column:
    return F.regexp_extract(content, r"(?ms)^\[package\][ \t]*$(.*?)(?=^\[|\z)", 1)


def toml_string(content: Column, key: str) -> Column:
    found = F.regexp_extract(_package(content), rf'(?m)^[ \t]*{key}[ \t]*=[ \t]*"((?:[^"\\\n]|\\.)*)"', 1)
    return F.nullif(F.regexp_replace(found, r'\\(["\\])', "$1"), F.lit(""))


def toml_strings(content: Column, key: str) -> Column:
    inside = F.regexp_extract(_package(content), rf"(?ms)^[ \t]*{key}[ \t]*=[ \t]*\[((?:[^\]\"]|\"[^\"\n]*\")*)\]", 1)
    return F.regexp_extract_all(inside, F.lit(r'"([^"\n]*)"'), 1)


# doc, below: the content as parsed() gives it, a column of its own where several of these are asked, so that a text is parsed once


def title(content: Column, path: Column, doc: Column) -> Column:
    """The first `# ` line, the name of a JSON manifest, that of a TOML package, or the file's stem."""
    heading = F.get(F.filter(lines(content), lambda x: F.startswith(x, F.lit("# "))), 0)
    return F.coalesce(_trim(F.regexp_replace(heading, "^(# )+", "")), json_string(doc, "$.name"), toml_string(content, "name"), stem(path))


def description(content: Column, doc: Column) -> Column:
    """The first line after the first `# ` line that has text and no # in front, or the description of a JSON manifest."""
    each = lines(content)
    start = F.filter(F.transform(each, lambda x, i: F.when(F.startswith(x, F.lit("# ")), i)), lambda i: i.isNotNull())
    after = F.filter(F.slice(each, F.coalesce(F.get(start, 0), F.size(each)) + 2, F.size(each) + 1), lambda x: (_trim(x) != "") & ~F.startswith(x, F.lit("#")))
    return F.coalesce(_trim(F.get(after, 0)), json_string(doc, "$.description"))


def keywords(doc: Column) -> Column:
    return json_strings(doc, "$.keywords")


def authors(content: Column, doc: Column) -> Column:
    """Author and contributors of a JSON manifest, then the authors of a TOML package."""
    one = json_string(doc, "$.author")
    first = F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.concat(first, json_strings(doc, "$.contributors"), toml_strings(content, "authors"))


def tags(content: Column) -> Column:
    """Parts of all `@tag:` and `@tags:` lists."""
    lists = F.regexp_extract_all(content, F.lit(r"@tags?\s*:\s*([^\n]+)"), 1)
    return F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ",", -1))), _trim)


def license_name(content: Column, doc: Column) -> Column:
    named = reduce(lambda out, x: out.when(F.contains(content, F.lit(x[0])), x[1]), LICENSES.items(), F.when(F.lit(False), ""))
    return F.coalesce(named, json_string(doc, "$.license"))
