"""Column functions on text: lines, identity, sizes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "chunk:sha256:"


def lines(c: Column) -> Column:
    """Lines without their ends: cut at line feeds, a trailing carriage return dropped, no empty line at the end."""
    cut = F.split(c, "\n")
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return F.transform(cut, lambda x: F.regexp_replace(x, "\r$", ""))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def chunk_id(c: Column) -> Column:
    return F.concat(F.lit(PREFIX), sha256(c))


def parse_chunk_id(c: Column) -> Column:
    """The hash of an id, null if it is no id."""
    return F.when(F.startswith(c, F.lit(PREFIX)), F.substring(c, F.lit(len(PREFIX) + 1), F.length(c)))


def verify(content: Column, id_: Column) -> Column:
    return F.coalesce(sha256(content) == parse_chunk_id(id_), F.lit(False))


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(c) / 4).cast("long")


def kebab_case(c: Column) -> Column:
    dashed = F.lower(F.regexp_replace(c, "(?<!^)([A-Z])", "-$1"))
    return F.replace(F.translate(dashed, "_ ", "--"), F.lit("--"), F.lit("-"))


def human_bytes(c: Column) -> Column:
    """Bytes in the largest unit that fits, to two decimals, halves to even."""

    def shown(unit: int, name: str) -> Column:
        n = F.bround(c.cast("decimal(20,0)") / F.lit(unit).cast("decimal(10,0)"), 2)
        return F.concat(n.cast("decimal(20,2)").cast("string"), F.lit(f" {name}"))

    return F.when(c >= 1024**3, shown(1024**3, "GB")).when(c >= 1024**2, shown(1024**2, "MB")).when(c >= 1024, shown(1024, "KB")).otherwise(F.concat(c.cast("string"), F.lit(" B")))


def lenient_verify(found: Column, given: Column) -> Column:
    """Whether either of two hashes begins with the other."""
    return F.startswith(found, given) | F.startswith(given, found)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over their common length; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def mentions(c: Column, query: str) -> Column:
    """Whether the lower-cased text has the lower-cased query as a substring."""
    return F.contains(F.lower(c), F.lit(query.lower()))
