"""URL filtering by host-suffix and path-prefix expressions. Native: DataFrame functions only.

A URL expands into every suffix of its host (cut at dots) combined with those prefixes of its path whose length some
rule has. Expressions meet rules in an equi-join on the first bytes of their SHA-256 digests; the full digest then
confirms the match, and the longest rule wins. A rule's host counts before its path where lengths tie.

Defined results: a null URL, or one without "://", has empty host and path and takes the default verdict; repeated
rows each get a row; equal rules with different actions block; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_groups, lower_ascii

#: Hex digits of the digest that the join looks at.
SHORT = 8
#: A rule table of at most this many rows (about 200 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_RULES = 20_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """rules: (action, host, path)."""
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The columns of pages, with host, path, rule and verdict; columns of those names in pages are replaced."""
    spark = pages.sparkSession
    rules = rules.groupBy(lower_ascii(F.col("rule_host")).alias("rule_host"), "rule_path").agg(F.max("action").alias("action"))  # "block" > "allow"
    rules = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256))
    # The path lengths that rules have: one row each, as long as paths are in rules at most.
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0

    base = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    key, own = free_name(pages, "place"), F.col(url_col)
    urls = pages.select(*base, host_of(own).alias("host"), path_of(own).alias("path"))
    urls = urls.withColumn(key, F.concat("host", F.lit("#"), "path"))  # neither part has a "#"
    places = urls.groupBy(F.col(key).alias("k")).agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("n"))  # a busy place goes on once
    dots = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(dots), F.lit(max(labels, 1)))), lambda n: F.array_join(F.slice(dots, F.size(dots) - n + 1, n), "."))
    prefixes = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull()))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    probes = places.select("k", F.explode(expressions).alias("expression")).select("k", F.sha2("expression", 256).alias("full"))
    probes = probes.withColumn("short", F.substring("full", 1, SHORT))
    table = rules.withColumn("short", F.substring("digest", 1, SHORT)).select("short", "digest", "rule", "action", "rule_host")
    if rules.count() <= BROADCAST_RULES:
        table = F.broadcast(table)
    met = probes.join(table, "short").filter(F.col("full") == F.col("digest"))
    best = met.groupBy("k").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("action"), F.col("rule").alias("rule"))).alias("best"))
    judged = places.select("k", "n").join(best, "k", "left").select(F.col("k").alias(key), F.col("n").alias(f"{key}_n"), F.col("best.rule").alias(f"{key}_rule"), F.col("best.action").alias(f"{key}_action"))
    total = pages.count()
    out = join_groups(urls, judged, key, f"{key}_n", F.xxhash64(*[F.col(c).cast("string") for c in base]).cast("string"), total)
    return out.select(*base, "host", "path", F.col(f"{key}_rule").alias("rule"), F.coalesce(f"{key}_action", F.lit(default)).alias("verdict"))
