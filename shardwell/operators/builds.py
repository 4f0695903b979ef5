"""Build specs, plans, their execution and trust.

components: spec, id, kind (reuse, generate, search), source, query, depends_on (array). targets: spec, target, components
(array). Everything of one spec is judged by grouping, so specs run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def problems(specs: DataFrame, components: DataFrame, targets: DataFrame) -> DataFrame:
    """spec, problem: the first thing that is wrong with each spec (name, min_reuse), null if nothing is."""
    known = components.groupBy("spec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    twice = components.groupBy("spec", "id").count().filter("count > 1").groupBy("spec").agg(F.min("id").alias("twice"))
    in_spec = lambda rows, wanted: rows.select("*", F.explode(wanted).alias("wanted")).join(known, "spec", "left").filter(~F.coalesce(F.array_contains("ids", F.col("wanted")), F.lit(False)))
    lost = in_spec(targets, F.col("components")).groupBy("spec").agg(F.min(F.struct("target", "wanted")).alias("lost"))
    loose = in_spec(components.filter("kind = 'generate'").select("spec", "id", "depends_on"), F.col("depends_on")).groupBy("spec").agg(F.min(F.struct("id", "wanted")).alias("loose"))
    rows = specs.join(twice, "spec", "left").join(lost, "spec", "left").join(loose, "spec", "left")
    says = F.coalesce(
        F.when(F.col("name") == "", "Project name is required"),
        F.when(F.col("twice").isNotNull(), F.concat(F.lit("Duplicate component ID: "), "twice")),
        F.when(F.col("lost").isNotNull(), F.concat(F.lit("Target '"), F.col("lost.target"), F.lit("' references undefined component '"), F.col("lost.wanted"), F.lit("'"))),
        F.when(F.col("loose").isNotNull(), F.concat(F.lit("Component '"), F.col("loose.id"), F.lit("' depends on undefined '"), F.col("loose.wanted"), F.lit("'"))),
        F.when((F.col("min_reuse") < 0) | (F.col("min_reuse") > 100), "min_reuse_percentage must be 0-100"),
    )
    return rows.select("spec", says.alias("problem"))


def resolved(components: DataFrame, found: DataFrame) -> DataFrame:
    """Components with chunk: their source, or the best match of their query (found: query, chunk); error where there is none."""
    best = found.groupBy("query").agg(F.max_by("chunk", F.struct("score", F.col("chunk"))).alias("best"))
    out = components.join(best, "query", "left").withColumn("chunk", F.when(F.col("kind") == "reuse", F.col("source")).when(F.col("kind") == "search", F.col("best")))
    return out.drop("best").withColumn("error", F.when((F.col("kind") == "search") & F.col("chunk").isNull(), F.concat(F.lit("No results found for query: "), "query")))


def manifest_nodes(resolved_: DataFrame) -> DataFrame:
    """spec, id, chunk, strategy; what is to be generated has neither."""
    how = F.when(F.col("kind") == "reuse", "prefer_source").when(F.col("kind") == "search", "best_match")
    return resolved_.filter("error IS NULL").select("spec", "id", "chunk", how.alias("strategy"))


def manifest_edges(components: DataFrame) -> DataFrame:
    rows = components.filter("kind = 'generate'").select("spec", F.col("id").alias("src"), F.explode("depends_on").alias("dst"))
    return rows.withColumn("relation", F.lit("depends_on"))


def plan(resolved_: DataFrame) -> DataFrame:
    """spec, reuse (id=chunk), generate (id), error: the lists of a plan; a search without a result ends it."""
    listed = lambda c, kinds: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), c)))
    rows = resolved_.groupBy("spec").agg(listed(F.concat("id", F.lit("="), "chunk"), ("reuse", "search")).alias("reuse"), listed(F.col("id"), ("generate",)).alias("generate"), F.min("error").alias("error"))
    none = F.array().cast("array<string>")
    return rows.select("spec", *(F.when(F.col("error").isNull(), F.col(c)).otherwise(none).alias(c) for c in ("reuse", "generate")), "error")


def execute(steps: DataFrame, cached: Column, fails: Column, fail_fast: bool = True) -> DataFrame:
    """Steps (plan, n) with result: cached, built or failed, in order; with fail_fast none after the first failure."""
    rows = steps.withColumn("result", F.when(cached, "cached").when(fails, "failed").otherwise("built"))
    if not fail_fast:
        return rows
    before = F.coalesce(F.max((F.col("result") == "failed").cast("int")).over(Window.partitionBy("plan").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).filter("_before = 0").drop("_before")


def effective(policy: Column, defaults: Column) -> Column:
    """struct(minimum_signatures, attestation_types, signers, max_age_days): what the target sets, else the defaults."""
    one = lambda f: F.coalesce(policy[f], defaults[f]).alias(f)
    types = F.when(F.size(F.coalesce(policy["attestation_types"], F.array().cast("array<string>"))) > 0, policy["attestation_types"]).otherwise(defaults["attestation_types"])
    return F.struct(one("minimum_signatures"), types.alias("attestation_types"), one("signers"), one("max_age_days"))


def violation(policy: Column, signatures: Column, receipt: Column) -> Column:
    """What a chunk breaks first, null if it is trusted. receipt: struct(attestations, signer, age_days), null if missing."""
    least = F.coalesce(policy["minimum_signatures"], F.lit(1))
    lacking = F.get(F.filter(F.coalesce(policy["attestation_types"], F.array().cast("array<string>")), lambda t: ~F.array_contains(receipt["attestations"], t)), 0)
    signed = policy["signers"].isNull() | F.coalesce(F.array_contains(policy["signers"], receipt["signer"]), F.lit(False))
    demanded = (F.size(F.coalesce(policy["attestation_types"], F.array().cast("array<string>"))) > 0) | policy["minimum_signatures"].isNotNull()
    with_receipt = F.when(lacking.isNotNull(), F.concat(F.lit("missing attestation "), lacking)).when(~signed, "missing required signer").when(receipt["age_days"] > policy["max_age_days"], "signature too old")
    return F.when(signatures < least, "too few signatures").when(receipt.isNull(), F.when(demanded, "missing build receipt")).otherwise(with_receipt)
