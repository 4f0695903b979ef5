"""Build plans: which representation of a node is taken, how it is transformed, and from what inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms that preferences name, and the transforms of forms.
FORMS = {"ir": "intermediate", "embed": "intermediate"}
COMPILED, FETCHED = ("source", "intermediate"), ("binary", "container")


def form_of(preference: Column) -> Column:
    out = preference
    for name, form in FORMS.items():
        out = F.when(preference == name, form).otherwise(out)
    return out


def chosen(representations: Column, preferred: Column, prefer: Column, platform: Column) -> Column:
    """The first representation (form, architecture, chunk) of the node's preferred form; of the first form of the target's list that
    there is; of the platform's architecture; the first of all."""
    first = lambda test: F.get(F.filter(representations, test), 0)
    listed = F.transform(prefer, lambda p: F.get(F.filter(representations, lambda r: r["form"] == form_of(p)), 0))
    return F.coalesce(first(lambda r: r["form"] == form_of(preferred)), F.get(F.filter(listed, lambda r: r.isNotNull()), 0), first(lambda r: r["architecture"] == platform), F.get(representations, 0))


def steps(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """id, form, transform, inputs (array of role and chunk) of each node.

    nodes: id, representations, preferred, prefer, platform, source, ir, blob; deps: id, pos, dep. Dependencies are counted on as
    `pending:<id>`, in order of pos.
    """
    own = nodes.withColumn("r", chosen(F.col("representations"), F.col("preferred"), F.col("prefer"), F.col("platform")))
    form = F.col("r.form")
    compile_ = F.concat(F.lit("compile:"), F.col("platform"))
    transform = F.when(form.isin(*COMPILED), compile_).when(form.isin(*FETCHED), "custom:fetch").when(F.col("source").isNotNull() | F.col("ir").isNotNull(), compile_).otherwise("bundle:default")
    main = F.when(F.col("r").isNotNull(), F.col("r.chunk")).otherwise(F.coalesce("source", "ir", "blob"))
    pending = deps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dep"))), lambda x: F.struct(F.lit("dependency").alias("role"), F.concat(F.lit("pending:"), x["dep"]).alias("chunk"))).alias("pending"))
    none = F.array().cast("array<struct<role: string, chunk: string>>")
    first = F.when(main.isNotNull(), F.array(F.struct(F.lit("main").alias("role"), main.alias("chunk")))).otherwise(none)
    joined = own.withColumn("first", first).withColumn("transform", transform).join(pending, "id", "left")
    return joined.select("id", form.alias("form"), "transform", F.concat("first", F.coalesce("pending", none)).alias("inputs"))
