"""Assembly of pieces into views under a token budget.

Atoms are rows of (view, pos, chunk_id, alias, granularity, language, content, symbols). A view puts them in order, takes
them until the first that would exceed the budget, and gives each its lines, behind a separator if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwell.functions import code
from shardwell.functions.text import lines, token_estimate
from shardwell.operators.edge_types import AUTO_EXPAND
from shardwell.operators.graph import cut_lineage
from shardwell.operators.storage import running_within

# What comes first in a view, and how signatures are found and ended.
RANK = {"import": 0, "type": 1, "struct": 1, "interface": 1, "enum": 1, "trait": 2, "constant": 3, "function": 4, "async_function": 4, "class": 5, "module": 6}
SIGNATURES = {
    "rust": [(r"(?m)^(\s*)(?:pub(?:\([^)]*\))?\s+)?(async\s+)?fn\s+\w+[^{]+\{", r"^\s+|\s*\{+\s*$", ";\n"), (r"(?m)^(?:pub(?:\([^)]*\))?\s+)?struct\s+\w+[^{]*\{[^}]+\}", "(?!)", "\n")],
    "typescript": [(r"(?m)^(?:export\s+)?(?:async\s+)?function\s+\w+\([^)]*\)[^{]*", r"^\s+|\s+$", ";\n"), (r"(?m)^(?:export\s+)?interface\s+\w+[^{]*\{[^}]+\}", "(?!)", "\n")],
    "python": [(r"(?m)^(\s*)(?:async\s+)?def\s+\w+\([^)]*\)(?:\s*->\s*[^:]+)?:", ":+$", ": ...\n")],
}


@dataclass(frozen=True)
class ViewConfig:
    max_tokens: int = 4000
    sort_by_type: bool = True
    add_separators: bool = True
    format: str = "source"
    expansion_depth: int = 0


def rank(granularity: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in RANK.items():
        out = out.when(granularity == k, v)
    return out.otherwise(10)


def signature_text(content: Column, language: Column) -> Column:
    """The signatures of a source, a line each; of a language without patterns the source itself."""

    def found(pattern: str, bare: str, end: str) -> Column:
        return F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.regexp_replace(x, bare, ""), F.lit(end)))

    out = content
    for name, kinds in SIGNATURES.items():
        parts = [found(*k) for k in kinds]
        out = F.when(language == name, F.array_join(F.concat(*parts), "")).otherwise(out)
    return out


def formatted(content: Column, language: Column, form: str) -> Column:
    """Only two formats change the text."""
    if form == "minimal":
        return code.minimize(content)
    return signature_text(content, language) if form == "signatures" else content


def fragments(atoms: DataFrame, config: ViewConfig = ViewConfig()) -> DataFrame:
    """The atoms that fit, with place, tokens, running (tokens), text, separator, start_line and end_line.

    The language of a view is that of its first atom before sorting. Separators stand before all atoms but the first.
    """
    first = Window.partitionBy("view").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = atoms.withColumn("view_language", F.first("language").over(first))
    order = [rank(F.col("granularity")).alias("r"), "pos"] if config.sort_by_type else ["pos"]
    kept = running_within(rows, ["view"], order, token_estimate(F.col("content")), config.max_tokens)
    kept = kept.withColumn("tokens", token_estimate(F.col("content"))).withColumn("text", formatted(F.col("content"), F.col("view_language"), config.format))
    w = Window.partitionBy("view").orderBy(*order)
    kept = kept.withColumn("place", F.row_number().over(w) - 1)
    mark = F.when(F.col("view_language") == "python", "#").otherwise("//")
    label = F.concat(mark, F.lit(" --- "), F.coalesce("alias", "chunk_id"), F.lit(" ---\n"))
    kept = kept.withColumn("separator", F.when((F.col("place") > 0) & F.lit(config.add_separators), label).otherwise(""))
    n, extra = F.size(lines(F.col("text"))), (F.col("separator") != "").cast("int")
    before = F.coalesce(F.sum(n + 1 + extra).over(Window.partitionBy("view").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn("start_line", (before + extra + 1).cast("int")).withColumn("end_line", (F.col("start_line") + n - 1).cast("int"))


def assemble(atoms: DataFrame, config: ViewConfig = ViewConfig()) -> DataFrame:
    """One row a view: text, n_atoms, tokens, truncated (the budget is used up), language, symbols (name -> first line of
    the last atom that defines it)."""
    kept = fragments(atoms, config)
    body = F.concat("separator", "text", F.when(F.endswith("text", F.lit("\n")), "\n").otherwise("\n\n"))
    rows = kept.groupBy("view").agg(
        F.array_sort(F.collect_list(F.struct("place", body.alias("body"), "start_line", "symbols"))).alias("p"),
        F.count("*").alias("n_atoms"),
        F.sum("tokens").alias("tokens"),
        F.first("view_language").alias("language"),
    )
    pairs = F.flatten(F.transform("p", lambda x: F.transform(x["symbols"], lambda s: F.struct(s.alias("symbol"), x["start_line"].alias("line")))))
    last = F.transform(F.array_distinct(F.transform(pairs, lambda x: x["symbol"])), lambda s: F.struct(s, F.element_at(F.filter(pairs, lambda x: x["symbol"] == s), -1)["line"]))
    return rows.select("view", F.array_join(F.transform("p", lambda x: x["body"]), "").alias("text"), "n_atoms", "tokens", (F.col("tokens") >= config.max_tokens).alias("truncated"), "language", F.map_from_entries(last).alias("symbols"))


def expanded(requested: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """view, node, depth: what was asked for (view, node) and what it leads to by the types that views follow."""
    follow = edges.filter(F.col("edge_type").isin(AUTO_EXPAND)).select("src", "dst")
    frontier = seen = cut_lineage(requested.select("view", "node").distinct().withColumn("depth", F.lit(0)))
    for k in range(1, depth + 1):
        step = frontier.join(follow, frontier["node"] == follow["src"]).select("view", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["view", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def view(requested: DataFrame, nodes: DataFrame, edges: DataFrame, config: ViewConfig = ViewConfig()) -> DataFrame:
    """Views of requested nodes (view, node), expanded as the config says; nodes without content are left out. What was
    asked for comes first, then by depth and id (the reference leaves the order open)."""
    chosen = expanded(requested, edges, config.expansion_depth)
    atoms = chosen.join(nodes.filter("content IS NOT NULL").withColumnRenamed("chunk_id", "node"), "node").withColumnRenamed("node", "chunk_id")
    pos = F.row_number().over(Window.partitionBy("view").orderBy("depth", "chunk_id"))
    return assemble(atoms.withColumn("pos", pos), config)


def of_symbols(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """view, node: the node that defines each wanted symbol (view, symbol); of several the one with the largest id."""
    index = nodes.select(F.explode("symbols").alias("symbol"), F.col("chunk_id").alias("node")).groupBy("symbol").agg(F.max("node").alias("node"))
    return wanted.join(index, "symbol").select("view", "node")
