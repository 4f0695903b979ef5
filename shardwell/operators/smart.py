"""The smart chunker: what a file is, how it is cut, and its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.functions import code, files
from shardwell.functions.text import chunk_id, kebab_case, lines

# The least lines of a file that is cut and of an entity of its own, the lines of one chunk at most, and
# what an entity is as a chunk.
SPLIT_LINES, ENTITY_LINES, CHUNK_LINES = 50, 10, 500
GRANULARITY = {"function": "function", "async_function": "function", "method": "function", "struct": "type", "class": "type", "trait": "type", "interface": "type", "enum": "type", "module": "module", "import": "import"}


def analyze(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The rows with language, lines, entities, imports, exports, is_entrypoint, is_test, is_config, frameworks and category."""
    p, c = F.col(path), F.col(content)
    rows = docs.withColumn("language", files.language_of(p)).withColumn("lines", lines(c)).withColumn("entities", code.entity_column(F.col("language"), c))
    language = F.col("language")
    shown = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: F.when(language == "go", F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit('"'))).when(language == "python", F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit("from "))).when(language.isin(*files.JS), F.startswith(x, F.lit("import "))).when(language == "rust", F.startswith(x, F.lit("use "))).otherwise(F.lit(False)))
    bare = F.transform(shown, lambda x: F.when(language == "rust", F.regexp_replace(F.regexp_replace(x, "^(use )+", ""), ";+$", "")).otherwise(x))
    rows = rows.withColumns({"imports": bare, "exports": F.transform(F.filter("entities", lambda e: e["visibility"] == "public"), lambda e: e["name"]), "is_entrypoint": files.is_entrypoint(p, c, language), "is_test": files.is_test(p, c, language), "is_config": files.is_config(p), "frameworks": files.frameworks(c, language)})
    return rows.withColumn("category", files.category(p, F.transform("entities", lambda e: e["kind"]), F.col("is_test"), F.col("is_config")))


def decide(analysis: DataFrame, prefer_atomic: bool = False) -> DataFrame:
    """The rows with their strategy: atomic, by_entity or hierarchical."""
    n, known = F.size("lines"), F.size("entities")
    large = F.size(F.filter("entities", lambda e: e["end_line"] - e["start_line"] >= ENTITY_LINES))
    rest = F.lit("atomic" if prefer_atomic else "by_entity")
    ladder = F.when(n < SPLIT_LINES, "atomic").when(F.col("is_config"), "atomic").when(known == 1, "atomic").when((known > 1) & (large >= 2), "by_entity").when(n > CHUNK_LINES, "hierarchical").otherwise(rest)
    return analysis.withColumn("strategy", ladder)


def chunks(decided: DataFrame, key: str, path: str = "path") -> DataFrame:
    """A row a chunk: key, name, alias, granularity, start_line, end_line, content, chunk_id, provides, requires."""
    p = F.col(path)
    whole = F.struct(files.stem(p).alias("name"), files.alias_of(p, files.stem(p)).alias("alias"), F.lit("module").alias("granularity"), F.lit(1).alias("start_line"), F.size("lines").alias("end_line"), F.col("exports").alias("provides"), F.col("imports").alias("requires"))
    large = F.filter("entities", lambda e: e["end_line"] - e["start_line"] >= ENTITY_LINES)
    open_ = lambda e: (e["visibility"] == "public") | (e["kind"] == "import")
    none = F.array().cast("array<string>")
    parts = F.transform(large, lambda e: F.struct(e["name"].alias("name"), F.concat(files.stem(p), F.lit("/"), kebab_case(e["name"])).alias("alias"), files.looked_up(e["kind"], GRANULARITY, "function").alias("granularity"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line"), F.when(open_(e), F.array(e["name"])).otherwise(none).alias("provides"), none.alias("requires")))
    every = F.when(F.col("strategy") == "atomic", F.array(whole)).when(F.col("strategy") == "by_entity", parts).otherwise(F.concat(F.array(whole), parts))
    rows = decided.select(key, "lines", F.explode(every).alias("c")).select(key, "lines", "c.*")
    text = F.array_join(F.slice("lines", F.greatest(F.col("start_line"), F.lit(1)), F.least("end_line", F.size("lines")) - F.greatest(F.col("start_line"), F.lit(1)) + 1), "\n")
    return rows.withColumn("content", text).withColumn("chunk_id", chunk_id(F.col("content"))).drop("lines")
