"""Scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions import code, metadata
from shardwell.functions import text as t
from shardwell.operators import aliases
from shardwell.sources import corpus
from shardwell.sources.corpus import REGISTRY_SQL, spread, table

COS = "round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 6)"


@query("scal01_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def scal01(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.sha256(F.col("text")).alias("h"))


@query("scal02_chunk_id", "SELECT doc_id, 'chunk:sha256:' || sha256(text) AS id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS parsed FROM documents")
def scal02(spark, sf_dir):
    d = corpus.chunks(spark, sf_dir)
    odd = F.when(F.col("doc_id") % 2 == 0, F.col("chunk_id")).otherwise(F.concat(F.lit("x"), "chunk_id"))
    return d.select("doc_id", F.col("chunk_id").alias("id"), t.parse_chunk_id(odd).alias("parsed"))


@query("scal03_verify", "SELECT doc_id, doc_id % 3 <> 0 AS ok FROM documents")
def scal03(spark, sf_dir):
    d = corpus.chunks(spark, sf_dir)
    return d.select("doc_id", t.verify(F.col("content"), F.when(F.col("doc_id") % 3 == 0, F.lit("bad")).otherwise(F.col("chunk_id"))).alias("ok"))


@query("scal08_alt_hybrid", f"WITH {REGISTRY_SQL} SELECT doc_id, round(0.5 * ((coverage + 1) / 2) + 0.3 * quality + 0.2 * quality, 6) AS score FROM reg")
def scal08(spark, sf_dir):
    return corpus.registry(spark, sf_dir).select("doc_id", F.round(0.5 * ((F.col("coverage") + 1) / 2) + 0.3 * F.col("quality") + 0.2 * F.col("quality"), 6).alias("score"))


@query("scal11_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def scal11(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", F.round(t.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("scal14_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(strlen(p_name), strlen(p_type)), 6) AS similarity FROM part")
def scal14(spark, sf_dir):
    d = F.levenshtein("p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", d.cast("long").alias("distance"), F.round(1 - d / F.greatest(F.octet_length("p_name"), F.octet_length("p_type")), 6).alias("similarity"))


@query("scal16_semantic_hash")
def scal16(spark, sf_dir):
    h = code.semantic_hashes("rust")
    return table(spark, sf_dir, "documents").select("doc_id", h("text").alias("semantic"))


@query("scal20_tokens", "SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents")
def scal20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


def hits(patterns: dict) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in patterns.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("scal22_concepts", f"SELECT doc_id, {hits(code.CONCEPTS)} AS concepts FROM documents")
def scal22(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(code.concepts(F.col("text")), ",").alias("concepts"))


@query("scal23_license", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(text, '{x}') THEN '{x}'" for x in code.LICENSES) + " END AS license FROM documents")
def scal23(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", code.license_of(F.col("text")).alias("license"))


@query("scal24_frameworks", f"SELECT doc_id, {hits(code.FRAMEWORKS)} AS frameworks FROM documents")
def scal24(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(code.concepts(F.col("text"), code.FRAMEWORKS), ",").alias("frameworks"))


@query("scal25_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def scal25(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("scal27_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scal27(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("scal29_text_metadata", "SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def scal29(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.split("text", "\n")[0]).alias("title"), F.octet_length("text").cast("long").alias("size"))


@query("scal37_kebab", "SELECT p_partkey, replace(translate(lower(substr(p_brand, 1, 1) || regexp_replace(substr(p_brand, 2), '([A-Z])', '-\\1', 'g')), '_ ', '--'), '--', '-') AS kebab FROM part")
def scal37(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.kebab_case(F.col("p_brand")).alias("kebab"))


@query("scal39_unique_alias", "SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '-' || (n - 1) END AS alias FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def scal39(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    p = table(spark, sf_dir, "part").withColumn("n", n)
    return p.select("p_partkey", F.when(F.col("n") == 1, F.col("p_name")).otherwise(F.concat_ws("-", "p_name", (F.col("n") - 1).cast("string"))).alias("alias"))


def alias_arrivals(spark, sf_dir):
    """Parts in order of their keys; every third asks for a name that another's number would give."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("t"), "p_name")
    return p.select("t", F.when(F.col("t") % 3 == 0, F.concat_ws("-", "p_name", (F.col("t") % 11 + 1).cast("string"))).otherwise(F.col("p_name")).alias("base"))


@query("scal39_aliases")
def scal39_aliases(spark, sf_dir):
    """After used names (of suppliers' numbers) and reserved ones; no SQL, the loop is one over all arrivals."""
    p = table(spark, sf_dir, "part")
    used = p.filter("p_partkey % 5 = 0").select(F.concat_ws("-", "p_name", (F.col("p_size") % 7 + 1).cast("string")).alias("alias"))
    return aliases.unique(alias_arrivals(spark, sf_dir), used).select(F.col("t").alias("p_partkey"), "base", "alias")


@query("scal45_snippet", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents")
def scal45(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n").alias("snippet"))


@query("scal47_keyed_hash", "SELECT doc_id, 'sig:sha256:' || sha256('secret' || text) AS signature FROM documents")
def scal47(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("sig:sha256:"), F.sha2(F.concat(F.lit("secret"), "text"), 256)).alias("signature"))


@query("scal49_age", "SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2001-01-01') > 700 AS too_old FROM orders")
def scal49(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.datediff(F.lit("2001-01-01").cast("date"), F.col("o_orderdate").cast("date")) > 700).alias("too_old"))


@query("scal50_representation", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'binary' WHEN o_orderpriority = '1-URGENT' THEN 'ir' ELSE 'source' END AS form FROM orders")
def scal50(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderstatus") == "F", "binary"), F.when(F.col("o_orderpriority") == "1-URGENT", "ir"), F.lit("source")).alias("form"))


@query(
    "scal25_manifests",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN 'part' || p_partkey ELSE p_name END AS title,
      CASE WHEN p_partkey % 5 IN (0, 1) THEN p_type END AS description, CASE p_partkey % 5 WHEN 1 THEN p_brand || '|' || ('s' || p_size) ELSE '' END AS keywords,
      CASE p_partkey % 5 WHEN 1 THEN ('maker ' || p_size) || '|' || p_brand WHEN 2 THEN ('maker ' || p_size) || '|' || p_type ELSE '' END AS authors,
      CASE WHEN p_partkey % 5 IN (0, 3) THEN p_brand || '|' || ('s' || p_size) || '|x' ELSE '' END AS tags, CASE p_partkey % 5 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'of ' || p_brand WHEN 3 THEN 'MIT' END AS license FROM part""",
)
def scal25_manifests(spark, sf_dir):
    """Every part as a readme, a JSON or TOML manifest, a commented file with a heading, or broken JSON; read back from its text."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), "p_partkey").withColumn("size", F.concat(F.lit("s"), F.col("p_size").cast("string"))).withColumn("maker", F.concat(F.lit("maker "), F.col("p_size").cast("string")))
    say = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))
    c = F.col
    readme = say("intro\n# ", c("p_name"), "  \n\n## more\n  ", c("p_type"), " \n# Later\nother\nUnder Apache\n// @tags: ", c("p_brand"), " , ", c("size"), "\n@tag:x\n")
    strings = F.to_json(F.struct(c("p_name").alias("name"), c("p_type").alias("description"), F.array("p_brand", "size").alias("keywords"), c("maker").alias("author"), F.array("p_brand").alias("contributors"), say("of ", c("p_brand")).alias("license")))
    mixed = F.replace(strings, F.lit('"keywords":['), F.lit('"keywords":[1,null,{"a":"b"},'))
    toml = say('[deps]\nname = "no"\n[package]\nname = "', c("p_name"), '"\nauthors = [\n  "', c("maker"), '",\n  "', c("p_type"), '"\n]\n[other]\nauthors = ["no"]\n')
    code_ = say("/* MIT\n * @tags: ", c("p_brand"), ",", c("size"), ", x\n */\n# ", c("p_name"))
    broken = say('{"name": "', c("p_name"), '", "keywords": ["a"], ')
    content = F.element_at(F.array(readme, mixed, toml, code_, broken), (c("p_partkey") % 5 + 1).cast("int"))
    rows = p.select("p_partkey", content.alias("content"), say("src/part", c("p_partkey").cast("string"), ".txt").alias("path")).withColumn("doc", metadata.parsed(F.col("content")))
    m, doc, joined = F.col("content"), F.col("doc"), lambda x: F.array_join(x, "|")
    return rows.select("p_partkey", metadata.title(m, F.col("path"), doc).alias("title"), metadata.description(m, doc).alias("description"), joined(metadata.keywords(doc)).alias("keywords"), joined(metadata.authors(m, doc)).alias("authors"), joined(metadata.tags(m)).alias("tags"), metadata.license_name(m, doc).alias("license"))
