"""Searches, top-k, ordering and budgets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.operators import search
from shardwell.operators.storage import running_within
from shardwell.sources import corpus
from shardwell.sources.corpus import REGISTRY_SQL, table

TEXT = """least((CASE WHEN contains(lower(name), 'the') THEN 0.4 ELSE 0.0 END + CASE WHEN contains(lower(description), 'the') THEN 0.3 ELSE 0.0 END
  + CASE WHEN contains(lower(language), 'the') THEN 0.1 ELSE 0.0 END)::DOUBLE * (0.5 + 0.5 * quality) * (0.8 + 0.2 * coverage), 1.0::DOUBLE)"""
REG = "CASE WHEN contains(lower(name), 'the') AND contains(lower(description), 'the') THEN 1.0::DOUBLE WHEN contains(lower(name), 'the') OR contains(lower(description), 'the') THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END"
COS = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"


@query("topk01_text_search", f"WITH {REGISTRY_SQL} SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {TEXT} AS score FROM reg) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def topk01(spark, sf_dir):
    hits = search.text_hits(corpus.registry_index(spark, sf_dir), "the", corpus.marks(spark, sf_dir), concepts=False)
    return search.top(hits, "score", 20).select("doc_id", F.round("score", 6).alias("score"))


TAGGED = f"""WITH {REGISTRY_SQL}, t AS (SELECT reg.*, [lang, source] AS concepts FROM reg JOIN documents USING (doc_id))"""
CONCEPTS = "len(list_filter(concepts, lambda x: contains(lower(x), '{q}')))"


@query(
    "scal05_concept_score",
    f"""{TAGGED} SELECT doc_id, round(least((CASE WHEN contains(lower(name), 'en') THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN contains(lower(description), 'en') THEN 0.3::DOUBLE ELSE 0.0 END
      + 0.2::DOUBLE * {CONCEPTS.format(q="en")} + CASE WHEN contains(lower(language), 'en') THEN 0.1::DOUBLE ELSE 0.0 END) * (0.5 + 0.5 * quality) * (0.8 + 0.2 * coverage), 1.0::DOUBLE), 6) AS score
      FROM t WHERE contains(lower(name), 'en') OR contains(lower(description), 'en') OR contains(lower(language), 'en') OR {CONCEPTS.format(q="en")} > 0""",
)
def scal05_concepts(spark, sf_dir):
    """All chunks that mention the query in some field or concept."""
    hits = search.text_hits(corpus.registry_index(spark, sf_dir), "EN", corpus.marks(spark, sf_dir))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query("fil17_by_concept", f"{TAGGED} SELECT doc_id, quality FROM t WHERE contains(lower(description), 'src1') OR {CONCEPTS.format(q='src1')} > 0")
def fil17_by_concept(spark, sf_dir):
    """Chunks whose description or concepts mention the need."""
    keys = corpus.registry_index(spark, sf_dir).find("src1", ("description", "concept")).select(F.col("key").alias("doc_id")).distinct()
    return keys.join(corpus.marks(spark, sf_dir), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0.0)).alias("quality"))


@query("topk02_registry_search", f"WITH {REGISTRY_SQL} SELECT * FROM (SELECT doc_id, {REG} AS score FROM reg) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def topk02(spark, sf_dir):
    return search.top(search.registry_hits(corpus.registry_index(spark, sf_dir), "the"), "score", 20)


def _query_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.crossJoin(F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q"))))


@query("topk03_vector_search", f"SELECT vec_id, {COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def topk03(spark, sf_dir):
    return search.nearest(_query_vector(spark, sf_dir), F.col("q"), 20)


@query(
    "topk04_hybrid_search",
    f"""WITH {REGISTRY_SQL}, t AS (SELECT doc_id, {REG} AS score FROM reg WHERE {REG} > 0 ORDER BY score DESC, doc_id LIMIT 20),
    s AS (SELECT vec_id AS doc_id, {COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20),
    m AS (SELECT doc_id, round(0.3 * coalesce(t.score, 0.0::DOUBLE) + 0.5 * coalesce(s.score, 0.0::DOUBLE) + 0.2 * (0.5 * coalesce(quality, 0.0::DOUBLE) + 0.5 * least(coalesce(coverage, 0.0::DOUBLE), 1.0::DOUBLE)), 6) AS score
          FROM t FULL JOIN s USING (doc_id) LEFT JOIN reg USING (doc_id))
    SELECT * FROM m WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 10""",
)
def topk04(spark, sf_dir):
    t = search.top(search.registry_hits(corpus.registry_index(spark, sf_dir), "the"), "score", 20)
    s = search.nearest(_query_vector(spark, sf_dir), F.col("q"), 20).withColumnRenamed("vec_id", "doc_id")
    return search.hybrid(t, s, corpus.marks(spark, sf_dir), 10, 0.1)


@query(
    "topk07_budget_prefix",
    """WITH s AS (SELECT conv_id, turn, sum(strlen(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM conversations),
    o AS (SELECT *, max(CASE WHEN running > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS over_ FROM s)
    SELECT conv_id, turn, CAST(running AS BIGINT) AS running FROM o WHERE over_ = 0""",
)
def topk07(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return running_within(c, ["conv_id"], ["turn"], F.floor(F.octet_length("text") / 4).cast("long"), 300).select("conv_id", "turn", "running")


@query("topk08_best_registry", "SELECT source, CAST(substr(source, 4) AS INTEGER) AS priority, count(*) AS chunks FROM documents GROUP BY source ORDER BY priority LIMIT 1")
def topk08_all(spark, sf_dir):
    return best_registry(table(spark, sf_dir, "documents"))


def best_registry(documents):
    d = documents.groupBy("source").agg(F.count("*").alias("chunks"))
    return d.withColumn("priority", F.substring("source", 4, 9).cast("int")).orderBy("priority").limit(1)


@query("topk09_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 10 OFFSET 20")
def topk09(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy("p_name", "p_partkey").offset(20).limit(10).select("p_partkey", "p_name")
