"""Readers, writers, extensions and streams."""

import datetime as dt

from pyspark.sql import functions as F

from shardwell.functions import extensions
from shardwell.sources import schemas
from shardwell.streaming import ingest


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"hello")
    (tmp_path / "in" / "deep" / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "c.md").write_bytes(b"# no")
    files = schemas.read_files(spark, str(tmp_path / "in"), "*.txt")
    assert {r.encoding for r in files.collect()} == {"utf-8", "unknown"} and files.count() == 2
    rows = files.select(F.sha2("content", 256).alias("hash"), "text")
    schemas.write_chunks(rows, str(tmp_path / "store"))
    want = rows.filter("text = 'hello'").first()["hash"]
    found = schemas.read_chunk(spark, str(tmp_path / "store"), want)
    assert [r.text for r in found.collect()] == ["hello"]
    assert "PartitionFilters: [isnotnull(shard" in found._jdf.queryExecution().toString()
    schemas.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_registries():
    text = '{"registries": [{"id": "b", "priority": 2}, {"id": "a", "priority": 1}, {"id": "c", "enabled": false}]}'
    assert [r["id"] for r in schemas.registries(text)] == ["a", "b"]


def test_extensions(spark):
    loader = extensions.Loader()
    bad = loader.load([extensions.Manifest("x", "X", "1", "atomizer"), extensions.Manifest("y", "", "1", "nothing")])
    assert bad == ["y"] and [m.id for m in loader.of_kind("atomizer")] == ["x"]
    assert loader.unload("x") and not loader.unload("x")
    extensions.register(spark, ["python"])
    rows = spark.sql("SELECT name, kind FROM VALUES ('def f(a):\\n  b\\nclass C:\\n  d\\n') AS t(s), LATERAL atoms_python(s)").collect()
    assert {tuple(r) for r in rows} == {("f", "function"), ("C", "class")}


def test_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", at), ("a", at), ("b", at)], "text string, arrived timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.chunk_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    ingest.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("text").distinct().count() == 2 == spark.read.parquet(str(tmp_path / "out")).count()


def test_embedding_store(spark, tmp_path):
    from shardwell.sources import embeddings

    first = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 0.25])], embeddings.SCHEMA)
    embeddings.save(first, str(tmp_path / "store"))
    store = embeddings.load(spark, str(tmp_path / "store"))
    assert embeddings.get(store, "b") == [0.5, 0.25] and embeddings.get(store, "c") is None
    more = embeddings.insert(store, spark.createDataFrame([("b", [9.0]), ("c", [8.0])], embeddings.SCHEMA))
    assert {r.chunk_id: list(r.embedding) for r in more.collect()} == {"a": [1.0, 2.0], "b": [9.0], "c": [8.0]}


def test_rows_that_become_texts_are_dealt_over_tasks(spark, tmp_path):
    """A table of one row group is one task by its files; the texts made of its rows are worked on in as many as they need."""
    from shardwell.plans.extraction import rust
    from shardwell.sources.code_files import code_files

    spark.range(12_000).selectExpr("id AS p_partkey", "'n' AS p_name", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (code_files(spark, str(tmp_path)), rust(spark, str(tmp_path))):
        rows = made.select("p_partkey", F.spark_partition_id().alias("at")).groupBy("at").count().collect()
        assert len(rows) == 3 and sum(r["count"] for r in rows) == 12_000 and max(r["count"] for r in rows) < 6_000


def test_distinct_pairs_are_found_in_tasks_that_grow_with_the_rows(spark, tmp_path):
    """One file and few shuffle partitions don't make few tasks."""
    from shardwell.sources import corpus

    for name, columns in {"nation": "0 AS n_nationkey, 0 AS n_regionkey", "customer": "0 AS c_custkey, 0 AS c_nationkey", "supplier": "0 AS s_suppkey, 0 AS s_nationkey", "orders": "0 AS o_orderkey, 0 AS o_custkey"}.items():
        spark.range(1).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.range(1_500_000).selectExpr("id % 1400000 AS l_orderkey", "1 AS l_partkey", "id % 5 AS l_suppkey")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    e = corpus.edges(spark, str(tmp_path)).filter("edge_type = 'calls'")
    assert e.count() == 1_400_000 and e.select(F.spark_partition_id()).distinct().count() == 15
