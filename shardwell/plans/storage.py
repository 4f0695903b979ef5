"""Scans, stores and sinks."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwell.catalog import query
from shardwell.functions.text import chunk_id, sha256
from shardwell.operators import storage as op
from shardwell.operators import store
from shardwell.operators.collect import ChunkStore
from shardwell.operators.graph_store import GraphStore
from shardwell.sources import corpus, relational
from shardwell.sources.corpus import EDGES_SQL, NODES_SQL, REGISTRY_SQL, table
from shardwell.sources.shared import new_folder, written


@query("src01_read_files", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash FROM documents")
def src01(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size"), sha256(F.col("text")).alias("hash"))


@query("src09_parse_dispatch", "SELECT event_id, CASE WHEN json_valid(props) THEN 'structured' ELSE 'text' END AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src09(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.when(v.isNotNull(), "structured").otherwise("text").alias("kind"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("src12_list_nodes", f"WITH {NODES_SQL} SELECT * FROM nodes")
def src12(spark, sf_dir):
    return corpus.nodes(spark, sf_dir)


@query("src13_list_edges", f"WITH {EDGES_SQL} SELECT * FROM edges")
def src13(spark, sf_dir):
    adjacency = corpus.edges(spark, sf_dir).groupBy("src").agg(F.collect_list(F.struct("dst", "edge_type")).alias("out"))
    return adjacency.select("src", F.explode("out").alias("e")).select("src", "e.dst", "e.edge_type")


@query("src15_content_get", "SELECT doc_id, text AS content FROM documents WHERE 'chunk:sha256:' || sha256(text) = (SELECT 'chunk:sha256:' || sha256(text) FROM documents WHERE doc_id = 0)")
def src15(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    wanted = c.filter("doc_id = 0").select("chunk_id")
    return c.join(wanted, "chunk_id", "left_semi").select("doc_id", "content")


@query("src18_edge_append", "SELECT DISTINCT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, 'generic_ref' AS edge_type FROM lineitem")
def src18(spark, sf_dir):
    e = corpus.edges(spark, sf_dir).filter("edge_type = 'generic_ref'")
    lines = table(spark, sf_dir, "lineitem")
    again = lines.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("generic_ref").alias("edge_type"))
    return op.append_edges(e, again, max(1, -(-2 * lines.count() // corpus.DISTINCT)))


@query("src19_cas_list", "SELECT 'chunk_sha256_' || sha256(text) AS file, CAST(min(strlen(text)) AS BIGINT) AS size, count(*) AS puts FROM documents GROUP BY sha256(text)")
def src19(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    return c.groupBy(F.translate("chunk_id", ":/", "__").alias("file")).agg(F.min("size").alias("size"), F.count("*").alias("puts"))


@query("src20_put_verified", "SELECT doc_id, (doc_id % 7 <> 0 AND strlen(text) <= 20000) AS success, CASE WHEN doc_id % 7 = 0 THEN 'hash mismatch' WHEN strlen(text) > 20000 THEN 'too large' END AS error FROM documents")
def src20(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    claimed = F.when(F.col("doc_id") % 7 == 0, chunk_id(F.concat("content", F.lit("!")))).otherwise(F.col("chunk_id"))
    return op.put(c.withColumn("claimed", claimed), "claimed", "content", 20_000).select("doc_id", "success", "error")


@query("src22_store_chunk", "SELECT doc_id, sha256(text) AS hash, 'typescript' AS language, split_part(text, chr(10), 1) || ' ' || split_part(text, chr(10), 2) AS embedded_text FROM documents")
def src22(spark, sf_dir):
    reg = corpus.registry(spark, sf_dir).select("doc_id", F.concat_ws(" ", "name", "description").alias("embedded_text"))
    return table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("hash"), F.lit("typescript").alias("language")).join(reg, "doc_id")


@query("src23_get_by_id_or_hash", f"WITH {REGISTRY_SQL} SELECT d.doc_id, name, quality FROM documents d JOIN reg USING (doc_id) WHERE d.doc_id = 5 OR sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 9)")
def src23(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("hash"))
    nine = d.filter("doc_id = 9").select(F.col("hash").alias("wanted"))
    hit = d.join(F.broadcast(nine), F.col("hash") == F.col("wanted"), "left").filter("doc_id = 5 OR wanted IS NOT NULL").select("doc_id")
    return hit.join(corpus.registry(spark, sf_dir), "doc_id").select("doc_id", "name", "quality")


@query("src24_update_metadata", f"WITH {REGISTRY_SQL} SELECT r.doc_id, r.name, CASE WHEN r.doc_id % 10 = 0 THEN 'updated' ELSE r.description END AS description, r.quality FROM reg r")
def src24(spark, sf_dir):
    reg = corpus.registry(spark, sf_dir)
    patch = reg.filter("doc_id % 10 = 0").select("doc_id", F.lit("updated").alias("description"), F.lit(None).cast("double").alias("quality"))
    return op.patch(reg.select("doc_id", "name", "description", "quality"), patch, "doc_id")


@query("src25_usage_count", "SELECT user_id AS key, count(*) AS uses FROM events GROUP BY user_id")
def src25(spark, sf_dir):
    return corpus.cache(spark, sf_dir).groupBy("key").agg(F.count("*").alias("uses"))


@query("src26_list_with_metadata", "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def src26(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("src28_create_nodes", f"WITH {NODES_SQL} SELECT node_id, alias, CAST(0 AS BIGINT) AS usage_count, 0.8::DOUBLE AS quality FROM nodes WHERE language = 'nation'")
def src28(spark, sf_dir):
    return corpus.nodes(spark, sf_dir).filter("language = 'nation'").select("node_id", "alias", F.lit(0).cast("long").alias("usage_count"), F.lit(0.8).alias("quality"))


@query("src31_embedding_cache", "SELECT d.doc_id, e.vec_id IS NOT NULL AS cached, CASE WHEN e.vec_id IS NULL THEN 5 ELSE CAST(len(embedding) AS INTEGER) END AS dims FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def src31(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.read_through(d, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "text").select("doc_id", "cached", F.size("embedding").alias("dims"))


@query("src32_cache_integrity", "SELECT substr(sha256(text), 1, 2) AS shard, count(*) AS entries, count(*) FILTER (doc_id % 11 = 0) AS corrupt FROM documents GROUP BY 1")
def src32(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", sha256(F.col("text")).alias("hash"))
    stored = d.withColumn("data", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")))
    return stored.groupBy(F.substring("hash", 1, 2).alias("shard")).agg(F.count("*").alias("entries"), F.count_if(sha256(F.col("data")) != F.col("hash")).alias("corrupt"))


@query("src33_cache_gc", "SELECT count(*) AS removed, round(sum(value), 2) AS freed FROM events WHERE (SELECT max(ts) FROM events) - ts > INTERVAL 7 DAY")
def src33(spark, sf_dir):
    return op.expired(corpus.cache(spark, sf_dir), 7).agg(F.count("*").alias("removed"), F.round(F.sum("size"), 2).alias("freed"))


@query("src34_gc_candidates", "SELECT event_id AS entry_id, value AS size FROM events WHERE (SELECT max(ts) FROM events) - ts > INTERVAL 1 DAY ORDER BY ts, event_id LIMIT 10")
def src34(spark, sf_dir):
    return op.expired(corpus.cache(spark, sf_dir), 1).orderBy("modified", "entry_id").limit(10).select("entry_id", "size")


@query("src37_manifest", "SELECT lang AS language, count(*) AS nodes, count(DISTINCT sha256(text)) AS representations FROM documents GROUP BY lang")
def src37(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).groupBy("language").agg(F.count("*").alias("nodes"), F.count_distinct("chunk_id").alias("representations"))


@query("src38_publish_scan", "SELECT coalesce(d.doc_id, l.doc_id) AS stem, d.doc_id IS NOT NULL AS has_chunk, l.doc_id IS NOT NULL AS has_meta FROM documents d FULL JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def src38(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), F.lit(True).alias("c"))
    b = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("stem"), F.lit(True).alias("m"))
    return a.join(b, "stem", "full").select("stem", F.col("c").isNotNull().alias("has_chunk"), F.col("m").isNotNull().alias("has_meta"))


@query("src42_preview", "SELECT doc_id, substr(text, 1, 500) AS preview, length(text) > 500 AS cut FROM documents")
def src42(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 500).alias("preview"), (F.length("text") > 500).alias("cut"))


@query("src44_batch_import", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'nodes' AS pass, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def src44(spark, sf_dir):
    n = corpus.nodes(spark, sf_dir).agg(F.lit("nodes").alias("pass"), F.count("*").alias("n"))
    return n.unionByName(corpus.edges(spark, sf_dir).agg(F.lit("edges").alias("pass"), F.count("*").alias("n")))


WRITES_SQL = """writes AS (SELECT 'n' || user_id AS node, event_id AS seq, ['s' || (user_id % 40), event_type || '-' || (event_id % 20)] AS symbols,
    CASE WHEN event_id % 3 = 0 THEN [] ELSE ['n' || (event_id % 50), 'n' || (event_id % 7)] END AS deps FROM events)"""
INDEX_SQL = """, idx AS (SELECT symbol, max_by(node, seq) AS node FROM (SELECT node, seq, unnest(symbols) AS symbol FROM writes) GROUP BY symbol),
    fwd AS (SELECT node, max_by(deps, seq) AS deps FROM writes WHERE len(deps) > 0 GROUP BY node), rev AS (SELECT DISTINCT d AS node, node AS dependent FROM (SELECT node, unnest(deps) AS d FROM writes))"""


def writes(spark, sf_dir):
    """Events as writes of their user's node."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    symbols = F.array(F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")), F.concat("event_type", F.lit("-"), (key % 20).cast("string")))
    deps = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name(key % 50), name(key % 7)))
    return e.select(name(F.col("user_id")).alias("node"), key.alias("seq"), symbols.alias("symbols"), deps.alias("deps"))


@query("src14_node_upsert", f"WITH {WRITES_SQL} SELECT node, max(seq) AS seq, array_to_string(max_by(symbols, seq), ',') AS symbols FROM writes GROUP BY node")
def src14(spark, sf_dir):
    return store.nodes(writes(spark, sf_dir)).select("node", "seq", F.array_join("symbols", ",").alias("symbols"))


@query("src14_symbol_index", f"WITH {WRITES_SQL}{INDEX_SQL} SELECT symbol, node FROM idx")
def src14_index(spark, sf_dir):
    return store.symbol_index(writes(spark, sf_dir))


@query("src14_adjacency", f"WITH {WRITES_SQL}{INDEX_SQL} SELECT 'forward' AS list, node, unnest(deps) AS other FROM fwd UNION ALL SELECT 'reverse', node, dependent FROM rev")
def src14_adjacency(spark, sf_dir):
    w = writes(spark, sf_dir)
    out = store.forward(w).select(F.lit("forward").alias("list"), "node", F.explode("deps").alias("other"))
    return out.unionByName(store.reverse(w).select(F.lit("reverse").alias("list"), "node", F.col("dependent").alias("other")))


@query(
    "src16_node_delete",
    f"""WITH {WRITES_SQL}{INDEX_SQL}, gone AS (SELECT DISTINCT node FROM writes WHERE CAST(substr(node, 2) AS BIGINT) % 5 = 0)
    SELECT 'symbol' AS kind, node, symbol AS what FROM idx WHERE node NOT IN (SELECT node FROM gone) UNION ALL SELECT 'dependent', node, dependent FROM rev WHERE node NOT IN (SELECT node FROM gone)
    UNION ALL SELECT 'dangling', node, d FROM (SELECT node, unnest(deps) AS d FROM fwd WHERE node NOT IN (SELECT node FROM gone)) WHERE d NOT IN (SELECT node FROM writes) OR d IN (SELECT node FROM gone)""",
)
def src16(spark, sf_dir):
    """Every fifth node is deleted; what still names one dangles."""
    w = writes(spark, sf_dir)
    left = store.without(w, w.filter(F.substring("node", 2, 20).cast("long") % 5 == 0).select("node").distinct())
    rows = [left["symbols"].select(F.lit("symbol").alias("kind"), "node", F.col("symbol").alias("what")), left["reverse"].select(F.lit("dependent").alias("kind"), "node", F.col("dependent").alias("what"))]
    return rows[0].unionByName(rows[1]).unionByName(store.dangling(left).select(F.lit("dangling").alias("kind"), "node", F.col("missing").alias("what")))


CHUNKS_SQL = """chunks AS (SELECT 'n' || user_id AS id, event_id AS seq, event_id * 3 // (SELECT max(event_id) + 1 FROM events) AS batch,
      ['s' || (user_id % 40), event_type || '-' || (event_id % 20)] AS provides, [event_type || '-' || (event_id % 23), 's' || (event_id % 45)] AS requires,
      ['a' || (user_id % 9)] AS aliases, CASE WHEN event_id % 3 = 0 THEN [] ELSE ['n' || (event_id % 50), 'n' || (event_id % 7)] END AS deps FROM events),
    owned AS (SELECT k AS batch, symbol, max_by(id, (seq, place)) AS owner FROM (SELECT id, seq, batch, unnest(provides) AS symbol, unnest([0, 1]) AS place FROM chunks) c, range(3) AS b(k) WHERE c.batch <= k GROUP BY ALL),
    wants AS (SELECT DISTINCT id, batch, unnest(requires) AS wanted FROM chunks),
    linked AS (SELECT id AS src, w.batch, CASE wanted WHEN 's5' THEN 'n1' ELSE owner END AS dst FROM wants w LEFT JOIN owned o ON o.batch = w.batch AND symbol = wanted
               WHERE wanted = 's5' OR (owner IS NOT NULL AND owner <> id)),
    listed AS (SELECT id, max(batch) AS batch, max_by(deps, seq) AS deps FROM chunks WHERE len(deps) > 0 GROUP BY id),
    forward AS (SELECT id AS src, 'calls' AS edge_type, unnest(deps) AS dst FROM listed
                UNION SELECT src, 'imports', dst FROM linked LEFT JOIN listed ON src = id WHERE listed.batch IS NULL OR linked.batch >= listed.batch),
    reverse AS (SELECT unnest(deps) AS dst, 'calls' AS edge_type, id AS src FROM chunks UNION SELECT dst, 'imports', src FROM linked),
    nodes AS (SELECT id, max(seq) AS seq, max_by(provides, seq) AS provides, max_by(aliases, seq) AS aliases FROM chunks GROUP BY id),
    symbols AS (SELECT symbol, owner FROM owned WHERE batch = 2), aliases AS (SELECT alias, max_by(id, seq) AS owner FROM (SELECT id, seq, unnest(aliases) AS alias FROM chunks) GROUP BY alias)"""


def event_chunks(spark, sf_dir):
    """Events as chunks of their users, in three batches by time: batch, and the columns of a chunk."""
    e = table(spark, sf_dir, "events")
    text = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    kind = lambda n: F.concat("event_type", F.lit("-"), (F.col("event_id") % n).cast("string"))
    edge = lambda n: F.struct(F.lit("calls").alias("edge_type"), text("n", "event_id", n).alias("dst"))
    last = e.agg(F.max("event_id")).first()[0]
    outgoing = F.when(F.col("event_id") % 3 != 0, F.array(edge(50), edge(7))).otherwise(F.array().cast("array<struct<edge_type: string, dst: string>>"))
    return e.select(
        F.floor(F.col("event_id") * 3 / (last + 1)).cast("int").alias("batch"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("chunk_id"), F.col("event_id").alias("seq"),
        F.md5(F.col("event_id").cast("string")).alias("content_hash"), F.col("event_type").alias("language"), F.lit(1).cast("long").alias("size"),
        F.array(text("s", "user_id", 40), kind(20)).alias("provides"), F.array(kind(23), text("s", "event_id", 45)).alias("requires"), F.array(text("a", "user_id", 9)).alias("aliases"), outgoing.alias("outgoing"),
    )


def imported(spark, sf_dir):
    """The store after the three batches; 's5' is an alias of the registry."""
    made, chunks = GraphStore(spark, new_folder(spark, "store"), buckets=4), event_chunks(spark, sf_dir)
    registry = spark.createDataFrame([("s5", "n1")], "alias string, owner string")
    for k in range(3):
        made.put(chunks.filter(F.col("batch") == k), registry, f"batch {k}")
    return made


def contents(made):
    row = lambda kind, t, a, b: made.table(t).select(F.lit(kind).alias("kind"), F.col(a).alias("key"), b.cast("string").alias("value"))
    edge = lambda other: F.concat_ws(" ", "edge_type", other)
    parts = [row("node", "nodes", "chunk_id", F.col("seq")), row("symbol", "symbols", "symbol", F.col("owner")), row("alias", "aliases", "alias", F.col("owner")), row("forward", "forward", "src", edge("dst")), row("reverse", "reverse", "dst", edge("src"))]
    return reduce(DataFrame.unionByName, parts)


CONTENTS_SQL = """SELECT 'node' AS kind, id AS key, seq::VARCHAR AS value FROM nodes UNION ALL SELECT 'symbol', symbol, owner FROM symbols UNION ALL SELECT 'alias', alias, owner FROM aliases
    UNION ALL SELECT 'forward', src, edge_type || ' ' || dst FROM forward UNION ALL SELECT 'reverse', dst, edge_type || ' ' || src FROM reverse"""


@query("src44_store_import", f"WITH {CHUNKS_SQL} {CONTENTS_SQL}")
def src44_store(spark, sf_dir):
    """Nodes, indexes and linked edges after three batches."""
    return contents(imported(spark, sf_dir))


@query(
    "src16_store_delete",
    f"""WITH {CHUNKS_SQL}, gone AS (SELECT * FROM nodes WHERE substr(id, 2)::BIGINT % 5 = 0), left_ AS (SELECT * FROM ({CONTENTS_SQL}))
    SELECT * FROM left_ WHERE (kind NOT IN ('node', 'forward', 'reverse') OR key NOT IN (SELECT id FROM gone))
      AND (kind <> 'symbol' OR key NOT IN (SELECT unnest(provides) FROM gone)) AND (kind <> 'alias' OR key NOT IN (SELECT unnest(aliases) FROM gone))""",
)
def src16_store(spark, sf_dir):
    """The same without every fifth node: its symbols, aliases and lists go, what others say of it dangles."""
    made = imported(spark, sf_dir)
    made.delete(made.table("nodes").filter(F.substring("chunk_id", 2, 20).cast("long") % 5 == 0), "every fifth")
    return contents(made)


GC_SQL = """d AS (SELECT doc_id, sha256(text) AS hash FROM documents), s AS (SELECT hash, min(doc_id) % 97 = 0 AS bad FROM d GROUP BY hash),
    e AS (SELECT DISTINCT a.hash AS src, b.hash AS dst FROM d a JOIN d b ON b.doc_id = a.doc_id // 2 WHERE a.doc_id % 3 <> 0),
    roots AS (SELECT k AS epoch, hash FROM d JOIN labels USING (doc_id), range(1, 4) AS r(k) WHERE k = 2 OR quality = k % 2),
    w AS (SELECT epoch, hash FROM roots UNION SELECT w.epoch, e.dst FROM w JOIN e ON e.src = w.hash),
    u AS (SELECT k AS epoch, hash FROM s, range(1, 4) AS r(k) WHERE NOT bad AND NOT EXISTS (FROM w WHERE w.epoch = k AND w.hash = s.hash)),
    x AS (SELECT hash, max(epoch) FILTER (epoch = 1) AS u1, max(epoch) FILTER (epoch = 2) AS u2, max(epoch) FILTER (epoch = 3) AS u3 FROM u GROUP BY hash)"""


@query(
    "src34_mark_sweep",
    f"""WITH RECURSIVE {GC_SQL} SELECT s.hash, CASE WHEN bad THEN 'corrupt' WHEN u1 = 1 AND u2 = 2 THEN 'unreachable' WHEN u2 = 2 AND u3 = 3 THEN 'unreachable' WHEN u3 = 3 THEN 'condemned' ELSE 'kept' END AS state,
      CASE WHEN bad THEN 1 WHEN u1 = 1 AND u2 = 2 THEN 2 WHEN u2 = 2 AND u3 = 3 THEN 3 WHEN u3 = 3 THEN 3 END AS epoch FROM s LEFT JOIN x USING (hash)""",
)
def src34_mark_sweep(spark, sf_dir):
    """Three runs over the documents' chunks, with the labelled ones as roots (of good, any and good quality) and a tree of references."""
    d = table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("hash"), "text")
    ids = written(d.select("doc_id", "hash"), "ids")
    made = ChunkStore(spark, new_folder(spark, "chunks"), buckets=4)
    first = d.groupBy("hash").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    made.put(first.select("hash", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")), "all")
    edges = ids.filter("doc_id % 3 <> 0").select(F.col("hash").alias("src"), F.floor(F.col("doc_id") / 2).alias("doc_id")).join(ids.select("doc_id", F.col("hash").alias("dst")), "doc_id").select("src", "dst").distinct()
    edges, roots = written(edges, "references"), ids.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    for epoch in (1, 2, 3):
        made.collect(roots if epoch == 2 else roots.filter(F.col("quality") == epoch % 2), edges, epoch)
    rows = made.table("chunks").select("hash").join(made.table("condemned"), "hash", "left")
    rows = rows.select("hash", F.when(F.col("since").isNull(), "kept").otherwise("condemned").alias("state"), F.col("since").cast("int").alias("epoch"))
    return rows.unionByName(made.table("swept").select("hash", F.col("reason").alias("state"), F.col("epoch").cast("int").alias("epoch")))


@query(
    "src43_constraints",
    """WITH c AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'chunk:0' ELSE 'chunk:' || doc_id END AS id, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'source' END AS kind, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS size FROM documents),
      s AS (SELECT 'chunk:' || doc_id AS id FROM labels), v AS (
      SELECT 'chunks' AS table_name, 'chunk_type is one of source, ir, blob, container' AS rule, count(*) AS n FROM c WHERE kind = 'other' UNION ALL SELECT 'chunks', 'size_bytes is required', count(*) FROM c WHERE size IS NULL
      UNION ALL SELECT 'chunks', 'chunk_id is unique', count(*) FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'signatures', 'chunk_id refers to chunks', count(*) FROM s WHERE id NOT IN (SELECT id FROM c)) SELECT * FROM v WHERE n > 0""",
)
def src43(spark, sf_dir):
    """Chunks of which some have no size, another type or the same id, and signatures of the labelled ones."""
    d, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = lambda c: F.concat(F.lit("chunk:"), c.cast("string"))
    chunks = d.select(F.when(key % 10 == 3, "chunk:0").otherwise(name(key)).alias("chunk_id"), F.when(key % 5 == 0, "other").otherwise("source").alias("chunk_type"), F.when(key % 9 != 0, F.col("n_chars")).alias("size_bytes"), F.sha2("text", 256).alias("content_hash"))
    signed = table(spark, sf_dir, "labels").select(name(key).alias("chunk_id"), F.col("toxic").cast("string").alias("signer_id"))
    return relational.violations({"chunks": chunks, "signatures": signed})


@query("src28_relate", f"WITH {EDGES_SQL} SELECT src, dst, edge_type AS relation, 1.0::DOUBLE AS confidence FROM edges")
def src28_relate(spark, sf_dir):
    return op.relate(corpus.edges(spark, sf_dir))


@query("src37_dependency_map", f"WITH {corpus.FILES_SQL} SELECT page_id, path, array_to_string(list_sort(list_distinct(imports)), ' ') AS depends_on FROM files WHERE len(imports) > 0")
def src37_map(spark, sf_dir):
    f = corpus.files(spark, sf_dir).filter(F.size("imports") > 0)
    return f.select("page_id", "path", F.array_join(F.array_sort(F.array_distinct("imports")), " ").alias("depends_on"))
