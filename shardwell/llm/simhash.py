"""SimHash fingerprints, and near-duplicate components by multi-index hashing.

A pair of fingerprints within RADIUS = 2 bits has, in one of two 32-bit segments, at most one differing bit. Each
distinct fingerprint therefore looks up, in the table of either segment, the 33 values of the radius-1 ball around its
own segment, and a match counts once the complete distance is verified. A segment value that more than CELL
fingerprints share is not paired up: its members look up the ball around the other segment too, where at most 65
fingerprints meet in a place, and link to the smallest of the place (verified as well). That keeps every component
whole with a bounded number of links for each fingerprint, whatever the size of a group of copies.

Defined results: null text counts as empty; a text without words has fingerprint zero; component_id is null only where
all ids of a component are null; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups

RADIUS = 2
SEGMENT_BITS = 32
CELL = 48
SEED = 42


def fingerprint(text: str | None, width: int = 3, chunk: int = 1 << 16) -> int:
    """64 bits; each is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        n = len(words) - width + 1
    total = np.zeros(64, np.int64)
    left = n
    while left > 0:
        take = min(chunk, left)
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s, _ in zip(shingles, range(take), strict=False)])
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= take
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within RADIUS bits that leave every component connected."""
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    segments = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("val"), low.alias("other")), F.struct(F.lit(1).alias("seg"), low.alias("val"), high.alias("other")))).alias("s")).select("fp", "s.*")
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(SEGMENT_BITS)))
    probes = segments.select("fp", "seg", F.explode(ball).alias("flip"), "val", "other").withColumn("probe", F.col("val").bitwiseXOR(F.col("flip")))
    hot = scratch.write(segments.groupBy("seg", "val").count().filter(F.col("count") > CELL).select("seg", "val"), "hot")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    some_hot = not hot.isEmpty()
    table = segments.select("seg", "val", F.col("fp").alias("b"))
    if some_hot:
        table = table.join(hot, ["seg", "val"], "left_anti")
    cold = probes.select("seg", F.col("probe").alias("val"), F.col("fp").alias("a")).hint("merge").join(table, ["seg", "val"]).filter(F.col("a") < F.col("b")).filter(near).select("a", "b")
    if not some_hot:
        return cold.distinct()
    # (merge joins: the planner takes exploded rows for as many as there were before)
    members = segments.join(hot, ["seg", "val"], "left_semi")
    exact = members.select("seg", "val", F.explode(ball).alias("flip"), "other", "fp").select("seg", "val", F.col("other").bitwiseXOR(F.col("flip")).alias("place"), "fp")
    flipped = probes.filter("flip != 0").select("seg", F.col("probe").alias("val"), F.col("other").alias("place"), "fp").join(hot, ["seg", "val"], "left_semi")
    places = exact.unionByName(flipped)
    least = places.groupBy("seg", "val", "place").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a != top")
    star = places.hint("merge").join(least, ["seg", "val", "place"]).select("a", F.col("fp").alias("b")).filter("a != b").filter(near)
    return cold.unionByName(star).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the smallest node reachable) for every node of an edge; labels spread and jump until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both, "both")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard, labels["node"] == heard["a"], "left").select("node", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = new.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
        new = scratch.write(new, f"labels{step}")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(f"labels{step - 1}")
        labels = new.drop("moved")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id and n_copies (rows of the fingerprint) for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, id_col, text_col, width), "fingerprints")
    fps = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies")), "distinct")
    edges = scratch.write(links(fps.select("fp"), scratch), "links")
    labels = components(edges, scratch)
    joined = fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", "first", "n_copies", F.coalesce("label", "fp").alias("label"))
    least = joined.filter("label != fp or first is not null").groupBy("label").agg(F.min("first").alias("component_id"))
    groups = scratch.write(joined.join(least, "label", "left").select("fp", "component_id", "n_copies"), "groups")
    total = groups.agg(F.sum("n_copies")).first()[0] or 0
    out = join_groups(rows, groups, "fp", "n_copies", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), total)
    return out.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")
