"""Near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what
they connect.

1. Each document has a fingerprint of SEGMENTS * BITS bits over its distinct shingles: a bit is set if it is set in over
   half of the shingles' hashes. At a similarity of s two fingerprints differ in a share acos(2 s / (1 + s)) / pi of
   their bits, 0.15 at 0.8.
2. Multi-index hashing: in the table of each segment a document stands at the radius-1 ball around its own value, so two
   documents meet there if their segments differ in at most two bits. All pairs within 3 * SEGMENTS - 1 bits meet; a pair
   of similarity 0.8 (43 bits on average) meets in some table with probability 0.94, one of 0.85 with 0.99.
3. Complete distances are verified (FAR bits, 2.7 standard deviations beyond 0.8), then the similarity itself, on
   the whole texts. So nothing that is less alike is ever linked.

Two documents that are alone in a place are compared at once. Of a larger place one member, drawn at random and again anew,
stands for all, and each document is compared with the closest of those that it meets and isn't connected to yet; so a large
group of near copies makes one comparison a member and round. What is then still apart in a place is compared by
fingerprints, without a row a pair.

Defined results: texts without words are copies of each other; fewer than five words are one shingle; rows without an id
stay; of repeated rows one stays, and rows that share an id but not a text are judged each by its own; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name
from .simhash import SEED, components

WIDTH = 5
#: Similarity of near copies in tenths.
TENTHS = 8
SEGMENTS, BITS = 11, 26
#: Bits that fingerprints of near copies may differ in.
FAR = 60
ROUNDS = 3
WORDS = -(-SEGMENTS * BITS // 64)
#: Ids that are broadcast at most, 8 bytes each, to fetch the texts of pairs.
BROADCAST_IDS = 250_000
#: Fingerprints that are compared with others at a time.
BLOCK = 2048


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct XXH64 of the runs of width words, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = zip(*(words[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(r), SEED) for r in runs]), ">u8").astype(np.uint64))


def fingerprint(own: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """WORDS 64-bit words."""
    total = np.zeros((WORDS, 64), np.int64)
    for a in range(0, len(own), chunk):
        h = own[a : a + chunk]
        for k in range(WORDS):
            x = h * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            total[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(own), axis=1, bitorder="little").reshape(-1).view("<u8")


def segments_of(fp: np.ndarray) -> list[int]:
    whole = int.from_bytes(fp.tobytes(), "little")
    return [whole >> BITS * k & (1 << BITS) - 1 for k in range(SEGMENTS)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * both >= TENTHS * (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, fp (WORDS longs), segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                found = [fingerprint(shingles(t)) for t in b.column("text").to_pylist()]
                fps = pa.array([f.view("<i8").tolist() for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id"), fps, pa.array(map(segments_of, found), pa.list_(pa.int64()))], names=["id", "fp", "segments"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.mapInArrow(run, "id long, fp array<long>, segments array<long>")


def places(fps: DataFrame) -> DataFrame:
    """id, cell (segment and value), n (documents there) of the places where documents meet."""
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(BITS)))
    rows = fps.select("id", F.posexplode("segments").alias("at", "value")).select("id", "at", "value", F.explode(ball).alias("flip"))
    rows = rows.select("id", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").bitwiseXOR(F.col("flip"))).alias("cell"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).filter("n > 1")


def near(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose fingerprints are within FAR bits, with their distance."""
    side = lambda k: fps.select(F.col("id").alias(k), F.col("fp").alias(f"f{k}"))
    distance = sum((F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(1, WORDS)), F.bit_count(F.col("fa")[0].bitwiseXOR(F.col("fb")[0])))
    out = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("distance", distance).filter(F.col("distance") <= FAR)
    return out.select(*pairs.columns, "distance")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 100) for whole in batches for k in range(0, whole.num_rows, 100)):
            texts = zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)
            fit = pa.array([alike(shingles(x), shingles(y)) for x, y in texts], pa.bool_())
            yield b.select(["a", "b"]).filter(fit)

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    side = lambda k: own.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def apart(members: DataFrame) -> DataFrame:
    """Pairs (a, b) within a cell (id, cell, label, fp) that have different labels and are within FAR bits."""

    def compare(ids: np.ndarray, labels: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(ids), BLOCK):
            for to in range(at, len(ids), BLOCK):
                x, y = fps[at : at + BLOCK], fps[to : to + BLOCK]
                distance = np.zeros((len(x), len(y)), np.uint16)
                for k in range(WORDS):
                    distance += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
                i, j = np.nonzero((distance <= FAR) & (labels[at : at + BLOCK, None] != labels[None, to : to + BLOCK]))
                i, j = ids[at + i], ids[to + j]
                yield np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, ids, labels = (t.column(c).to_numpy() for c in ("cell", "id", "label"))
            fps = t.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for s, e in zip(cuts, cuts[1:], strict=False):
                for a, b in compare(ids[s:e], labels[s:e], fps[s:e]):
                    if len(a):
                        found = np.unique(np.c_[a, b], axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            t = pa.concat_tables(held)
            cell = t.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            if cut:
                yield from flush(t.slice(0, cut))
                held = [t.slice(cut)]
        if held:
            t = pa.concat_tables(held)
            if t.num_rows:
                yield from flush(t)

    return members.select("cell", "id", "label", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, label (smallest id) for every document that has a near copy."""
    scratch = Scratch(docs.sparkSession, "near_copies")
    fps = scratch.write(fingerprints(docs, id_col, text_col), "fingerprints")
    members = scratch.write(places(fps), "members")
    fps = fps.select("id", "fp")
    found = tried = docs.sparkSession.createDataFrame([], "a long, b long")
    out = components(found, Scratch(docs.sparkSession, "near_copies"))
    for k in range(ROUNDS + 1):
        own = members.join(out, members["id"] == out["node"], "left").select("cell", "n", "id", F.coalesce("label", "id").alias("label"))
        if k < ROUNDS:
            centre = own.groupBy("cell").agg(F.min_by(F.struct("id", "label"), F.struct(F.xxhash64("id", F.lit(k)), "id")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
            own = own if k == 0 else own.filter("n > 2")
            met = own.join(centre.select("cell", "c"), "cell").filter(F.col("label") != F.col("c.label")).groupBy(F.col("id").alias("a"), F.col("c.id").alias("b")).agg(F.min("n").alias("n"))
            order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            met = near(met, fps)
            if k:
                known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
                met = met.join(known, ["a", "b"], "left_anti")
            met = scratch.write(met, f"met{k}")
            closest = met.filter("n > 2").groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
            pairs = order(met.filter("n = 2")).unionByName(order(closest)).distinct()
        else:
            open_ = own.filter("n > 2")
            several = open_.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("cell")
            pairs = apart(open_.join(several, "cell", "left_semi").join(fps, "id"))
        pairs = scratch.write(pairs.join(tried, ["a", "b"], "left_anti"), f"pairs{k}")
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        found = found.unionByName(scratch.write(verified(pairs, docs, id_col, text_col), f"found{k}"))
        out = components(found, Scratch(docs.sparkSession, "near_copies"))
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component, the row with the smallest id."""
    n, kinds = docs.agg(F.count(id_col), F.count_distinct(id_col)).first()
    if n == kinds:
        lost = labels(docs, id_col, text_col).filter("node != label").select(F.col("node").alias(id_col))
        return docs.join(lost, id_col, "left_anti").select(*docs.columns)
    # some ids repeat: rows get numbers of their own, which stand once they are written
    number = free_name(docs, "row")
    rows = Scratch(docs.sparkSession, "near_rows").write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    named = rows.filter(F.col(id_col).isNotNull())
    of = labels(named, number, text_col).join(named.select(F.col(number).alias("node"), F.col(id_col).alias("id")), "node")
    stays = of.groupBy("label").agg(F.min(F.struct("id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    lost = of.join(stays, "node", "left_anti").select(F.col("node").alias(number))
    return rows.join(lost, number, "left_anti").select(*docs.columns)
