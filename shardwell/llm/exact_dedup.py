"""Exact deduplication by Grace hashing.

Two rows are copies when their whole texts are identical after lower-casing A-Z. Each map task first folds its own
copies into one record (text, largest id, count), so a text that fills a third of the corpus reaches a bucket once a
task. Records are dealt by hash to buckets (the shuffle files are the first level of spill files); a bucket whose
distinct texts outgrow memory is partitioned again, by the next bits of the hash, into spill files of its task, until
each part fits an open-addressing table that compares complete contents.

Defined results: null text counts as empty; rows with a null id count in group_size and stay only if the group has no
id at all; of rows that share both text and the largest id, one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_groups, lower_ascii, scratch_budget, text_or_empty

FANOUT_BITS = 4
Record = tuple[bytes, bytes, "int | None", int, int]  # digest, content, largest id, rows, rows with that id


class OpenTable:
    """Open addressing with linear probing over 64 bits of the digest; equal means equal content."""

    def __init__(self) -> None:
        self.slots, self.records, self.size = [-1] * 64, [], 0

    def _place(self, h: int, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.records[k][0] == digest:
                if self.records[k][1] != content:
                    raise ValueError("two texts share a SHA-256 digest")
                break
            at = (at + 1) & mask
        return at

    def add(self, r: Record) -> None:
        digest, content, top, n, ties = r
        at = self._place(int.from_bytes(digest[:8], "little"), digest, content)
        k = self.slots[at]
        if k < 0:
            self.slots[at] = len(self.records)
            self.records.append([digest, content, top, n, ties])
            self.size += len(content) + 200
            if 2 * len(self.records) > len(self.slots):
                self._grow()
            return
        have = self.records[k]
        have[3] += n
        if top is not None and (have[2] is None or top > have[2]):
            have[2], have[4] = top, ties
        elif top == have[2]:
            have[4] += ties

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, r in enumerate(self.records):
            at = int.from_bytes(r[0][:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(records: Iterable[Record], budget: int, level: int = 0) -> Iterator[list]:
    """Distinct records of any number of records, holding about budget bytes of text at once."""
    table, source = OpenTable(), iter(records)
    for r in source:
        table.add(r)
        if table.size > budget and level < 12 and len(table.records) > 1:  # one text can't be parted
            break
    else:
        yield from table.records
        return
    shift = 64 - FANOUT_BITS * (level + 1)  # the shuffle dealt by a hash of its own; these are the digest's own bits
    files = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
    try:
        for part in (table.records, source):
            for r in part:
                pickle.dump(tuple(r), files[int.from_bytes(r[0][8:16], "little") >> shift & ((1 << FANOUT_BITS) - 1)], protocol=5)
        del table
        for f in files:
            f.seek(0)
            yield from grace(_unspill(f), budget, level + 1)
            f.close()
    finally:
        for f in files:
            f.close()


def _unspill(f) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds a task's own copies; lets go of what it holds when that outgrows the budget."""
    table = OpenTable()
    for b in batches:
        ids, contents, digests = b.column("id").to_pylist(), b.column("content"), b.column("digest")
        for i, c, d in zip(ids, contents, digests, strict=True):
            table.add((d.as_py(), c.as_py(), i, 1, 1))
        if table.size > scratch_budget():
            yield from _batches(table.records)
            table = OpenTable()
    yield from _batches(table.records)


def _batches(records: list[list], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < len(records):
        size, to = 0, at
        while to < len(records) and (to == at or size + len(records[to][1]) <= most):
            size += len(records[to][1])
            to += 1
        cols = list(zip(*records[at:to], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["digest", "content", "keep_id", "group_size", "ties"])
        at = to


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for b in batches:
            rest = [b.column(k).to_pylist() for k in (2, 3, 4)]
            for d, c, *x in zip(b.column(0), b.column(1), *rest, strict=True):
                yield (d.as_py(), c.as_py(), *x)

    held: list[list] = []
    for digest, _, *x in grace(records(), scratch_budget()):
        held.append([digest, b"", *x])
        if len(held) >= 20_000:
            yield from (b.select(["digest", "keep_id", "group_size", "ties"]) for b in _batches(held))
            held = []
    yield from (b.select(["digest", "keep_id", "group_size", "ties"]) for b in _batches(held))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct text: digest, keep_id, group_size, ties (rows that hold keep_id)."""
    content = lower_ascii(text_or_empty(text_col)).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    folded = rows.mapInArrow(_fold, "digest binary, content binary, keep_id long, group_size long, ties long")
    return folded.repartition("digest").mapInArrow(_bucket, "digest binary, keep_id long, group_size long, ties long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256, and the columns named in keep."""
    spark = docs.sparkSession
    groups = copy_groups(docs, id_col, text_col).filter("group_size > 1")
    groups = Scratch(spark, "exact").write(groups.select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size", "ties"), "groups")
    seen = groups.agg(F.max("ties"), F.sum("group_size")).first()
    digest = F.sha2(lower_ascii(text_or_empty(text_col)).cast("binary"), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), digest.alias("text_sha256"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(keep)))
    salt = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    out = join_groups(rows, groups, "text_sha256", "group_size", salt, seen[1] or 0)
    alone = F.col("group_size").isNull()
    last = F.col("_id").eqNullSafe(F.col("keep_id"))
    out = out.withColumn("_kept", alone | last)
    if (seen[0] or 1) > 1:  # some rows share both text and id
        first = F.row_number().over(Window.partitionBy("text_sha256", "_id", "_kept").orderBy(F.lit(1))) == 1
        out = out.withColumn("_kept", F.col("_kept") & first)
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_kept").alias("kept"),
        "text_sha256",
        *(F.col(f"_c{k}").alias(c) for k, c in enumerate(keep)),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    out = docs.withColumn("_row", F.struct(*docs.columns))
    kept = exact_duplicates(out, id_col, text_col, keep=("_row",)).filter("kept")
    return kept.select("_row.*")
