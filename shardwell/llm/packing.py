"""Packing token sequences by shortest-pack-first over the length histogram.

A document's ids (with the end id) are cut into full pieces of the capacity and one shorter rest. The histogram of
piece lengths has at most `capacity` entries, whatever the input, so the driver packs it: lengths go from longest to
shortest, each into the packs with most room left, and only counts of packing patterns change. Every placement covers a
range of ranks within its length, and pieces find their placement by rank. Ranks are counted in blocks of bounded
size (a prefix sum of block counts plus a row number), so a length that a third of all pieces has stays spread out.

Defined results: null text counts as empty (its one id is the end id); rows with a null id are packed too; repeated
rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY = 2048
END_ID = 1
#: Pieces whose ranks one task counts.
BLOCK = 10_000
#: Placements (40 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_PLACEMENTS = 200_000
# The parts of a tokenizer file under which words can be encoded one by one.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """A tokenizers file, with the ids of met words remembered where its pre-tokens never span white space.

    For a file of the kind KNOWN (checked when it is loaded) a text's ids are its words' ids in order. A word of
    characters below U+0300, which no normal form changes, is cut by the file's own pattern, and each piece goes to the
    BPE model alone; other words, and those that may hold a special token, go through the whole tokenizer. At most
    `most` words and as many pieces are remembered. Of any other file texts are encoded as they are.
    """

    most = 600_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.inner, self.known, self.parts = Tokenizer.from_file(path), {}, {}
        own = json.loads(self.inner.to_str())
        cut = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex", "")
        self.by_words = own["normalizer"] == KNOWN["normalizer"] and own["pre_tokenizer"] == KNOWN["pre_tokenizer"] and own["model"]["type"] == "BPE" and not own["model"]["dropout"]
        self.cut = regex.compile(cut).findall
        self.special = [t["content"] for t in own["added_tokens"]]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(33, 0x300)} if self.by_words else {}

    def learn(self, words: list[str]) -> None:
        known, parts, tokenize, letters, cut = self.known, self.parts, self.inner.model.tokenize, self.letters, self.cut
        late = []
        if len(parts) > self.most:
            parts.clear()
        for w in words:
            w2 = w.lower()
            if min(w) < "!" or "\x7f" in w or max(w) >= "\u0300" or max(w2) >= "\u0300" or any(s in w for s in self.special):
                late.append(w)
                continue
            found = [w2] if w2.isascii() and w2.isalpha() else cut(w2)
            out = []
            for x in found:
                ids = parts.get(x)
                if ids is None:
                    ids = parts[x] = array("I", [t.id for t in tokenize(x if x.isascii() else x.translate(letters))]).tobytes()
                out.append(ids)
            known[w] = out[0] if len(out) == 1 else b"".join(out)
        for w in late:
            known[w] = np.array(self.inner.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]
        get, out, late = self.known.get, [], {}
        for n, t in enumerate(texts):
            ws = t.split()
            found = [get(w) for w in ws]
            if None in found:
                late[n] = (ws, {w for w, f in zip(ws, found, strict=True) if f is None})
                out.append(b"")
            else:
                out.append(b"".join(found))
        fresh = set().union(*(x[1] for x in late.values())) if late else set()
        if len(self.known) + len(fresh) > self.most:
            self.known.clear()
            fresh = {w for ws, _ in late.values() for w in ws}
        self.learn(list(fresh))
        for n, (ws, _) in late.items():
            out[n] = b"".join([self.known[w] for w in ws])
        for n, t in enumerate(texts):  # str.split also cuts at four controls that are no white space to the tokenizer
            if any(c in t for c in "\x1c\x1d\x1e\x1f"):
                out[n] = np.array(self.inner.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for whole in batches:
            for b in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
                rows = []
                for i, raw in zip(b.column(0).to_pylist(), tok.ids(b.column(1).to_pylist()), strict=True):
                    raw += tail
                    for at in range(0, len(raw), 4 * capacity):
                        part = raw[at : at + 4 * capacity]
                        rows.append((i, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, packs, copies a pack, first sequence, offset) of all pieces of the histogram.

    Packs of one pattern are kept together as (first sequence, packs), by the room that they have left.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    top, opened, out = -1, 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while top >= 0 and not room[top]:
                top -= 1
            if top < length:  # the shortest pack has no room: open packs for all that is left
                r = capacity - length
                out.append((length, rank, left, 1, opened, 0))
                room[r].append((opened, left))
                opened, top, left = opened + left, max(top, r), 0
                continue
            first, packs = room[top].pop()
            below = top - 1
            while below >= length and not room[below]:
                below -= 1
            # as many copies as bring these packs down to the next ones, if there are pieces enough for all of them
            copies = max(1, min(left // packs, (top - max(below, length - 1) + length - 1) // length, top // length))
            if left < packs:
                room[top].append((first + left, packs - left))
                packs, copies = left, 1
            out.append((length, rank, packs, copies, first, capacity - top))
            room[top - copies * length].append((first, packs))
            rank, left = rank + packs * copies, left - packs * copies
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    found = scratch.write(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    plan = shortest_pack_first(histogram, capacity)
    placements = spark.createDataFrame([tuple(map(int, p)) for p in plan], "length long, rank0 long, packs long, copies long, seq0 long, off0 long")
    by_length = placements.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank0", "packs", "copies", "seq0", "off0"))).alias("plan"))
    if len(plan) <= BROADCAST_PLACEMENTS:
        by_length = F.broadcast(by_length)

    blocks = max(1, sum(histogram.values()) // BLOCK)
    rows = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    counts = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("row", F.row_number().over(order) - 1).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("row"))
    placed = ranked.join(by_length, "length").withColumn("p", F.element_at(F.filter("plan", lambda p: p["rank0"] <= F.col("rank")), -1))
    at = F.col("rank") - F.col("p.rank0")
    return placed.select(
        F.col("doc_id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("p.seq0") + F.floor(at / F.col("p.copies"))).cast("long").alias("sequence_id"),
        (F.col("p.off0") + at % F.col("p.copies") * F.col("length")).cast("long").alias("offset"),
    )
