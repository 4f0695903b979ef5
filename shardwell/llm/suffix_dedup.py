"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when some `least`-byte string that covers it also starts in a document with a smaller id. Suffixes that
share their first `least` bytes must meet; they are brought together without shipping the corpus:

1. Blocks. Each task concatenates its documents into blocks and picks, for every window of `least` bytes, its minimizer:
   the seed of SEED bytes with the smallest hash. It depends on the window's bytes only, so equal windows have equal
   seeds; consecutive windows mostly share theirs, and such a run of windows is a unit.
2. Repeats. Blocks send the hashes of their seeds, packed, to buckets; a bucket answers each block with one bit a seed:
   whether another document has it. Units of other seeds cannot hold a repeated window.
3. Kinds. Blocks send the hashes (64 bits) of the bytes of the units whose seeds repeat, with the smallest document of
   each; a bucket answers whether a smaller document elsewhere has these bytes, and whether the seed has other bytes
   around it. Copies of a whole unit are settled so, and only units whose seed stands in unlike units send their bytes, one
   for the copies of each.
4. Factors. Buckets, dealt by seed, sort the suffixes of the units (which end with their unit), take the whole longest
   common prefixes of neighbours, and find for each suffix the previous and the next one in suffix order that stands in
   a smaller document: the longer of the two common prefixes is its longest previous factor. Seeds that occur in very
   many blocks are split: each window goes by its own bytes.
5. Coverage. What factors of `least` bytes or more cover goes back to the blocks, which cut their documents.

Answers, seeds and units travel as packed binary columns, so shuffles stay below the size of the input.

Defined results: null text counts as empty; rows with a null id neither lose bytes nor make others lose them; rows that
share an id do not make each other lose bytes, and each gets a row; texts shorter than `least` bytes lose nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAST = 50
SEED = 20
#: Bytes of text in a block, and of the input for each bucket.
BLOCK = 3 << 20
BUCKET = 4 << 20
#: A seed in more blocks than this has its windows dealt one by one.
HOT_BLOCKS = 64
_STEP = 1 << 22
#: Buckets that travel together, in larger payloads that compress alike at every size, and are sorted one after another.
TOGETHER = 8


def _pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(a.tobytes())


def _unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def minimizers(buf: np.ndarray, least: int = LEAST, seed: int = SEED) -> np.ndarray:
    """For every window start the position of its seed: the smallest hash in the window, leftmost of equals."""
    n = len(buf) - least + 1
    out = np.zeros(max(n, 0), np.int64)
    for at in range(0, n, _STEP):
        part = buf[at : min(at + _STEP, n) + least - 1]
        total, length, have = None, 0, part.astype(np.uint64) + np.uint64(1)
        base, size, rest = np.array([0x9E3779B97F4A7C15], np.uint64), 1, seed
        while True:  # polynomial hashes of 1, 2, 4, ... bytes, put together to seed bytes
            if rest & 1:
                if total is None:
                    total, length = have, size
                else:
                    m = len(have) - length
                    total = total[:m] * base + have[length:]
                    length += size
            rest >>= 1
            if not rest:
                break
            have = have[:-size] * base + have[size:]
            base, size = base * base, size * 2
        low = np.uint64((1 << 24) - 1)
        v = (_mix(total) & ~low) | np.arange(len(total), dtype=np.uint64)
        width, size = least - seed + 1, 1
        while 2 * size <= width:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < width:
            v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
        out[at : at + len(v)] = (v & low).astype(np.int64) + at
    return out


def units(buf: np.ndarray, lens: np.ndarray, real: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and seed position of each unit; real: documents that take part."""
    n = len(buf) - least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    ends = np.cumsum(lens)
    inside = np.zeros(n + 1, np.int32)
    ok = real & (lens >= least)
    np.add.at(inside, (ends - lens)[ok], 1)
    np.add.at(inside, (ends - least + 1)[ok], -1)
    valid = np.cumsum(inside[:n]) > 0
    where = minimizers(buf, least, seed)
    doc_start = np.zeros(n + 1, bool)
    doc_start[(ends - lens)[ok]] = True
    cut = np.r_[True, (where[1:] != where[:-1]) | (valid[1:] != valid[:-1])] | doc_start[:n]
    first = np.flatnonzero(cut)
    count = np.diff(np.r_[first, n])
    keep = valid[first]
    return first[keep], count[keep], where[first[keep]]


def seed_hashes(buf: np.ndarray, at: np.ndarray, seed: int = SEED) -> np.ndarray:
    """64-bit hashes of the seeds at the positions."""
    padded = np.r_[buf, np.zeros(8, np.uint8)]
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    h = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for k in [*range(0, seed - 7, 8), *([seed - 8] if seed % 8 else [])]:
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    return h


class Block:
    """A row of the block table, unpacked."""

    def __init__(self, row: dict):
        self.name, self.least, self.seed = row["block"], row["least"], row["seed"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.real = np.frombuffer(row["real"], np.uint8).astype(bool)
        self.lens = np.frombuffer(row["lens"], "<i8")
        self.buf = _unpack(row["text"], "u1")
        tags = _unpack(row["units"], "u1").reshape(2, -1).astype(np.int64)
        self.count, off = tags
        first = np.zeros(len(self.count), np.int64)
        ok = self.real & (self.lens >= self.least)
        starts = (np.cumsum(self.lens) - self.lens)[ok]
        windows = (self.lens - self.least + 1)[ok]
        done = np.cumsum(self.count) - self.count  # windows before each unit; they tile the documents
        before = np.cumsum(windows) - windows
        doc = np.searchsorted(before, done, side="right") - 1
        if len(first):
            first = starts[doc] + done - before[doc]
        self.first, self.at = first, first + off
        self.doc = np.flatnonzero(ok)[doc] if len(first) else np.zeros(0, np.int64)
        self.hash = seed_hashes(self.buf, self.at, self.seed)


def make_blocks(docs: DataFrame, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, size, made
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            real = np.array([i is not None for i in ids], bool)
            buf = np.frombuffer(b"".join(texts), np.uint8)
            first, count, at = units(buf, lens, real, least, seed)
            row = {
                "block": f"{part}-{made}", "least": least, "seed": seed, "n_bytes": len(buf), "ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "real": real.astype(np.uint8).tobytes(),
                "lens": lens.tobytes(), "text": _pack(buf, 3), "units": _pack(np.stack([count, at - first]).astype(np.uint8)),
            }
            ids, texts, size, made = [], [], 0, made + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    assert least - seed < 250
    schema = pa.schema([("block", pa.string()), ("least", pa.int32()), ("seed", pa.int32()), ("n_bytes", pa.int64()), *((c, pa.binary()) for c in ("ids", "real", "lens", "text", "units"))])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block string, least int, seed int, n_bytes long, ids binary, real binary, lens binary, text binary, units binary")


def _split(key: np.ndarray, *rest: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of sorted keys, key by key."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=False):
        yield int(key[a]), [r[a:b] for r in rest]


def _distinct_seeds(b: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and low bits of each distinct seed, sorted; whether two documents of the block have it; unit -> seed."""
    bucket = (b.hash >> np.uint64(40)) % np.uint64(buckets)
    low = b.hash & np.uint64((1 << 40) - 1)
    order = np.lexsort((low, bucket))
    k, m = bucket[order], low[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])] if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    doc = b.ids[b.doc][order]
    several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start) if len(start) else np.zeros(0, bool)
    back = np.empty(len(k), np.int64)
    back[order] = group
    return bucket[order][start].astype(np.int64), m[start], several, back


def repeats(blocks: DataFrame, buckets: int, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """block, bucket, bits, hot: for each distinct seed of the block in the bucket, whether it repeats, and is hot."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                b = Block(batch.slice(n, 1).to_pylist()[0])
                bucket, low, several, _ = _distinct_seeds(b, buckets)
                rows = [(k, b.name, m.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.packbits(s).tobytes()) for k, (m, s) in _split(bucket, low, several)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "low", "several"])

    def answer(t: pa.Table) -> pa.Table:
        names, low, flags = t.column("block").to_pylist(), [], []
        for raw, f in zip(t.column("low").to_pylist(), t.column("several").to_pylist(), strict=True):
            n = len(raw) // 5
            x = np.zeros((n, 8), np.uint8)
            x[:, :5] = np.frombuffer(raw, np.uint8).reshape(n, 5)
            low.append(x.reshape(-1).view("<u8"))
            flags.append(np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(np.int32))
        sizes = [len(x) for x in low]
        _, at, many = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
        own = np.bincount(at, np.concatenate(flags), len(many))
        repeated, hot = (many > 1) | (own > 0), many > hot_blocks
        cuts = np.cumsum(sizes)[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(repeated[at], cuts)]
        hots = [np.packbits(x).tobytes() for x in np.split(hot[at], cuts)]
        return pa.table({"block": pa.array(names, pa.string()), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(hots, pa.binary())})

    sent = blocks.mapInArrow(send, "bucket long, block string, low binary, several binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block string, bucket long, bits binary, hot binary")


def _planes(a: np.ndarray) -> bytes:
    """Numbers, byte by byte, so that the high bytes take no room."""
    return _pack(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T))


def _from_planes(b: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, "u1").reshape(8, -1).T).reshape(-1).view(dtype)


class Kinds:
    """The units of a block whose seeds repeat (of hot seeds each window by itself) and, for each kind of them (bytes), the
    bucket of eight that it is dealt to, its seed, the hash of its bytes and the block's smallest document that has it."""

    def __init__(self, b: Block, answers: list[dict], buckets: int):
        bucket, _, _, back = _distinct_seeds(b, buckets)
        repeated, hot = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
        begin = {k: (m[0], len(m)) for k, (m,) in _split(bucket, np.arange(len(bucket)))}
        for a in answers:
            at, n = begin[a["bucket"]]
            repeated[at : at + n] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n)
            hot[at : at + n] = np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=n)
        pick = np.flatnonzero(repeated[back])
        first, count, h, single = b.first[pick], b.count[pick], b.hash[pick], hot[back[pick]]
        doc = b.ids[b.doc[pick]]
        k = np.repeat(np.flatnonzero(single), count[single])
        step = np.arange(len(k)) - np.repeat(np.cumsum(count[single]) - count[single], count[single])
        self.first = np.r_[first[~single], first[k] + step]
        self.count = np.r_[count[~single], np.ones(len(k), np.int64)]
        self.doc = np.r_[doc[~single], doc[k]]
        begins, ends = (seed_hashes(b.buf, at, b.least) for at in (self.first, self.first + self.count - 1))  # together all its bytes
        content = _mix(begins * np.uint64(0x9E3779B97F4A7C15) + ends) ^ self.count.astype(np.uint64)
        self.seed = np.r_[h[~single], begins[(~single).sum() :]]  # of a hot seed: the window's own bytes
        self.to = ((self.seed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        low = self.seed & np.uint64((1 << 40) - 1)
        order = np.lexsort((self.doc, content, low, self.to // TOGETHER))
        keys = [x[order] for x in (self.to // TOGETHER, low, content)]
        new = np.r_[True, np.any([x[1:] != x[:-1] for x in keys], axis=0)] if len(order) else np.zeros(0, bool)
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.bucket, self.low, self.content = (x[new] for x in keys)
        self.smallest = self.doc[order][new]


def kinds(blocks: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, bits, hot: for each kind of unit of the block in the bucket, whether a smaller document of another
    block has it, and whether its seed has other kinds."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                k = Kinds(Block(row), row["answers"] or [], buckets)
                rows = [(to, row["block"], len(low), _planes(np.diff(low, prepend=np.uint64(0))), content.tobytes(), _planes(doc)) for to, (low, content, doc) in _split(k.bucket, k.low, k.content, k.smallest)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "block", "n", "low", "content", "doc"])

    def answer(t: pa.Table) -> pa.Table:
        low = np.concatenate([np.cumsum(_from_planes(b, "<u8"), dtype=np.uint64) for b in t.column("low").to_pylist()])
        content = np.concatenate([np.frombuffer(b, "<u8") for b in t.column("content").to_pylist()])
        doc = np.concatenate([_from_planes(b, "<i8") for b in t.column("doc").to_pylist()])
        order = np.lexsort((doc, content, low))
        seed = np.r_[True, low[order][1:] != low[order][:-1]]
        new = seed | np.r_[True, content[order][1:] != content[order][:-1]]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        older, several = np.empty(len(order), bool), np.empty(len(order), bool)
        older[order] = doc[order][head] < doc[order]
        several[order] = (np.add.reduceat(new.astype(np.int64), np.flatnonzero(seed)) > 1)[np.cumsum(seed) - 1]
        cuts = np.cumsum(t.column("n").to_numpy())[:-1]
        bits, more = ([np.packbits(x).tobytes() for x in np.split(y, cuts)] for y in (older, several))
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary()), "hot": pa.array(more, pa.binary())})

    types = (pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 3)
    gathered = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("answers"))
    sent = blocks.join(gathered, "block").mapInArrow(send, "bucket long, block string, n long, low binary, content binary, doc binary")
    return sent.groupBy("bucket").applyInArrow(answer, "block string, bucket long, bits binary, hot binary")


def candidates(blocks: DataFrame, found: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """bucket, block and packed units (ids, positions, windows, bytes); without bytes: windows that are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                rows = _candidates(Block(row), *([a for a in row["answers"] if a["told"] == t] for t in (False, True)), buckets)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "block", "part", "ids", "pos", "count", "bytes"])

    types = (pa.int64(), pa.string(), *[pa.binary()] * 5)
    both = found.withColumn("told", F.lit(False)).unionByName(told.withColumn("told", F.lit(True)))
    gathered = both.groupBy("block").agg(F.collect_list(F.struct("told", "bucket", "bits", "hot")).alias("answers"))
    return blocks.join(gathered, "block").mapInArrow(run, "bucket long, block string, part binary, ids binary, pos binary, count binary, bytes binary")


def _candidates(b: Block, answers: list[dict], told: list[dict], buckets: int) -> list[tuple]:
    k = Kinds(b, answers, buckets)
    if not len(k.first):
        return []
    older, several = np.zeros(len(k.bucket), bool), np.zeros(len(k.bucket), bool)
    begin = {to: (m[0], len(m)) for to, (m,) in _split(k.bucket, np.arange(len(k.bucket)))}
    for a in told:
        at, n = begin[a["bucket"]]
        older[at : at + n] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n)
        several[at : at + n] = np.unpackbits(np.frombuffer(a["hot"], np.uint8), count=n)
    settled = older[k.kind] | (k.doc > k.smallest[k.kind])  # a smaller document has all of its windows
    out = []
    if settled.any():
        order = np.argsort(k.first[settled])
        first, end = k.first[settled][order], (k.first + k.count)[settled][order]
        new = np.r_[True, first[1:] > end[:-1]]  # windows of one document follow each other; the next one's stand apart
        first, end = first[new], end[np.r_[new[1:], True]]
        out.append((zlib.crc32(b.name.encode()) % buckets // TOGETHER, b.name, b"", b"", _pack(first.astype("<i8")), _pack((end - first).astype("<i8")), b""))
    go = np.flatnonzero(~settled & several[k.kind])
    go = go[np.lexsort((k.first[go], k.to[go]))]
    most = int(k.count.max()) + b.least - 1
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[b.buf, np.zeros(most, np.uint8)], most)
    for bucket, (u,) in _split(k.to[go] // TOGETHER, go):
        mask = np.arange(most)[None, :] < (k.count[u] + b.least - 1)[:, None]
        out.append((bucket, b.name, _pack((k.to[u] % TOGETHER).astype("<u1")), _pack(k.doc[u].astype("<i8")), _pack(k.first[u].astype("<i8")), _pack(k.count[u].astype("<u1")), _pack(windows[k.first[u]][mask], 3)))
    return out


def previous_factors(docs: np.ndarray, common: np.ndarray, need: int) -> np.ndarray:
    """Length of the longest factor of at least `need` (else 0) that each suffix, given in suffix order, shares with one
    of a smaller document.

    common[k]: longest common prefix of suffixes k - 1 and k. For either direction a suffix looks at its neighbour; as
    long as that one's document is no smaller, it takes over the neighbour's own pointer, and of the common prefixes
    passed the smallest counts.
    """
    n = len(docs)
    best = np.zeros(n, np.int64)
    for backward in (True, False):
        d = docs if backward else docs[::-1]
        c = common if backward else np.r_[0, common[1:][::-1]]
        at, low = np.arange(n) - 1, c.astype(np.int64).copy()
        low[low < need] = 0
        open_ = np.flatnonzero((low > 0) & (at >= 0))
        open_ = open_[d[at[open_]] >= d[open_]]
        while len(open_):
            via = at[open_]
            low[open_] = np.minimum(low[open_], low[via])
            at[open_] = at[via]
            low[open_[at[open_] < 0]] = 0
            open_ = open_[low[open_] > 0]
            open_ = open_[d[at[open_]] >= d[open_]]
        low[at < 0] = 0
        best = np.maximum(best, low if backward else low[::-1])
    return best


def _keyed(text: np.ndarray, base: np.ndarray, size: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """The strings at base, filled up with zeros, with their size as a last byte (so zeros at their ends count)."""
    most = int(size.max(initial=0))
    padded = np.r_[text, np.zeros(most, np.uint8)]
    out = np.empty((len(base), most + 1), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, most) if most else None
    for a in range(0, len(base), chunk):
        z = min(a + chunk, len(base))
        out[a:z, :most] = view[base[a:z]]
        out[a:z, :most][np.arange(most)[None, :] >= size[a:z, None]] = 0
        out[a:z, most] = size[a:z]
    return out


def representatives(text: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each unit, given in order of document, the first one of the same bytes."""
    keyed = _keyed(text, base, size)
    order = np.argsort(keyed.view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    same = np.r_[False, (keyed[order[1:]] == keyed[order[:-1]]).all(axis=1)]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.empty(len(order), np.int64)
    out[order] = order[head]
    return out


def longest_previous(text: np.ndarray, base: np.ndarray, count: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """The longest previous factor, of `least` bytes or more (else 0), of each of the first `count` suffixes of each
    unit: units are given in order of document, and suffixes end with their unit."""
    unit = np.repeat(np.arange(len(base)), count)
    step = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    size = count[unit] + least - 1 - step
    if not len(unit):
        return np.zeros(0, np.int64)
    keyed = _keyed(text, base[unit] + step, size)
    suffix = np.argsort(keyed.view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    common = np.zeros(len(suffix), np.int64)
    for a in range(1, len(suffix), 1 << 18):
        i, j = suffix[a : a + (1 << 18)], suffix[a - 1 : min(a - 1 + (1 << 18), len(suffix) - 1)]
        differ = keyed[i, :-1] != keyed[j, :-1]
        common[a : a + len(i)] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), keyed.shape[1]), np.minimum(size[i], size[j]))
    out = np.zeros(len(unit), np.int64)
    out[suffix] = previous_factors(ids[unit[suffix]], common, least)
    return out


def covered(ids: np.ndarray, count: np.ndarray, rep: np.ndarray, own: np.ndarray, length: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Unit, first window and number of windows of the runs that factors cover. A copy of a smaller document's unit is
    covered as a whole; copies within one document are covered alike."""
    later = np.flatnonzero(ids > ids[rep])
    yield later, np.zeros(len(later), np.int64), count[later]
    start = np.cumsum(count[own]) - count[own]
    edge = np.zeros(len(length) + 1, np.int64)
    at = np.flatnonzero(length)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at] - least + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    unit = np.repeat(np.arange(len(own)), count[own])
    new = inside & ~np.r_[False, inside[:-1] & (unit[1:] == unit[:-1])]
    end = inside & ~np.r_[inside[1:] & (unit[1:] == unit[:-1]), False]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    of = unit[first]  # sorted
    rest = np.flatnonzero(ids == ids[rep])
    slot = np.searchsorted(own, rep[rest])
    low, high = np.searchsorted(of, slot), np.searchsorted(of, slot, side="right")
    many = high - low
    k = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    yield np.repeat(rest, many), first[k] - start[of[k]], last[k] - first[k] + 1


def factors(cands: DataFrame, least: int = LEAST) -> DataFrame:
    """block, pos, count: runs of windows that a smaller document has too."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = [(r["block"], r["pos"], r["count"]) for r in rows if not r["bytes"]]
        rows = [r for r in rows if r["bytes"]]
        if rows:
            out += within(rows)
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"block": pa.array(cols[0], pa.string()), "pos": pa.array(cols[1], pa.binary()), "count": pa.array(cols[2], pa.binary())})

    def within(rows: list[dict]) -> list[tuple]:
        ids, pos, count = (np.concatenate([_unpack(r[c], d) for r in rows]) for c, d in (("ids", "<i8"), ("pos", "<i8"), ("count", "u1")))
        sizes = [len(_unpack(r["part"], "u1")) for r in rows]
        part = np.concatenate([_unpack(r["part"], "u1") for r in rows])
        text = np.concatenate([_unpack(r.pop("bytes"), "u1") for r in rows])
        row, count = np.repeat(np.arange(len(rows)), sizes), count.astype(np.int64)
        base = np.cumsum(count + least - 1) - (count + least - 1)
        found_r, found_p, found_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            mine = mine[np.argsort(ids[mine], kind="stable")]
            rep = representatives(text, base[mine], count[mine] + least - 1)
            own = np.unique(rep)
            length = longest_previous(text, base[mine[own]], count[mine[own]], ids[mine[own]], least)
            for r, p, n in covered(ids[mine], count[mine], rep, own, length, least):
                found_r.append(row[mine[r]])
                found_p.append(pos[mine[r]] + p)
                found_n.append(n)
        r, p, n = np.concatenate(found_r), np.concatenate(found_p), np.concatenate(found_n)
        order = np.lexsort((p, r))
        r, p, n = r[order], p[order], n[order]
        return [(rows[k]["block"], _pack(a.astype("<i8")), _pack(c.astype("<i8"))) for k, (a, c) in _split(r, p, n)]

    return cands.groupBy("bucket").applyInArrow(run, "block string, pos binary, count binary")


def cut(blocks: DataFrame, runs: DataFrame, want_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                b = Block(row)
                edge = np.zeros(len(b.buf) + 1, np.int32)
                for a in row["answers"] or []:
                    pos, count = _unpack(a["pos"], "<i8"), _unpack(a["count"], "<i8")
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + count + b.least - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.cumsum(b.lens)
                out = []
                for i, real, z, m in zip(b.ids.tolist(), b.real.tolist(), ends.tolist(), b.lens.tolist(), strict=True):
                    g, text = gone[z - m : z], b.buf[z - m : z]
                    lost = int(g.sum())
                    kept = (text[~g] if lost else text).tobytes()
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if lost else 0
                    out.append((i if real else None, m, lost, spans, hashlib.sha256(kept).hexdigest(), kept if want_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    gathered = runs.groupBy("block").agg(F.collect_list(F.struct("pos", "count")).alias("answers"))
    out = blocks.join(gathered, "block", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if want_text else out.drop("kept")


def remove_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", want_text: bool = False) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    seed = min(SEED, least)
    blocks = scratch.write(make_blocks(docs, least, seed, id_col, text_col), "blocks", codec="none")
    buckets = max(64, (blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET)
    found = scratch.write(repeats(blocks, buckets), "repeats", codec="none")
    told = scratch.write(kinds(blocks, found, buckets), "kinds", codec="none")
    runs = scratch.write(factors(candidates(blocks, found, told, buckets), least), "runs", codec="none")
    return cut(blocks, runs, want_text).withColumnRenamed("doc_id", id_col)
