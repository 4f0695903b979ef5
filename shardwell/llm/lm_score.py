"""Language-model scores of texts by a hierarchical Pitman-Yor model.

A text is its words and an end; see hpyp for the model. Counts are of all training tokens; the known words and one
unknown word share the base, so unknown tokens have the probability that the freed mass gives them.

How it is spread: documents become blocks of tokens. Blocks and word buckets exchange packed words, (word, context)
counts and scores, so no row travels per token. After BURN_IN sweeps, the predictive probabilities of SAMPLES seatings
are averaged. Between sweeps each bucket sends its tables by context to the contexts' owners, which add them up and send
the sums back to the buckets that have the context; totals of the 257 restaurants above are sent to all. A context is known
by 47 bits of its word's hash and its last byte.

Defined results: null text counts as empty (one token, the end); a null id counts as "" for the fold; without training
rows every token has probability 1; repeated rows each get a row and each count; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hpyp
from .common import Scratch, fold

BURN_IN = 3
SAMPLES = 3
SEED = 7
#: Bytes of text in a block, and (block, word) entries for each word bucket.
BLOCK = 6 << 20
BUCKET_WORDS = 400_000


def _z(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _uz(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _pack_words(words: list[bytes]) -> bytes:
    return _z(b"\n".join(words))  # no word has a line break


def _unpack_words(b: bytes, n: int) -> list[bytes]:
    return _uz(b).split(b"\n") if n else []


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def token_blocks(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a block: ids, train and lens (tokens) of its documents, tokens (indices of words), and its distinct words."""
    names = ["block", "n_docs", "n_tokens", "n_words", "ids", "known_id", "train", "lens", "tokens", "words"]
    types = [pa.string(), *[pa.int64()] * 3, *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            index: dict[bytes, int] = {}
            put = index.setdefault
            tokens, lens = [], []
            for _, _, text in held:
                own = np.array([put(w, len(index)) for w in text.lower().split()] + [put(b"", len(index))], np.int32)
                tokens.append(own)
                lens.append(len(own))
            flat, lens_ = np.concatenate(tokens), np.array(lens, np.int64)
            learn = np.array([t for _, t, _ in held], bool)
            ids = np.array([i or 0 for i, _, _ in held], np.int64)
            row = (f"{part}-{made}", len(held), len(flat), len(index), ids.tobytes(), np.array([i is not None for i, _, _ in held], bool).tobytes(), learn.tobytes(), lens_.tobytes(), _z(flat.tobytes()), _pack_words(list(index)))
            held, size, made = [], 0, made + 1
            return _rows([row], names, types)

        for b in batches:
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.as_py()
                held.append((i, t, raw))
                size += len(raw) + 1
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), train.alias("train"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block string, n_docs long, n_tokens long, n_words long, ids binary, known_id binary, train binary, lens binary, tokens binary, words binary")


def context_ids(words: list[bytes]) -> np.ndarray:
    """What a word is called as a context: 47 bits of its hash, then its last byte; 0 is the start of a text."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(17)
    last = np.array([w[-1] if w else 0 for w in words], np.uint64)
    return (h << np.uint64(8) | last).view(np.int64)


def owner(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a word, as a word and as a context."""
    return (ids >> 8) % buckets


def _pack_ids(ids: np.ndarray) -> bytes:
    """Sorted ids: their steps, byte by byte, so that the high ones take no room."""
    return _z(np.ascontiguousarray(np.diff(ids, prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_ids(b: bytes) -> np.ndarray:
    raw = np.frombuffer(_uz(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).reshape(-1).view(np.int64), dtype=np.int64)


def _pairs(tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word << 32 | the word before + 1; 0 where a text begins) of a block, sorted, and each token's place among them."""
    before = np.r_[0, tokens[:-1].astype(np.int64) + 1] if len(tokens) else np.zeros(0, np.int64)
    before[(np.cumsum(lens) - lens)[lens > 0]] = 0
    return np.unique(tokens.astype(np.int64) << 32 | before, return_inverse=True)


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, places (of the words in the block), words, contexts, pairs (on the row's own words and contexts), counts (in training)."""
    names, types = ["bucket", "block", "n", "places", "words", "contexts", "pairs", "counts"], [pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = _unpack_words(r["words"], r["n_words"])
                lens = np.frombuffer(r["lens"], np.int64)
                pairs, at = _pairs(np.frombuffer(_uz(r["tokens"]), np.int32), lens)
                counts = np.bincount(at, np.repeat(np.frombuffer(r["train"], bool), lens), len(pairs)).astype(np.int32)
                ids = context_ids(words)
                to, ids = owner(ids, buckets), np.r_[0, ids]
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1))
                back = np.empty(len(words), np.int64)
                back[order] = np.arange(len(words))
                of = to[pairs >> 32]
                by = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[by], np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(cuts)):
                    p, q = order[cuts[k] : cuts[k + 1]], by[edges[k] : edges[k + 1]]
                    own = back[pairs[q] >> 32] - cuts[k]
                    met, which = np.unique(ids[pairs[q] & 0xFFFFFFFF], return_inverse=True)
                    packed = _z(own.astype(np.int32).tobytes() + which.astype(np.int32).tobytes())
                    rows.append((int(k), r["block"], len(p), _z(p.astype(np.int32).tobytes()), _pack_words([words[i] for i in p.tolist()]), _pack_ids(met), packed, _z(counts[q].tobytes())))
                yield _rows(rows, names, types)

    return blocks.select("block", "n_words", "words", "tokens", "lens", "train").mapInArrow(run, "bucket long, block string, n long, places binary, words binary, contexts binary, pairs binary, counts binary")


def _unpack_pairs(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(_uz(b), np.int32).astype(np.int64)
    return raw[: len(raw) // 2], raw[len(raw) // 2 :]


def _pack_dishes(dishes: hpyp.Dishes) -> bytes:
    x = dishes.levels[2]
    parts = np.diff(x.word, prepend=0).astype(np.int32), x.context.astype(np.int32), dishes.tokens
    return _z(pickle.dumps((*parts, dishes.last.astype(np.uint8))))


def _unpack_dishes(b: bytes) -> hpyp.Dishes:
    steps, context, tokens, last = pickle.loads(_uz(b))
    return hpyp.Dishes(np.cumsum(steps, dtype=np.int64) << 32 | context, tokens, last, 32)


def _send(contexts: np.ndarray, buckets: int, **values: np.ndarray) -> list[dict]:
    """What each owner of contexts (sorted) is told of them."""
    to = owner(contexts, buckets)
    by = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[by], np.arange(buckets + 1))
    cut = [(k, by[edges[k] : edges[k + 1]]) for k in np.flatnonzero(np.diff(edges)).tolist()]
    return [{"to": k, "values": _z(pickle.dumps({name: _small(v[at]) for name, v in values.items()}))} for k, at in cut]


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x


def _gather(contexts: np.ndarray, buckets: int, parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Rows of sums in the order of the contexts, from what their owners sent."""
    by = np.argsort(owner(contexts, buckets), kind="stable")
    found = np.concatenate([v for _, v in sorted(parts, key=lambda p: p[0])], axis=1) if parts else np.zeros((4, 0), np.int64)
    out = np.empty_like(found)
    out[:, by] = found
    return out


def _active(dishes: hpyp.Dishes) -> np.ndarray:
    """Contexts of dishes whose seating is open: those of more than one customer."""
    top = dishes.levels[2]
    return np.unique(top.context[top.c > 1])


SENDS = pa.list_(pa.struct([("to", pa.int64()), ("values", pa.binary())]))
SENT = "array<struct<to: long, values: binary>>"


def vocabulary(sent: DataFrame, buckets: int) -> DataFrame:
    """A row a bucket: its training words, the contexts asked of it, its dishes, totals, what it tells the owners
    of its contexts, and how many tokens and words it has."""

    def run(t: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        put = index.setdefault
        asked = t.select(["n", "words", "contexts", "pairs", "counts"]).to_pylist()
        contexts = np.unique(np.concatenate([_unpack_ids(r["contexts"]) for r in asked]))
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in asked:
            word, context = _unpack_pairs(r["pairs"])
            c = np.frombuffer(_uz(r["counts"]), np.int32)
            word, context, c = word[c > 0], context[c > 0], c[c > 0]
            seen, at = np.unique(word, return_inverse=True)
            names = _unpack_words(r["words"], r["n"])
            ids = np.array([put(names[k], len(index)) for k in seen.tolist()], np.int64)
            place = np.searchsorted(contexts, _unpack_ids(r["contexts"]))
            keys.append(ids[at] << 32 | place[context] if len(at) else word)
            counts.append(c.astype(np.int64))
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
        dishes = hpyp.Dishes(every, n, contexts & 0xFF, 32)
        above, top = dishes.totals()[:2], dishes.levels[2]
        go = _active(dishes)
        alone = np.bincount(top.context[top.c == 1], minlength=len(contexts))
        tables = np.bincount(top.context, top.t * (top.c > 1), len(contexts)).astype(np.int64)
        held = np.flatnonzero(np.bincount(top.context, minlength=len(contexts)))
        sends = _send(contexts[held], buckets, ids=contexts[held], alone=alone[held], go=np.isin(held, go), tables=tables[held])
        row = (t.column("bucket")[0].as_py(), len(index), _pack_words(list(index)), _pack_ids(contexts), _pack_dishes(dishes), pickle.dumps(above), sends, int(n.sum()))
        return pa.Table.from_batches([_rows([row], ["bucket", "n", "words", "contexts", "dishes", "totals", "sends", "tokens"], [pa.int64(), pa.int64(), *[pa.binary()] * 4, SENDS, pa.int64()])])

    return sent.select("bucket", "n", "words", "contexts", "pairs", "counts").groupBy("bucket").applyInArrow(run, f"bucket long, n long, words binary, contexts binary, dishes binary, totals binary, sends {SENT}, tokens long")


def _mail(table: DataFrame) -> DataFrame:
    return table.select("bucket", F.explode("sends").alias("s")).select(F.col("s.to").alias("to"), "bucket", F.col("s.values").alias("values"))


def directory(vocab: DataFrame) -> DataFrame:
    """to, bucket, places, alone, first: where the open contexts of a bucket stand in their owner's list, their tables of
    one customer in all buckets, and all their tables before the first sweep."""

    def run(t: pa.Table) -> pa.Table:
        rows = [(r["to"], r["bucket"], pickle.loads(_uz(r["values"]))) for r in t.select(["to", "bucket", "values"]).to_pylist()]
        every, at = np.unique(np.concatenate([v["ids"] for *_, v in rows]), return_inverse=True)
        alone, tables = (np.bincount(at, np.concatenate([v[name] for *_, v in rows]), len(every)).astype(np.int64) for name in ("alone", "tables"))
        go = [np.flatnonzero(v["go"]) for *_, v in rows]
        start = np.cumsum([0, *(len(v["ids"]) for *_, v in rows)])
        some, place = np.unique(np.concatenate([at[s + g] for s, g in zip(start, go, strict=False)]), return_inverse=True)
        ends = np.cumsum([0, *map(len, go)])
        out = []
        for k, (to, bucket, _) in enumerate(rows):
            p = place[ends[k] : ends[k + 1]]
            if len(p):
                mine = alone[some[p]]
                out.append((to, bucket, _z(p.astype(np.int32).tobytes()), _z(mine.tobytes()), _z((mine + tables[some[p]]).tobytes())))
        return pa.Table.from_batches([_rows(out, ["to", "bucket", "places", "alone", "first"], [pa.int64(), pa.int64(), *[pa.binary()] * 3])])

    return _mail(vocab).groupBy("to").applyInArrow(run, "to long, bucket long, places binary, alone binary, first binary")


def added(listed: DataFrame, table: DataFrame) -> DataFrame:
    """bucket, owner, values: the tables of its open contexts, summed over all buckets."""

    def run(key: tuple, own: pa.Table, mail: pa.Table) -> pa.Table:
        listed = {r["bucket"]: (np.frombuffer(_uz(r["places"]), np.int32), np.frombuffer(_uz(r["alone"]), np.int64)) for r in own.to_pylist()}
        total = np.zeros(1 + max((int(p.max()) for p, _ in listed.values()), default=0), np.int64)
        for r in mail.to_pylist():
            total[listed[r["bucket"]][0]] += pickle.loads(_uz(r["values"]))["tables"]  # a bucket names a context once
        rows = [(b, key[0].as_py(), _z((total[p] + alone).tobytes())) for b, (p, alone) in listed.items()]
        return pa.Table.from_batches([_rows(rows, ["bucket", "owner", "values"], [pa.int64(), pa.int64(), pa.binary()])])

    return listed.groupBy("to").cogroup(_mail(table).groupBy("to")).applyInArrow(run, "bucket long, owner long, values binary")


def summed(table: DataFrame, samples: int) -> DataFrame:
    """bucket, owner, values: customers and each sample's tables of every context that a bucket was asked about."""

    def run(t: pa.Table) -> pa.Table:
        rows = [(r["to"], r["bucket"], pickle.loads(_uz(r["values"]))) for r in t.select(["to", "bucket", "values"]).to_pylist()]
        every, at = np.unique(np.concatenate([v["ids"] for *_, v in rows]), return_inverse=True)
        total = np.stack([np.bincount(at, np.concatenate([v[name] for *_, v in rows]), len(every)).astype(np.int64) for name in ("guests", *map(str, range(samples)))])
        start = np.cumsum([0, *(len(v["ids"]) for *_, v in rows)])
        out = [(b, to, _z(total[:, at[start[k] : start[k + 1]]].tobytes())) for k, (to, b, _) in enumerate(rows)]
        return pa.Table.from_batches([_rows(out, ["bucket", "owner", "values"], [pa.int64(), pa.int64(), pa.binary()])])

    return _mail(table).groupBy("to").applyInArrow(run, "bucket long, owner long, values binary")


def _totals(table: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Customers and tables of the restaurants above words, over all buckets: a row for each of 257 at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(n), np.zeros(n)) for n in hpyp.PLACES]
        for batch in batches:
            for b in batch.column(0).to_pylist():
                for (c, t), (dc, dt) in zip(total, pickle.loads(b), strict=True):
                    c += dc
                    t += dt
        rows = [(level, int(k), int(c[k]), int(t[k])) for level, (c, t) in enumerate(total) for k in np.flatnonzero(c)]
        yield _rows(rows, ["level", "place", "c", "t"], [pa.int64()] * 4)

    rows = table.select("totals").mapInArrow(add, "level long, place long, c long, t long").groupBy("level", "place").agg(F.sum("c"), F.sum("t")).collect()
    out = [(np.zeros(n), np.zeros(n)) for n in hpyp.PLACES]
    for level, k, c, t in rows:
        out[level][0][k], out[level][1][k] = c, t
    return out


def train(vocab: DataFrame, scratch: Scratch, base: float, buckets: int, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = SEED) -> tuple[DataFrame, list]:
    """bucket, state (the samples' seats), sums (customers and the samples' tables by context), and the totals above at
    each sample."""
    steps, kept = burn_in + samples, []

    def turn(step: int, sent: list) -> Callable:
        def run(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
            contexts, dishes = _unpack_ids(own.column("contexts")[0].as_py()), _unpack_dishes(own.column("dishes")[0].as_py())
            open_, (now, held), parts = _active(dishes), (None, []), []
            for r in got.to_pylist():
                if r["owner"] < 0:
                    now, held = pickle.loads(_uz(r["values"]))
                else:
                    parts.append((r["owner"], np.frombuffer(_uz(r["values"]), np.int64)[None, :]))
            tables = np.zeros(len(contexts), np.int64)
            if parts:
                tables[open_] = _gather(contexts[open_], buckets, parts)[0]
            if now is not None:
                dishes.seat(now)
            dishes.sweep(base, [*sent, (None, tables)], np.random.default_rng((seed, step, key[0].as_py())))
            now, top = dishes.seats(), dishes.levels[2]
            held = [*held, now] if step >= burn_in else held
            if step < steps - 1:
                mine = np.bincount(top.context, top.t * (top.c > 1), len(contexts))[open_].astype(np.int64)
                sends = _send(contexts[open_], buckets, tables=mine)
            else:
                by = {str(k): np.bincount(top.context, s[2], len(contexts)).astype(np.int64) for k, s in enumerate(held)}
                guests, now = np.bincount(top.context, dishes.tokens, len(contexts)).astype(np.int64), None
                sends = _send(contexts, buckets, ids=contexts, guests=guests, **by)
            row = (key[0].as_py(), _z(pickle.dumps((now, held))), pickle.dumps(dishes.totals()[:2]), sends)
            return pa.Table.from_batches([_rows([row], ["bucket", "state", "totals", "sends"], [pa.int64(), pa.binary(), pa.binary(), SENDS])])

        return run

    listed = scratch.write(directory(vocab), "directory", codec="none")
    first = listed.select("bucket", F.col("to").alias("owner"), F.col("first").alias("values"))
    table, totals = vocab, _totals(vocab)
    for step in range(steps):
        parts = added(listed, table) if step else first
        if step:
            parts = parts.unionByName(table.select("bucket", F.lit(-1).cast("long").alias("owner"), F.col("state").alias("values")))
        new = vocab.select("bucket", "dishes", "contexts").groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(turn(step, totals), f"bucket long, state binary, totals binary, sends {SENT}")
        new = scratch.write(new, f"state{step}", codec="none")
        scratch.drop(f"state{step - 1}")
        table, totals = new, _totals(new)
        if step >= burn_in:
            kept.append(totals)
    sums = summed(table, samples).groupBy("bucket").agg(F.collect_list(F.struct("owner", "values")).alias("sums"))
    return table.select("bucket", "state").join(sums, "bucket"), kept


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row; learn: which rows train."""
    scratch = Scratch(docs.sparkSession, "lm")
    blocks = scratch.write(token_blocks(docs, learn, id_col, text_col), "blocks", codec="none")
    words = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(4, words // BUCKET_WORDS)
    sent = scratch.write(requests(blocks, buckets), "requests", codec="none")
    vocab = scratch.write(vocabulary(sent, buckets), "vocabulary", codec="none")
    n, kinds = (x or 0 for x in vocab.agg(F.sum("tokens"), F.sum("n")).first())
    base = 1 / (kinds + 1)
    state, kept = train(vocab, scratch, base, buckets)

    def answer(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        o = own.to_pylist()[0]
        index = {w: k for k, w in enumerate(_unpack_words(o["words"], o["n"]))}
        model, (_, held) = _unpack_dishes(o["dishes"]), pickle.loads(_uz(o["state"]))
        contexts = _unpack_ids(o["contexts"])
        guests, *tables = _gather(contexts, buckets, [(p["owner"], np.frombuffer(_uz(p["values"]), np.int64).reshape(len(held) + 1, -1)) for p in o["sums"]])
        totals = []
        for above, seats, own_tables in zip(kept, held, tables, strict=True):
            model.seat(seats)
            model.keep()
            totals.append([*above, (guests, own_tables)])
        known = np.r_[np.bincount(model.levels[2].word, model.tokens, len(index)).astype(np.int64), 0]  # the last: unknown
        rows = []
        for r in asked.select(["block", "n", "places", "words", "contexts", "pairs"]).to_pylist():
            ids = np.array([index.get(w, -1) for w in _unpack_words(r["words"], r["n"])], np.int64)
            word, context = _unpack_pairs(r["pairs"])
            at = np.searchsorted(contexts, _unpack_ids(r["contexts"]))
            logs = np.log10(model.prob(ids[word] << 32 | at[context], base, totals)).astype(np.float32)
            rows.append((r["block"], r["places"], _z(known[ids].tobytes()), _z(logs.tobytes())))
        return pa.Table.from_batches([_rows(rows, ["block", "places", "counts", "logs"], [pa.string(), *[pa.binary()] * 3])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            for r in batch.to_pylist():
                flat, lens = np.frombuffer(_uz(r["tokens"]), np.int32), np.frombuffer(r["lens"], np.int64)
                pairs, at = _pairs(flat, lens)
                c, bucket, logs = np.zeros(r["n_words"], np.int64), np.full(r["n_words"], -1, np.int64), np.zeros(len(pairs))
                for k, a in enumerate(r["answers"]):
                    p = np.frombuffer(_uz(a["places"]), np.int32)
                    c[p], bucket[p] = np.frombuffer(_uz(a["counts"]), np.int64), k
                of = bucket[pairs >> 32]
                by = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[by], np.arange(len(r["answers"]) + 1))
                for k, a in enumerate(r["answers"]):
                    logs[by[edges[k] : edges[k + 1]]] = np.frombuffer(_uz(a["logs"]), np.float32)
                plain = np.log10((c + 0.5) / (n + 0.5 * (kinds + 1)))
                start = np.cumsum(lens) - lens
                sums = [np.add.reduceat(x, start) for x in ((c > 0).astype(np.int64)[flat], plain[flat], logs[at])]
                ids = [i if k else None for i, k in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["known_id"], bool).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, np.frombuffer(r["train"], bool), lens, *sums), types, strict=True)], names=names)

    asked = sent.select("bucket", "block", "n", "places", "words", "contexts", "pairs")
    model = vocab.select("bucket", "n", "words", "contexts", "dishes").join(state, "bucket")
    replies = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, "block string, places binary, counts binary, logs binary")
    replies = scratch.write(replies, "replies", codec="none")
    scratch.drop("requests")
    gathered = replies.groupBy("block").agg(F.collect_list(F.struct("places", "counts", "logs")).alias("answers"))
    out = blocks.select("block", "n_words", "ids", "known_id", "train", "lens", "tokens").join(gathered, "block").mapInArrow(finish, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").alias(id_col), "train", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def query(docs: DataFrame) -> DataFrame:
    out = scores(docs, fold("doc_id") != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
