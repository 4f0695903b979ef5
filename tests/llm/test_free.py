"""The other operators against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardwell.llm import exact_dedup, hpyp, lm_score, packing, passages, queries, simhash, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, keep_id long, fp long, block string, length long"
ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "a"), (904, "A"), (None, "no id"), (905, "twice"), (905, "twice"), (906, "x " * 30_000), (907, "\x00" * 130), (908, "é" * 90), (909, "é" * 90 + "y")]


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 7, 7, "b", 1) for r in rows], SCHEMA).repartition(5)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return (t or "").encode().lower().split()


def test_exact(docs, rows):
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(docs).collect()), key=str)
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for i, keep, n, kept, digest in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == digest)
        top = max((x for x in own if x is not None), default=None)
        assert keep == top and n == len(own) and (not kept or i == top)
    assert len(got) == len(rows) and sum(r[3] for r in got) == len(groups)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_grace_spills():
    r = random.Random(1)
    texts = [str(r.randrange(300)).encode() * 50 for _ in range(3000)]
    found = list(exact_dedup.grace(((hashlib.sha256(t).digest(), t, k, 1, 1) for k, t in enumerate(texts)), budget=4000))
    assert {x[1]: x[3] for x in found} == Counter(texts)
    assert {x[1]: x[2] for x in found} == {t: k for k, t in enumerate(texts)}


def fingerprint(t):
    import xxhash

    w = words(t)
    if not w:
        return 0
    hs = [xxhash.xxh64(b" ".join(w[k : k + 3]), seed=42).intdigest() for k in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def components(fps, radius=2):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(len(fps))]


def test_simhash(docs, rows):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [fingerprint(t) for _, t in rows]
    of = components(fps)
    for (i, _), f, c in zip(rows, fps, of, strict=True):
        ids = [j for (j, _), d in zip(rows, of, strict=True) if d == c and j is not None]
        assert got[i, f"{f:016x}"] == min(ids, default=None)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [1, 48])
def test_links_in_hot_segments(spark, cell):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.getrandbits(3) << 40) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    from shardwell.llm.common import Scratch

    old, simhash.CELL = simhash.CELL, cell
    try:
        scratch = Scratch(spark, "test")
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch)
        label = {x.node: x.label for x in simhash.components(scratch.write(edges, "e"), scratch).collect()}
    finally:
        simhash.CELL = old
    of = components(fps)
    ours = [label.get(s, s) for s in signed]
    assert len({(a, b) for a, b in zip(of, ours, strict=True)}) == len(set(of)) == len(set(ours))


def removed(rows, least=50):
    first: dict = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            first.setdefault(b[p : p + least], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - least + 1):
                if first[b[p : p + least]] < i:
                    gone[p : p + least] = b"\1" * least
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffixes(docs, rows, monkeypatch):
    want = removed(rows)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=str) == want and sum(r[2] for r in want) > 1000
    split = suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda b, n: split(b, n, 0))  # every seed counts as hot
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=str) == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_copies_of_units_send_no_bytes(spark):
    random.seed(5)
    text = " ".join(str(random.random()) for _ in range(300))
    docs = spark.createDataFrame([(k, text) for k in range(8)] + [(8, "y" + text[1000:])], "doc_id long, text string").repartition(9, "doc_id")
    blocks = suffix_dedup.make_blocks(docs).cache()
    found = suffix_dedup.repeats(blocks, 64)
    sent = suffix_dedup.candidates(blocks, found, suffix_dedup.kinds(blocks, found, 64), 64).agg(F.sum(F.length("bytes"))).first()[0]
    assert 0 < sent < 1000  # only the units around the last one's start
    got = {r[0]: r[2] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {0: 0} | dict.fromkeys(range(1, 8), len(text)) | {8: len(text) - 1000}


def test_previous_factors():
    r = random.Random(2)
    for _ in range(50):
        n = r.randrange(1, 40)
        docs, common = np.array([r.randrange(6) for _ in range(n)]), np.array([0] + [r.randrange(9) for _ in range(n - 1)])
        got = suffix_dedup.previous_factors(docs, common, 4)
        for i in range(n):
            best = 0
            for j in range(n):
                if docs[j] < docs[i]:
                    best = max(best, min(common[min(i, j) + 1 : max(i, j) + 1]))
            assert got[i] == (best if best >= 4 else 0)


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = [*rows, (950, "it's ＡＢＣ <|endoftext|>x\x1cy　z  'll naïvé Σίσυφος ΟΔΟΣ")]
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(rows[-1:], "doc_id long, text string"))
    got = packing.pack(docs, queries.tokenizer_path()).toPandas()
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    have = Counter((None if math.isnan(i) else int(i), *map(int, x)) for i, *x in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False))
    assert have == want
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    total = seq.groupby("sequence_id").length.sum()
    assert total.max() <= 2048 and sorted(total.index) == list(range(len(total)))
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_shortest_pack_first():
    r = random.Random(4)
    for capacity in (16, 64):
        histogram = {r.randrange(1, capacity + 1): r.randrange(1, 200) for _ in range(20)}
        placed, fill = Counter(), Counter()
        for length, rank, packs, copies, first, offset in packing.shortest_pack_first(histogram, capacity):
            assert rank == placed[length]
            placed[length] += packs * copies
            for s in range(first, first + packs):
                assert fill[s] == offset
                fill[s] += copies * length
        assert placed == histogram and max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))


def test_lm(docs, rows):
    got = lm_score.query(docs).collect()
    count = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in [*words(t), b""])
    n, v = sum(count.values()), len(count)
    by = {(r.doc_id, r.n_tokens, round(r.base_score, 6)) for r in got}
    for i, t in rows:
        ws = [*words(t), b""]
        assert (i, len(ws), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) in by
    assert len(got) == len(rows) and all(r.train_tokens == n and r.score < 0 and r.n_known <= r.n_tokens for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.query(docs.limit(0)).count() == 0


def test_lm_scores_by_hand(spark):
    """Where each word occurs once every dish has one customer and one table, so scores are known."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1][:1] + [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    texts = ["ab cd ef gh ij kl", "cd ef zz gh", ""]
    got = {r.doc_id: r.score for r in lm_score.query(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    train = [*words(texts[0]), b""]
    v, n = len(set(train)), len(train)
    before = lambda ws, k: ws[k - 1][-2:] if k else b""

    def prob(w, ctx):
        p = 1 / (v + 1)
        for level, own in ((0, b""), (1, ctx[-1:]), (2, ctx)):
            d, s = hpyp.DISCOUNT[level], hpyp.STRENGTH[level]
            place = [x for k, x in enumerate(train) if level == 0 or before(train, k)[-level:].rjust(level, b"\0") == own.rjust(level, b"\0")]
            p = (place.count(w) * (1 - d) + (s + d * len(place)) * p) / (s + len(place))
        return p

    for i, t in zip(ids, texts, strict=True):
        ws = [*words(t), b""]
        assert abs(got[i] - sum(math.log10(prob(w, before(ws, k))) for k, w in enumerate(ws))) < 1e-4


def test_lm_tells_words_that_end_alike_apart(spark):
    """What follows a word is learnt for that word, not for its last bytes."""
    train = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 != 1][:40]
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    texts = ["peach apple", "reach orange"] * 20 + ["peach apple", "peach orange", "reach apple", "reach orange"]
    docs = spark.createDataFrame(list(zip(train + held, texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm_score.query(docs).collect()}
    a, b, c, d = (got[i] for i in held)
    assert min(a, d) > max(b, c) + 1


def test_seatings_are_drawn_from_their_distribution():
    from itertools import product

    d, s, rest, base, c = 0.6, 1.3, 4, 0.3, 6
    mass, ways = Counter(), Counter()
    for seats in product(range(c), repeat=c):  # all seatings of c customers, one by one
        tables, w = [], 1.0
        for x in seats:
            if x > len(tables):
                break
            if x == len(tables):
                w *= (s + d * (rest + len(tables))) * base if tables else 1.0
                tables.append(1)
            else:
                w *= tables[x] - d
                tables[x] += 1
        else:
            mass[len(tables)] += w
            ways[len(tables)] += math.prod(math.prod(k - d for k in range(1, t)) for t in tables)
    assert all(abs(np.exp(hpyp.stirling(d)[c, t]) - ways[t]) < 1e-9 for t in range(1, c + 1))
    r, n = np.random.default_rng(3), 40_000
    drawn = Counter(hpyp.draw_tables(np.full(n, c), np.ones(n, int), np.full(n, rest), np.full(n, base), d, s, r).tolist())
    assert all(abs(drawn[t] / n - mass[t] / sum(mass.values())) < 0.01 for t in range(1, c + 1))
    for d, c in ((0.7, 200), (0.75, 500), (0.8, 130)):  # the sums for many customers against the recurrence
        t = np.arange(1, int(1.9 * c**d) // 2)
        assert np.abs(hpyp.log_stirling(np.full(len(t), c), t, d) - hpyp.stirling(d, 500)[c, t]).max() < 1e-6
    # a walk comes to what is drawn outright
    args = (np.full(n, 120), np.full(n, 3), np.full(n, 500), np.full(n, 0.01), 0.8, 1.0)
    outright, walked, old = hpyp.draw_tables(*args, r), args[1], hpyp.EXACT
    try:
        hpyp.EXACT = 20
        for _ in range(4):
            walked = hpyp.draw_tables(args[0], walked, *args[2:], r)
    finally:
        hpyp.EXACT = old
    assert abs(outright.mean() - walked.mean()) < 0.1 and abs(outright.std() - walked.std()) < 0.1


def test_seating_stays_consistent_and_sums_to_one():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 40, 300) << 16 | r.integers(0, 5, 300) << 8 | r.integers(0, 3, 300))
    dishes = hpyp.Dishes(keys, r.integers(1, 30, len(keys)) ** 2)
    for _ in range(4):
        dishes.sweep(1 / 41, dishes.totals(), r)
        for level in dishes.levels:
            assert (level.t >= 1).all() and (level.t <= level.c).all()
        for k in (1, 2):
            assert (np.bincount(dishes.up[k], dishes.levels[k].t) == dishes.levels[k - 1].c).all()
    dishes.keep()
    context = 2 << 8 | 1
    every = np.r_[np.arange(40), -1]
    seen = np.isin(every, dishes.levels[0].word)
    p = dishes.prob(every << 16 | context, 1 / 41, [dishes.totals()])
    assert abs(p[seen].sum() + (~seen).sum() * p[-1] - 1) < 1e-9


def test_toxicity(spark):
    r = random.Random(6)
    common = ["the", "of", "and", *("".join(r.choices("aeioubcdt", k=5)) for _ in range(200))]
    bad = ["vexfoo", "vexbar", "vexbaz", "grudge", "slurry"]
    rows, labels = [], []
    for i in range(1200):
        ws = r.choices(common, k=r.randrange(20, 80))
        y = int(i % 4 == 0)
        if y:
            for _ in range(4):
                ws[r.randrange(len(ws))] = r.choice(bad)
        rows.append((i, " ".join(ws)))
        labels.append((i, y))
    rows += ODD
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, score string")
    truth = spark.createDataFrame([*labels, (None, 1), (3, None), (900, 9)], "doc_id long, toxic int")
    model = toxicity.fit(docs, truth, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    by, held = {x.doc_id: x.predicted for x in got}, [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by[i] == y for i, y in held) / len(held) > 0.95
    assert by[900] == by[901] == 0
    none = toxicity.fit(docs, truth.limit(0))
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0} and toxicity.score(docs.limit(0), model).count() == 0


def test_chain():
    pairs = [(0, 0), (5, 5), (10, 11), (12, 3), (200, 400), (205, 405)]
    found = passages.chain(pairs)
    assert [(0, 0), (5, 5), (10, 11)] in found and [(200, 400), (205, 405)] in found
    r = random.Random(7)
    for _ in range(30):
        pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(12)})
        best = {}
        for p in pairs:
            best[p] = 5 + max([0.0, *(best[q] - 0.1 * (p[0] - q[0] + p[1] - q[1]) for q in best if q[0] < p[0] and q[1] < p[1])])
        c = passages.chain(pairs)[0]
        score = 5 * len(c) - 0.1 * sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(c, c[1:], strict=False))
        assert abs(score - max(best.values())) < 1e-9


def test_passages(spark):
    r = random.Random(8)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b = make(70), make(60)
    fuzzy = [*b]
    fuzzy[30] = "other"
    rows = [(1, make(40) + a + make(30)), (2, make(20) + [w.upper() for w in a] + make(50)), (3, make(90) + b), (4, fuzzy + make(10)), (5, make(200)), (6, a[:30] + make(80)), (7, None), (8, []), (9, a), (9, a), (None, a)]
    docs = spark.createDataFrame([(i, t and " ".join(t), 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = {(x.doc_id, x.ref_doc_id): x for x in passages.fuzzy_passages(docs).collect()}
    assert set(got) == {(2, 1), (4, 3), (9, 1), (9, 2)}
    x = got[2, 1]
    assert (x.start, x.end, x.ref_start, x.ref_end, x.similarity) == (20, 90, 40, 110, 1.0)
    assert 0.8 <= got[4, 3].similarity < 1 and got[4, 3].n_aligned == 59
    assert passages.fuzzy_passages(docs.limit(0)).count() == 0


def test_longest_previous_factors():
    r = random.Random(9)
    for _ in range(30):
        units = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(6, 14))) for _ in range(r.randrange(1, 9))]
        units += [r.choice(units) for _ in range(3)]
        ids = sorted(r.randrange(4) for _ in units)
        least, text = 4, np.frombuffer(b"".join(units), np.uint8)
        size = np.array([len(u) for u in units])
        base, count, ids = np.cumsum(size) - size, size - least + 1, np.array(ids)
        got = suffix_dedup.longest_previous(text, base, count, ids, least)
        every = [(i, u[k:]) for i, u in zip(ids, units) for k in range(len(u) - least + 1)]
        prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = [max((prefix(s, t) for j, t in every if j < i), default=0) for i, s in every]
        assert got.tolist() == [w if w >= least else 0 for w in want] and max(got, default=0) >= 0
        rep = suffix_dedup.representatives(text, base, size)
        assert [units[k] for k in rep] == units and all(ids[k] == min(ids[j] for j, u in enumerate(units) if u == units[k]) for k in rep)
        own = np.unique(rep)
        length = suffix_dedup.longest_previous(text, base[own], count[own], ids[own], least)
        seen = {(u, p + j) for us, ps, ns in suffix_dedup.covered(ids, count, rep, own, length, least) for u, p, n in zip(us.tolist(), ps.tolist(), ns.tolist()) for j in range(n)}
        at = iter(want)
        assert seen == {(u, p) for u in range(len(units)) for p in range(count[u]) if next(at) >= least}
    long = np.frombuffer(b"x" * 40 + b"y" * 40 + b"x" * 40 + b"y" * 40, np.uint8)
    assert suffix_dedup.longest_previous(long, np.array([0, 80]), np.array([31, 31]), np.array([1, 2]), 50).tolist() == [0] * 31 + list(range(80, 49, -1))


def test_passages_past_scattered_seeds(spark):
    """Documents that hold a passage's phrases apart don't stand between two that hold the passage."""
    r = random.Random(11)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a = make(70)
    scattered = lambda: sum((a[k : k + 24] + make(3) for k in range(0, 70, 12)), [])
    rows = [(1, scattered()), (2, make(20) + a + make(9)), (3, scattered()), (4, make(50) + a), (5, ["la"] * 3000), (6, make(30) + ["la"] * 200)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(2)
    got = {(x.doc_id, x.ref_doc_id): x for x in passages.fuzzy_passages(docs).collect()}
    assert (4, 2) in got and (got[4, 2].start, got[4, 2].end) == (50, 120)
    assert (6, 5) in got and got[6, 5].end - got[6, 5].start == 200


def test_passages_between_other_holders(spark):
    """Documents that hold a passage in parts, too short to count, are the first and the nearest at each of its keys."""
    r = random.Random(14)
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a = make(70)
    parts = lambda: a[:45] + make(9) + a[12:57] + make(9) + a[25:]
    rows = [(i, make(5 + i) + a + make(9) if i % 2 else parts()) for i in range(14)]
    rows += [(i, list(rows[k][1])) for i, k in ((20, 1), (21, 1), (22, 2))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = passages.fuzzy_passages(docs).collect()
    near = {i: i for i, _ in rows}
    for _ in rows:
        for x in got:
            near[x.doc_id] = near[x.ref_doc_id] = min(near[x.doc_id], near[x.ref_doc_id])
    assert {i for i, k in near.items() if k == 1} == {1, 3, 5, 7, 9, 11, 13, 20, 21}
    assert {(x.doc_id, x.ref_doc_id, x.start, x.end) for x in got if x.doc_id > 13} == {(20, 1, 0, 85), (21, 1, 0, 85), (22, 2, 0, 153)}


def test_linked_labels():
    r = random.Random(15)
    for _ in range(50):
        n = r.randrange(1, 30)
        a, b = ([r.randrange(n) for _ in range(r.randrange(20))] for _ in range(2))
        k = min(len(a), len(b))
        want = list(range(n))
        for _ in range(n):
            for i, j in zip(a[:k], b[:k], strict=True):
                want[i] = want[j] = min(want[i], want[j])
        assert passages._least_linked(n, np.array(a[:k], int), np.array(b[:k], int)).tolist() == want


def passages_by_hand(rows, least=50, similarity=0.8, run=5):
    """Documents with a window of `least` words that shares enough runs with one of an earlier document."""
    out = set()
    text = {i: words(t) for i, t in rows}
    runs = {i: [tuple(w[k : k + run]) for k in range(len(w) - run + 1)] for i, w in text.items()}
    n = least - run + 1
    for i in text:
        for j in text:
            if j < i and len(set(runs[i]) & set(runs[j])) >= similarity * n:
                for s in range(len(runs[i]) - n + 1):
                    own = Counter(runs[i][s : s + n])
                    if any(sum((own & Counter(runs[j][t : t + n])).values()) >= similarity * n for t in range(len(runs[j]) - n + 1)):
                        out.add(i)
                        break
    return out


def test_passages_by_brute_force(spark):
    r = random.Random(12)
    lines = [[f"l{r.randrange(300)}" for _ in range(9)] for _ in range(20)]
    make = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows, sources = [], [make(r.randrange(60, 130)) for _ in range(12)]
    for i in range(150):
        body = list(r.choice(sources)) if i % 2 else make(60)
        body = body[r.randrange(5) :]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            at = r.randrange(len(body))
            body[at : at + r.randrange(2)] = make(r.randrange(2))
        rows.append((i, " ".join(make(r.randrange(20)) + r.choice(lines) + body + r.choice(lines) + make(r.randrange(20)))))
    want = passages_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in passages.fuzzy_passages(docs).collect()}
    assert len(want) > 40 and len(got & want) >= 0.9 * len(want), (len(got & want), len(want))
    print("passages: recall", len(got & want) / len(want), "others", len(got - want))


def test_chains_on_one_diagonal():
    """The short way for matches on one diagonal gives what the tree gives (a match elsewhere makes it take the tree)."""
    r = random.Random(13)
    for _ in range(100):
        xs = sorted(r.sample(range(200), r.randrange(2, 12)))
        pairs = [(x, x + 7) for x in xs]
        far = (10_000, 3)
        assert sorted(passages.chain(pairs)) == sorted(c for c in passages.chain([*pairs, far]) if c != [far])
