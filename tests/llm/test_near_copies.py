"""The near-copy stage against brute force over sets of five-word shingles."""

import random

import corpus_pipeline as p
import numpy as np
import pyarrow as pa

from shardwell.llm import common, near_copies

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(500)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(docs):
    """Of each component of pairs with similarity 0.8 or more the smallest id."""
    sets, label = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i for i in label if label[i] == i}


def test_near_copies(spark):
    r = random.Random(3)
    docs = [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A B"), (905, "a c")]
    for k in range(12):
        text = r.choices(WORDS, k=r.randrange(60, 400))
        for _ in range(14):  # every copy is changed again, so the ends of a chain are unlike
            docs.append((len(docs), " ".join(text)))
            for _ in range(max(1, len(text) * (k % 4 + 1) // 120)):
                text[r.randrange(len(text))] = "changed"
    docs += [(1000 + x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, label string").repartition(5)
    left = p.drop_near_copies(spark, frame, SF)
    assert left.columns == frame.columns
    got, want = {x.doc_id for x in left.collect()}, kept(docs)
    lost = len(docs) - len(want)
    assert p.drop_near_copies(spark, frame.limit(0), SF).count() == 0
    assert got >= want and len(got - want) <= 0.1 * lost, (len(got - want), lost)


def test_fingerprints_meet():
    """Pairs at a similarity of 0.8 to 0.82 share a place, and are within FAR bits, in nine of ten cases at least."""
    r, met = np.random.default_rng(1), 0
    for _ in range(300):
        own = r.integers(0, 1 << 64, 180, np.uint64)
        a, b = np.unique(own[:162]), np.unique(own[18:])
        assert near_copies.alike(a, b)
        x, y = (near_copies.fingerprint(s) for s in (a, b))
        close = any((p ^ q).bit_count() <= 2 for p, q in zip(near_copies.segments_of(x), near_copies.segments_of(y)))
        met += close and int(np.bitwise_count(x ^ y).sum()) <= near_copies.FAR
    assert met >= 270


def test_rows_that_share_an_id(spark):
    r = random.Random(5)
    a, b = (" ".join(r.choices(WORDS, k=120)) for _ in range(2))
    rows = [(1, a), (7, a + " more"), (7, b), (7, b), (None, a), (None, a), (8, "other")]
    left = near_copies.keep_one(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, row int"))
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted([(1, a), (7, b), (None, a), (None, a), (8, "other")], key=str)


def test_texts_reach_python_in_small_batches(spark):
    common.ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.get_total_buffer_size()])], names=["n"])

    rows = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text").mapInArrow(sizes, "n long")
    assert max(r[0] for r in rows.collect()) < 2 * common.ARROW_BYTES + (1 << 21)
