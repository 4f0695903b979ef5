"""Periodic runs against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shardwell.llm import periodic_runs, queries
from tests.llm.test_free import ODD, SCHEMA, SF


def brute(w):
    out = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if (size := j + p - i) >= max(12, 2 * p) and j > i and not any(w[i : i + size - q] == w[i + q : i + size] for q in range(1, p)):
                out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    dropped = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{size},{p}\n" for s, size, p in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_by_brute_force(monkeypatch):
    r, grid = random.Random(13), periodic_runs.Grid()
    for _ in range(150):
        docs = []
        for _ in range(r.randrange(1, 6)):
            w = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randrange(80))]
            w += w[-r.randrange(1, 10) :] * r.randrange(8) + w[: r.randrange(5)]
            docs.append(w)
        got = periodic_runs.find_runs([np.array(d, np.int64) for d in docs], grid)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute(d) for d in docs]
    monkeypatch.setattr(periodic_runs, "BLOCK", 40)
    monkeypatch.setattr(periodic_runs, "GRID", 150)
    w = [r.randrange(2) for _ in range(300)] + [1, 0, 1] * 30
    assert [tuple(x) for x in periodic_runs.find_runs([np.array(w)], periodic_runs.Grid())[0].tolist()] == brute(w)


def test_extensions():
    r = random.Random(2)
    w = [r.randrange(3) for _ in range(200)] + [0, 1] * 40
    lce = periodic_runs.Extensions(np.array(w))
    pairs = np.array([(a, b) for a in range(0, 280, 3) for b in range(280) if a != b])
    want = [next((k for k in range(280) if max(a, b) + k == 280 or w[a + k] != w[b + k]), 280) for a, b in pairs.tolist()]
    assert lce.of(pairs[:, 0], pairs[:, 1]).tolist() == want


@pytest.mark.parametrize("planted", [True, False])
def test_whole_rows(spark, planted):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [x for x in ODD if x[0] != 906] + [(910, "a b " * 20 + "c " * 15), (911, "u\tv w x " * 9), (912, "x " * 12), (913, "x " * 11)]
    docs = spark.createDataFrame([(*x, "s", 7, 7, "b", 1) for x in rows], SCHEMA).withColumnRenamed("keep_id", "n_runs").repartition(3)
    got = periodic_runs.periodic_runs(docs, planted=planted)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*x, planted) for x in rows), key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_very_long(spark):
    text = " ".join(f"w{k % 5000}" for k in range(90_000))
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[1:6]) == (1, 0, 90_000, 5000, 18_000)
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(f"w{k}" for k in range(5000)).encode()).hexdigest()


def test_query(spark):
    got = {x.doc_id: tuple(x) for x in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [x for x in docs if len(x.text) < 3000]
    assert len(got) == len(docs) and all(got[x.doc_id] == expected(x.doc_id, x.text, True) for x in short)


def test_grid_one_word_longer_than_the_kept_one():
    grid = periodic_runs.Grid()
    list(grid.pairs(375))
    got = {(p, k) for near, far in grid.pairs(751) for p, k in zip((far - near).tolist(), far.tolist(), strict=True)}
    assert got == {(p, k) for k in range(1, 751) for p in range(1, k + 1) if k % p == 0}
