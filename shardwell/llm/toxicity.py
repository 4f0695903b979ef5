"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, predict a text's words byte by byte. Each discounts its own class's counts and gives
the freed mass to one shared Kneser-Ney model of both classes (raw counts in the longest context, continuation counts
below), so an expression that a class has rarely seen is smoothed by counts that the classes share, and one that
neither has seen says nothing. A text's feature is the difference of the two log-likelihoods divided by its length; a
logistic curve, fitted on rows that the models were not counted on, turns it into a score.

The models are fitted on a bounded sample: at most sample_rows labelled rows of each class (in order of a hash of the
id), so what goes to the executors is bounded too. Scores cover whole texts of all rows.

Defined results: null and empty texts score as length 0 (the curve's intercept); without labelled rows of both classes
every score is the share of label 1 (0 if there are no labels); a label that is neither 0 nor 1 is not learnt from; of several
labels of one id, or of equal texts, the largest counts; of several texts of one id the models learn from the one with the
largest hash; repeated rows each get a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import ship

#: Labelled rows of each class that the models are fitted on, at most.
SAMPLE_ROWS = 4000
#: Counts up to this much of a class say nothing of their own: their mass goes to the shared counts.
DISCOUNT = 2.5
#: Discount of the shared counts, and the bytes of context that they look at.
SHARED_DISCOUNT, SHARED_DEPTH = 0.75, 2
#: Bytes added to a text's length, so that a few odd words do not decide on a short text.
LENGTH = 100
#: The share of the sample that calibrates.
HOLD = 4


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


class KneserNey:
    """log P_toxic / P_ordinary of each event, as two sorted tables: seen events, and seen contexts for the others."""

    def __init__(self, counts: list[dict[bytes, int]]):
        vocab = list(set().union(*counts))
        keys, owner = grams.events(vocab)
        by = [grams.tally(keys, np.fromiter((c.get(w, 0) for w in vocab), np.float64, len(vocab))[owner]) for c in counts]
        cells, own = by[0][0], [x[1] for x in by]
        shared = self._shared(cells)
        contexts, at = np.unique(grams.context(cells), return_inverse=True)
        seen = np.zeros(len(cells))
        unseen = np.zeros(len(contexts))
        for sign, n in ((1, own[1]), (-1, own[0])):
            total = np.bincount(at, n, len(contexts))
            freed = np.bincount(at, np.minimum(n, DISCOUNT), len(contexts))
            free = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
            seen += sign * np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total[at], 1) + free[at] * shared)
            unseen += sign * np.log(free)
        self.cells, self.seen = cells, seen.astype(np.float32)
        self.contexts, self.unseen = contexts, unseen.astype(np.float32)

    @staticmethod
    def _shared(cells: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney probability of each cell from continuation counts of both classes' events.

        A level counts the distinct events, of the longest contexts that the models have, which end in it.
        """
        ends = cells.copy()
        while (long := grams.length(ends) > SHARED_DEPTH + 1).any():
            ends[long] = grams.shorter(ends[long])
        levels = [grams.tally(ends, np.ones(len(ends)))]
        for _ in range(SHARED_DEPTH):
            k, m = levels[-1]
            longer = grams.length(k) > 1
            levels.append(grams.tally(np.where(longer, grams.shorter(k), k), m))
        below = np.full(len(levels[-1][0]), 1 / 256)
        for n, (k, m) in reversed(list(enumerate(levels))):
            if n + 1 < len(levels):
                longer = grams.length(k) > 1
                pos, _ = grams.find(levels[n + 1][0], np.where(longer, grams.shorter(k), k))
                below = below[pos]
            contexts, at = np.unique(grams.context(k), return_inverse=True)
            total, kinds = np.bincount(at, m, len(contexts)), np.bincount(at, minlength=len(contexts))
            below = (m - SHARED_DISCOUNT) / total[at] + SHARED_DISCOUNT * kinds[at] / total[at] * below
        return below[grams.find(levels[0][0], ends)[0]]

    def ratios(self, vocab: list[bytes]) -> np.ndarray:
        """log P_toxic / P_ordinary of each word."""
        keys, owner = grams.events(vocab)
        at, there = grams.find(self.cells, keys)
        out = np.zeros(len(keys))
        out[there] = self.seen[at[there]]
        rest = ~there
        at, there = grams.find(self.contexts, grams.context(keys[rest]))
        part = np.zeros(rest.sum())
        part[there] = self.unseen[at[there]]
        out[rest] = part
        return np.bincount(owner, out, len(vocab))


class Scorer:
    """The feature of texts; remembers the ratios of words it has met, a bounded number of them."""

    most = 400_000

    def __init__(self, model: KneserNey):
        self.model, self.known = model, {}

    def features(self, texts: list[str]) -> np.ndarray:
        split = [words(t) for t in texts]
        fresh = list({w for ws in split for w in ws if w not in self.known})
        if len(self.known) + len(fresh) > self.most:
            self.known = {}
            fresh = list({w for ws in split for w in ws})
        for k in range(0, len(fresh), 100_000):
            part = fresh[k : k + 100_000]
            self.known.update(zip(part, self.model.ratios(part).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([sum(map(get, ws)) / (LENGTH + sum(map(len, ws)) + len(ws)) for ws in split])


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and scale of a weighted logistic curve, by Newton's method with a slight pull to 0."""
    scale = float(x.std()) or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (y - p)) - 1e-3 * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1]), scale


def train(rows: list[tuple[str, int, bool]], share: float) -> dict:
    """rows: text, label, whether it calibrates; share: of label 1 among all labelled rows."""
    rows = list({t: (t, y, holds) for t, y, holds in sorted(rows)}.values())  # copies count once, by the largest label
    counts: list[dict[bytes, int]] = [{}, {}]
    for text, y, holds in rows:
        if not holds:
            c = counts[y]
            for w in set(words(text)):  # a word that a text repeats counts once
                c[w] = c.get(w, 0) + 1
    held = [(t, y) for t, y, holds in rows if holds] or [(t, y) for t, y, _ in rows]
    ys = np.array([y for _, y in held], float)
    if not (counts[0] and counts[1] and 0 < ys.sum() < len(ys)):
        return {"prior": share}
    model = KneserNey(counts)
    x = Scorer(model).features([t for t, _ in held])
    weight = np.where(ys == 1, share / ys.sum(), (1 - share) / (len(ys) - ys.sum())) * len(ys)
    return {"model": model, "curve": logistic(x, ys, weight)}


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """A model from labelled rows; usable: a condition on the id column."""
    ship(docs.sparkSession)
    own = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if usable is not None:
        own = own.filter(usable)
    own = own.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    h = F.xxhash64(F.col(id_col).cast("string"))
    sizes = dict(own.groupBy("_y").count().collect())
    if not sizes:
        return {"prior": 0.0}
    share = sizes.get(1, 0) / sum(sizes.values())
    picked = None
    for y in (0, 1):
        part = own.filter(F.col("_y") == y).orderBy(h, id_col).limit(sample_rows)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).join(F.broadcast(picked), id_col)  # 2 * sample_rows ids at most
    sample = sample.groupBy(id_col, "_y").agg(F.max_by("_t", F.xxhash64("_t")).alias("_t"))  # so rows are bounded, not only ids
    sample = sample.select("_t", "_y", (F.pmod(F.shiftright(h, 8), F.lit(HOLD)) == 0).alias("_hold"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows, share))], pa.binary())], names=["model"])

    row = sample.repartition(1).mapInArrow(build, "model binary").first()
    return pickle.loads(row[0]) if row else {"prior": share}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id column, the columns in keep, score and predicted, for every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    fields = [f for f in rows.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model["model"]) if "model" in model else None
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                texts = b.column("_text").to_pylist()
                if scorer is None:
                    s = np.full(len(texts), model["prior"])
                else:
                    slope, intercept, scale = model["curve"]
                    s = 1 / (1 + np.exp(-np.clip(slope * scorer.features(texts) / scale + intercept, -30, 30)))
                rest = [k for k, n in enumerate(b.schema.names) if n != "_text"]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*(b.schema.names[k] for k in rest), "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    out = rows.mapInArrow(run, schema)
    return out.select(id_col, *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "score", "predicted")
