"""A hierarchical Pitman-Yor process over words, its seating sampled by Gibbs.

A word's context is the whole word before it; that restaurant's parent is the one of that word's last byte, which words
that end alike share; all of those share the root, over a uniform distribution on the known words and one unknown. A
customer of a restaurant is a token; a table that it opens is a customer of the parent.

A sweep draws the seating of each dish (all its customers at once) from its distribution given all other dishes, from
the longest contexts to the root. Of a seating only the number of tables matters to predictions and to the parent; the
number of ways to seat c customers at t tables is the generalised Stirling number S(c, t), so with T tables of other
dishes in a restaurant of discount d and strength s

    P(t)  is in proportion to  S(c, t) * base^t * (s + d * (T + 1)) * ... * (s + d * (T + t - 1)).

S is exact by its recurrence up to EXACT customers, and there t is drawn outright. Beyond, S is its alternating sum
while t is below 2 c^d, and else the saddle point of its generating function, and t makes WALK Metropolis steps of a
size like its spread.

Words are dealt to buckets: a word's dishes in all restaurants are in its bucket, so seats and parents are local, and
of the rest a bucket needs the restaurants' totals only. Those are added up between sweeps, and stand still during one.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

#: Discount and strength of the root, of last bytes and of words before.
DISCOUNT = (0.7, 0.75, 0.8)
STRENGTH = (1.0, 1.0, 1.0)
#: Customers of a dish up to which the number of tables is drawn outright; steps of a walk beyond.
EXACT, WALK = 128, 24
#: Restaurants of the root and of last bytes.
PLACES = (1, 1 << 8)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers, by Stirling's series after a shift."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - shift


@cache
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """ln S(c, t) for c, t up to most; -inf where t > c. S(c, t) = S(c - 1, t - 1) + (c - 1 - d t) S(c - 1, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most + 1):
            stay = np.where(t < c, out[c - 1] + np.log(np.maximum(c - 1 - d * t, 1e-300)), -np.inf)
            out[c] = np.logaddexp(np.r_[-np.inf, out[c - 1, :-1]], stay)
            out[c, 0] = -np.inf
    return out


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """ln S(c, t) for large c."""
    c, t = c.astype(np.float64), t.astype(np.float64)
    out = np.empty(len(c))
    few = t * c**-d < 2
    if few.any():
        # the sum over j of (-1)^j C(t, j) Gamma(c - j d) / Gamma(-j d), over d^t t!, relative to its first term (j = 1);
        # 1 / Gamma(-a) = -sin(pi a) Gamma(a + 1) / pi
        x, n = c[few], t[few]
        total, ways, j = np.zeros(len(x)), np.zeros(len(x)), 1
        first = log_gamma(x - d)
        while True:
            a = j * d
            weight = np.sin(np.pi * a) * np.exp(math.lgamma(a + 1) - math.lgamma(d + 1)) / np.sin(np.pi * d)
            size = np.where(n >= j, np.exp(ways + log_gamma(np.maximum(x - a, 0.1)) - first), 0.0)
            total += (-1) ** (j - 1) * weight * size
            if j > 100 or (size * np.exp(math.lgamma(a + 1)) < 1e-10).all():
                break
            ways = ways + np.where(n > j, np.log(np.maximum(n - j, 1) / (j + 1)), 0.0)
            j += 1
        out[few] = np.log(n) + np.log(d) + first - math.lgamma(1 - d) + np.log(np.maximum(total, 1e-12)) - n * np.log(d) - log_gamma(n + 1)
    if (~few).any():
        x, n = c[~few], t[~few]
        goal, low, high = x / n, np.full(len(x), -30.0), np.full(len(x), 6.0)  # z = x0 as exp(-exp(v))
        for _ in range(60):
            v = (low + high) / 2
            z = np.exp(-np.exp(v))
            rest = np.log1p(-z)
            f = -np.expm1(d * rest)
            mean = z * d * np.exp((d - 1) * rest) / f
            low, high = np.where(mean > goal, v, low), np.where(mean > goal, high, v)
        spread = mean * (1 + (1 - d) * z / np.exp(rest) - mean)
        out[~few] = log_gamma(x + 1) - log_gamma(n + 1) - n * np.log(d) + n * np.log(f) + x * np.exp(v) - 0.5 * np.log(2 * np.pi * n * np.maximum(spread, 1e-12))
    out[t == c] = 0.0
    return out


def draw_tables(c: np.ndarray, t: np.ndarray, rest: np.ndarray, base: np.ndarray, d: float, s: float, rng: np.random.Generator) -> np.ndarray:
    """A new number of tables for each dish; rest: tables of other dishes in its restaurant, t: where walks begin."""
    out = np.minimum(c, 1)
    ways = stirling(d)
    for n in np.unique(c[(c > 1) & (c <= EXACT)]):
        for at in np.array_split(np.flatnonzero(c == n), max(1, int((c == n).sum() * n) >> 22)):
            k = np.arange(1, n)
            opened = np.cumsum(np.log(s + d * (rest[at, None] + k[None, :])) + np.log(base[at])[:, None], axis=1)
            log = ways[n, 1 : n + 1][None, :] + np.c_[np.zeros(len(at)), opened]
            mass = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (mass < rng.random(len(at))[:, None] * mass[:, -1:]).sum(axis=1)
    far = np.flatnonzero(c > EXACT)
    if len(far):
        n, now, other, log_base = c[far], np.clip(t[far], 1, c[far]), s / d + rest[far], np.log(base[far]) + np.log(d)
        weight = lambda t: log_stirling(n, t, d) + (t - 1) * log_base + log_gamma(other + t)
        have = weight(now)
        for step in range(WALK):
            size = 1 + (2 * np.sqrt(now) * (step % 3 == 0)).astype(np.int64)  # every third step is a wide one
            new = now + rng.integers(-size, size + 1)
            back = 1 + (2 * np.sqrt(np.maximum(new, 1)) * (step % 3 == 0)).astype(np.int64)
            fits = (new >= 1) & (new <= n) & (abs(new - now) <= back)
            met = weight(np.where(fits, new, now))
            go = fits & (np.log(rng.random(len(n))) < met - have + np.log(2 * size + 1) - np.log(2 * back + 1))
            now, have = np.where(go, new, now), np.where(go, met, have)
        out[far] = now
    return out


class Level:
    """Dishes (word, restaurant) of one level, sorted."""

    def __init__(self, word: np.ndarray, context: np.ndarray, customers: np.ndarray, level: int, places: int):
        self.word, self.context, self.c, self.level, self.places = word, context, customers.astype(np.int64), level, places
        self.d, self.s = DISCOUNT[level], STRENGTH[level]
        self.t = np.maximum(1, np.minimum(self.c, np.ceil(self.c**self.d))).astype(np.int64)  # about as a restaurant of its own

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of this bucket in each restaurant."""
        return np.bincount(self.context, self.c, self.places), np.bincount(self.context, self.t, self.places)

    def predict(self, base: np.ndarray, totals: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        guests, tables = totals[0][self.context], totals[1][self.context]
        return np.maximum(self.c - self.d * self.t + (self.s + self.d * tables) * base, 1e-300) / (self.s + guests)

    def gibbs(self, customers: np.ndarray, base: np.ndarray, totals: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> None:
        """Draws the seating of each dish anew, with so many customers."""
        many = np.flatnonzero(customers > 1)  # one customer sits at one table
        before, self.c, self.t = self.t[many], customers.astype(np.int64), np.minimum(customers, 1).astype(np.int64)
        rest = np.maximum(totals[1][self.context[many]] - before, 0)
        self.t[many] = draw_tables(self.c[many], before, rest, np.minimum(base[many], 1.0), self.d, self.s, rng)


class Dishes:
    """The dishes of a bucket's words at all levels."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, last: np.ndarray | None = None, bits: int = 16):
        """keys: word << bits | context, distinct and sorted; counts: tokens; last: the last byte of each context."""
        self.bits, self.last = bits, np.arange(1 << bits) & 0xFF if last is None else last.astype(np.int64)
        self.levels: list[Level] = [None] * 3  # type: ignore[list-item]
        self.up: list[np.ndarray] = [None] * 3  # type: ignore[list-item]
        self.samples: list[list[tuple[np.ndarray, np.ndarray]]] = []
        word, context, c = keys >> bits, keys & ((1 << bits) - 1), counts.astype(np.int64)
        self.tokens = c
        places = (*PLACES, len(self.last))
        for level in (2, 1, 0):
            self.levels[level] = Level(word, context, c, level, places[level])
            if level:
                short = word << 8 | self.last[context] if level == 2 else word << 8
                parents, at = np.unique(short, return_inverse=True)
                word, context, c = parents >> 8, parents & 0xFF, np.bincount(at, self.levels[level].t, len(parents)).astype(np.int64)
                self.up[level] = at

    def totals(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [x.totals() for x in self.levels]

    def sweep(self, base: float, totals: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> None:
        """base: probability of a word below the root; totals: of all buckets."""
        below = [np.full(len(self.levels[0].word), base)]
        for level in (1, 2):
            below.append(self.levels[level - 1].predict(below[-1], totals[level - 1])[self.up[level]])
        target = self.tokens
        for level in (2, 1, 0):
            self.levels[level].gibbs(target, below[level], totals[level], rng)
            if level:
                target = self._opened(level)

    def _opened(self, level: int) -> np.ndarray:
        """Customers that the tables of a level are in the next."""
        return np.bincount(self.up[level], self.levels[level].t, len(self.levels[level - 1].word)).astype(np.int64)

    def seats(self) -> list[np.ndarray]:
        """Tables of each dish, from which seat() sets the whole seating again."""
        return [x.t.astype(np.int32) for x in self.levels]

    def seat(self, tables: list[np.ndarray]) -> None:
        for level in (2, 1, 0):
            self.levels[level].t = tables[level].astype(np.int64)
            if level:
                self.levels[level - 1].c = self._opened(level)

    def keep(self) -> None:
        """Keeps the seating as a sample."""
        self.samples.append([(x.c, x.t) for x in self.levels])

    def prob(self, keys: np.ndarray, base: float, totals: list[list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """Predictive probabilities, averaged over the samples, of word << bits | context; a negative word is unknown."""
        probs = [np.full(len(keys), base) for _ in self.samples]
        word, context = keys >> self.bits, keys & ((1 << self.bits) - 1)
        for level, x in enumerate(self.levels):
            u = (np.zeros_like(context), self.last[context], context)[level]
            own, have = word << self.bits | u, x.word << self.bits | x.context
            at = np.minimum(np.searchsorted(have, own), max(len(have) - 1, 0))
            there = have[at] == own if len(have) else np.zeros(len(own), bool)
            met = at[there]
            for k, (sample, total) in enumerate(zip(self.samples, totals, strict=True)):
                (c, t), (guests, tables) = sample[level], total[level]
                p = (x.s + x.d * tables)[u] * probs[k]
                p[there] += c[met] - x.d * t[met]
                probs[k] = p / (x.s + guests)[u]
        return sum(probs, np.zeros(len(keys))) / max(1, len(probs))
