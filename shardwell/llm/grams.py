"""Byte n-grams within words, packed into integers.

A word is read as 0x20, its bytes, 0x0A. Every byte after the first is an event in the context of up to DEPTH bytes
before it (not before the opening 0x20). An event's key holds its length in the top byte and the bytes below it, so
the context is the key without its last byte and the parent context lacks the first.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
_LEN = np.uint64(56)
_BYTE = np.uint64(8)


def events(words: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all events of the words, in order, and the index of the word that each is of."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    buf = np.frombuffer(b" " + b"\n ".join(words) + b"\n", np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(words)), lens)
    back = np.minimum(np.arange(len(buf)) - starts[owner], depth)  # bytes of context
    key = buf.copy()
    for k in range(1, depth + 1):
        far = buf[:-k] << np.uint64(8 * k)
        key[k:] += np.where(back[k:] >= k, far, np.uint64(0))
    key |= (back + 1).astype(np.uint64) << _LEN
    real = back > 0
    return key[real], owner[real]


def length(keys: np.ndarray) -> np.ndarray:
    return keys >> _LEN


def context(keys: np.ndarray) -> np.ndarray:
    """Keys without their last byte."""
    n = length(keys)
    low = keys & np.uint64((1 << 56) - 1)
    return (low >> _BYTE) | ((n - np.uint64(1)) << _LEN)


def shorter(keys: np.ndarray) -> np.ndarray:
    """Keys without their first byte."""
    n = length(keys) - np.uint64(1)
    mask = (np.uint64(1) << (n * _BYTE)) - np.uint64(1)
    return (keys & mask) | (n << _LEN)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in the sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.float64)
    order = np.argsort(keys)
    k = keys[order]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[new], np.add.reduceat(weights[order], new)
