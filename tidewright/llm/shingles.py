"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import xxhash

#: ASCII white space parts words; A-Z are lower-cased, other letters are not.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class _WordHash(dict):
    """Hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()


def forget() -> None:
    """Drop the hashes of words (a function of this module, as workers get a copy of what a task's own function refers to)."""
    _HASHES.clear()


def forgetting(task: Callable) -> Callable:
    """``task``, a function of a task's batches, after which the hashes of words are dropped: a worker goes on to tasks that have no use for them."""

    @wraps(task)
    def rows(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            forget()

    return rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; of the whole sequence if it has fewer words."""
    found = WORD.findall((text or "").encode().translate(LOWER))
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mixed(total + h[k : k + len(total)] * MULTIPLIERS[k % len(MULTIPLIERS)])
    return np.unique(total)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if a.size > b.size:
        a, b = b, a
    if not a.size:
        return 0
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int(np.count_nonzero(b[at] == a))
