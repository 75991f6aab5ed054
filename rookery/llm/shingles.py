"""Sets of five-word shingles as 64-bit hashes, and their minhash bundles."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
#: Bundles in each of the two collections, and minhashes in a bundle.
BUNDLES, ROWS = 12, 3

_STEP = np.uint64(0x9E3779B97F4A7C15)
_r = np.random.default_rng(20240229)
#: One row for each minhash: what is xored, and the odd number that multiplies.
XOR = _r.integers(0, 1 << 63, (2 * BUNDLES * ROWS, 1), np.uint64) << np.uint64(1)
ODD = (_r.integers(0, 1 << 63, (2 * BUNDLES * ROWS, 1), np.uint64) << np.uint64(1)) | np.uint64(1)


class Words64(dict):
    """64-bit hashes of words, remembered; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, hashes: Words64) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.

    Words are runs of other bytes than 09-0D and 20, A-Z lower-cased.  A text of
    fewer words than a shingle has one, of all its words; one without words none.
    """
    w = hashes.of(text.lower().split())
    n = len(w)
    if not n:
        return w
    size = min(n, WORDS)
    s = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        s = s * _STEP + w[k : n - size + 1 + k]
    return np.unique(mixed(s))


def minhashes(s: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over a set that isn't empty."""
    out = None
    for at in range(0, len(s), 2048):
        least = ((s[None, at : at + 2048] ^ XOR) * ODD).min(axis=1)
        out = least if out is None else np.minimum(out, least)
    return out


def bundles(s: np.ndarray) -> np.ndarray:
    """``2 * BUNDLES`` keys: those of the first collection, then those of the second."""
    m = minhashes(s).reshape(2 * BUNDLES, ROWS)
    key = np.arange(1, 2 * BUNDLES + 1, dtype=np.uint64) * _STEP
    for k in range(ROWS):
        key = mixed(key * _STEP + m[:, k])
    return key


def name_of(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
