"""64-bit hashes of bytes, words and shingles, vectorised over many texts at once."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import chain, count

import numpy as np
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public murmur constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * U(0x2545F4914F6CDD1D))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(b: int) -> np.ndarray:
        return np.cumprod(np.r_[U(1), np.full(n, U(b))], dtype=np.uint64)
    return series(BASE), series(INVERSE)


class Hashes:
    """Hash of any stretch of less than 512 bytes of an array, from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        size = 1 << max(16, int(len(data)).bit_length())
        power, self.inverse = _powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[data] * power[:len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            k = len(self.sums) - n
            return mix((self.sums[n:] - self.sums[:k]) * self.inverse[:k] + U(n))


def word_hashes(parts: list[list[bytes]]) -> np.ndarray:
    """xxh3 of every word, one after another; each distinct word is hashed once.

    Sums of byte hashes times powers, as in ``Hashes``, are for stretches of
    bounded length: long words can be built on which they agree.
    """
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
    return np.array([xxhash.xxh3_64_intdigest(w) for w in number], dtype=np.uint64)[ids]


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): the sorted distinct shingle hashes of text i are tokens[bounds[i]:bounds[i + 1]].

    A-Z count as a-z.  A text with fewer words than a shingle has one token,
    the hash of all its words; one without words has none.
    """
    # bytes.lower() changes A-Z only, bytes.split() parts at \x20 and \x09-\x0D only.
    parts = [(t or "").encode().lower().split() for t in texts]
    h = word_hashes(parts)
    n_words = np.array([len(p) for p in parts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])  # of each text's words
    factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | U(1)
    n = max(0, len(h) - words + 1)
    with np.errstate(over="ignore"):
        s = np.zeros(n, dtype=np.uint64)
        for i in range(words):
            s += h[i:i + n] * factors[i]
        s = mix(s)
        owner = np.repeat(np.arange(len(texts)), n_words)
        inside = owner[:n] == owner[words - 1:words - 1 + n] if n else np.zeros(0, dtype=bool)
        tokens, of = s[inside], owner[:n][inside]
        short = np.flatnonzero((n_words > 0) & (n_words < words))
        if len(short):
            few = [mix(np.array([(h[first[i]:first[i + 1]] * factors[:n_words[i]]).sum(dtype=np.uint64) + U(n_words[i])], dtype=np.uint64))[0] for i in short]
            at = np.searchsorted(of, short)
            tokens, of = np.insert(tokens, at, few), np.insert(of, at, short)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        tokens[a:b].sort()
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
    return tokens[fresh], np.searchsorted(of[fresh], np.arange(len(texts) + 1))
