"""Small helpers for tasks: words as bytes, stable 64-bit hashes of words, and hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


class WordHashes(dict):
    """Hash of a word, computed once per task while the vocabulary is below a bound."""

    bound = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space with A-Z lowered; on bytes, lower() and split() touch ASCII only."""
    return text.lower().split()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of `size` words, in the order of the text."""
    n = len(hashes) - size + 1
    out = hashes[:n] * _M2 + np.uint64(size)
    for k in range(1, size):
        out ^= out >> _R
        out *= _M1
        out += hashes[k : k + n]
    out ^= out >> _R
    out *= _M2
    out ^= out >> _R
    return out


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingles(hashes, min(size, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)
