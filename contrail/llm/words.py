"""Words, word grams and their 64-bit hashes, as numpy arrays.

A word is a maximal run of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``) after lower-casing A-Z; on UTF-8 bytes these are
exactly ``bytes.lower`` and ``bytes.split``.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

from contrail.llm.shared import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def split_words(data: bytes) -> list[bytes]:
    return data.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, in order (empty if fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i:i + n]) * _STEP
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_set(data: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of a text; with fewer than k
    words the whole sequence is one shingle; no words, no shingles."""
    words = split_words(data) if data else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words))))
