"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 200_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words; a shorter text is one shingle as a whole.

    Words are runs of other than ASCII white space, with A-Z in lower case. Different shingles get different
    hashes but for a chance of about 2**-64 per pair.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, size)
    x = np.full(n - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        x = _finish(x * MIX[1] + h[k : k + len(x)] * MIX[k % len(MIX)] + MIX[0])
    return np.unique(x)
