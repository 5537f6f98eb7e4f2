"""Sets of word shingles and their MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5  # words of a shingle
MUL = np.uint64(0x9E3779B97F4A7C15)
KNOWN_WORDS = 150_000


class Shingler:
    """Hashed shingle sets of texts: A-Z lower-cased, words between \\x20 and \\x09-\\x0D, five words each; fewer words are one shingle."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        found = list(map(known.get, tokens))
        if None in found:
            if len(known) > KNOWN_WORDS:
                known.clear()
            for i, h in enumerate(found):
                if h is None:
                    found[i] = known[tokens[i]] = xxhash.xxh3_64_intdigest(tokens[i])
        return np.array(found, np.uint64)

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        w = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(w):
            return w
        n = max(len(w) - SIZE + 1, 1)
        with np.errstate(over="ignore"):
            h = np.full(n, min(len(w), SIZE), np.uint64)
            for k in range(min(len(w), SIZE)):
                h = (h ^ w[k : k + n]) * MUL
                h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return np.unique(h)


def signatures(sets: list[np.ndarray], slots: int, seed: int = 11) -> np.ndarray:
    """(sets, slots) uint32 minima of random linear functions of the hashes; all ones for an empty set."""
    out = np.full((len(sets), slots), 0xFFFFFFFF, np.uint32)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, slots, dtype=np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    low = 0
    while low < len(some):
        high, n = low, 0
        while high < len(some) and (high == low or n + len(sets[some[high]]) <= 30_000):
            n += len(sets[some[high]])
            high += 1
        pick = some[low:high]
        x = np.concatenate([sets[i] for i in pick])
        bounds = np.cumsum([0, *(len(sets[i]) for i in pick[:-1])])
        y = np.empty_like(x)
        with np.errstate(over="ignore"):
            for k in range(slots):
                np.multiply(x, a[k], out=y)
                np.add(y, b[k], out=y)
                out[pick, k] = np.minimum.reduceat(y, bounds) >> np.uint64(32)
        low = high
    return out
