"""Word shingles as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHashes(dict):
    """Word to hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def words(text: str) -> list[bytes]:
    """A-Z lower-cased and cut at space and \\x09-\\x0D; bytes.split cuts at exactly these."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(text: str | None, size: int, memory: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles; of all words as one if there are fewer; empty without words."""
    found = words(text) if text else []
    if not found:
        return np.empty(0, _U)
    w = np.fromiter(map(memory.__getitem__, found), _U, len(found))
    n = max(1, len(w) - size + 1)
    total = np.full(n, len(w) if len(w) < size else size, _U)
    for j in range(min(size, len(w))):
        total = mix(total * _U(0x9E3779B97F4A7C15) + w[j : j + n])
    return np.unique(total)


class Minhash:
    """`t` minwise values of 32 bits by multiply-shift on mixed hashes."""

    def __init__(self, t: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, t, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.b = rng.integers(0, 2**63, t, dtype=np.int64).astype(_U)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(s), 512):
            v = ((s[None, i : i + 512] * self.a[:, None] + self.b[:, None]) >> _U(32)).min(axis=1)
            best = np.minimum(best, v.astype(np.uint32))
        return best
