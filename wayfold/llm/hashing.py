"""Word and shingle hashes for the operators that run in Arrow batches, and packed sorted numbers."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

U = np.uint64
_MULTIPLY = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class WordHashes(dict):
    """Hashes of words (bytes), remembered up to a bound."""

    def __init__(self, most: int = 600_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words between U+0009 to U+000D and blanks, A-Z lower-cased: bytes know no other letters or spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a sequence of hashes."""
    if len(h) < n:
        return np.empty(0, U)
    out = np.zeros(len(h) - n + 1, U)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out + mix(h[i : len(h) - n + 1 + i])) * _MULTIPLY[i % 3]
    return mix(out)


def shingles(words: list[bytes], hashes: WordHashes, n: int = 3) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; of fewer words, the one of the whole sequence."""
    h = hashes.of(words)
    if 0 < len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], U)
    return np.unique(grams(h, n))


def pack(a: np.ndarray, delta: bool = True) -> bytes:
    """Compressed 8-byte numbers, byte plane by byte plane; differences first for sorted ones."""
    a = np.ascontiguousarray(a).astype(U, copy=False)
    if delta and len(a):
        d = np.empty_like(a)
        with np.errstate(over="ignore"):
            d[0], d[1:] = a[0], a[1:] - a[:-1]
        a = d
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes, delta: bool = True) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    a = np.ascontiguousarray(raw.reshape(8, -1).T).view(U).ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(a, dtype=U) if delta else a
