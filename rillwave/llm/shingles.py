"""Hashes of word shingles and MinHash signatures of texts, in numpy."""

from __future__ import annotations

import hashlib
import re

import numpy as np

#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
#: Bytes of a text that are split into words at once (about).
SLICE = 4_000_000

_U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """64-bit digests of words; those of recent short words are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of UTF-8 text, A-Z lowered, in order.

    lower() and split() of bytes know ASCII only: they take A-Z and just these six characters of white space.
    """
    parts = []
    for part in _slices(data):
        words = part.lower().split()
        parts.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _slices(data: bytes) -> list[bytes]:
    """The text cut at white space into parts of about SLICE bytes (one word stays whole), so that few words are held at once."""
    if len(data) <= SLICE:
        return [data]
    cuts = [0]
    while len(data) - cuts[-1] > SLICE and (m := _SPACE.search(data, cuts[-1] + SLICE)):
        cuts.append(m.start())
    return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, the whole sequence as one; none: empty."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = min(k, len(w))
    s = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        s = s * _U(0x2545F4914F6CDD1D) + w[j : len(w) - n + 1 + j]
    return np.unique(mix(s))


class MinHash:
    """Signatures of n coordinates: the least value of (x ^ r) * a over a set, each coordinate with its own r and a.

    The last bits of an entry are the number of its coordinate, so that an entry by itself is a pair of coordinate and value.
    """

    def __init__(self, n: int, seed: int = 7):
        stream = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))
        self.r, self.a = stream[:n, None], stream[n:, None] | _U(1)
        self.places, self.mask = np.arange(n, dtype=np.uint64), _U((1 << (n - 1).bit_length()) - 1)

    def signature(self, values: np.ndarray) -> np.ndarray:
        best = np.full(len(self.r), ~_U(0), dtype=np.uint64)
        for at in range(0, len(values), 4096):
            best = np.minimum(best, ((values[None, at : at + 4096] ^ self.r) * self.a).min(axis=1))
        return (best & ~self.mask) | self.places


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits of a set, given as its sorted members."""
    return hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest()
