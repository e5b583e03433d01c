"""Words of many texts at once, hashed in numpy.

A block of texts is one byte buffer. Prefix sums of byte * P^i give every word's polynomial in the odd number P (modulo
2^64, so P has an inverse) with a handful of vector operations, however many words there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

P1, P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept for the next call."""
    key = (base, 1 << max(12, (n - 1).bit_length()))
    if key not in _powers:
        made = np.full(key[1], base, np.uint64)
        made[0] = 1
        _powers[key] = np.multiply.accumulate(made)
    return _powers[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


class Words:
    """All words of a list of texts: start and end in the buffer, and how many each text has."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(self.raw, np.uint8)
        space = np.concatenate([[True], _SPACE[self.bytes]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_start = np.cumsum(sizes) - sizes
        self.first = np.searchsorted(self.start, np.append(self.text_start, len(self.bytes)))
        self.counts = np.diff(self.first)

    def hashes(self, base: int = P1) -> np.ndarray:
        n = len(self.bytes)
        up, down = powers(base, n + 1), powers(pow(base, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def word(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.end[k]]


def runs(h: np.ndarray, width: int, base: int = P2) -> np.ndarray:
    """A hash of every run of `width` values; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(h) + 1), powers(pow(base, -1, 1 << 64), len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[:n])


def blocks(texts: list[str | None], size: int = 1_500_000) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in UTF-8, some at a time: position of the first, and texts of about `size` characters together (one longer text is a block of its own)."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size or k == len(texts) - 1:
            yield start, [(x or "").encode("utf-8", "surrogatepass") for x in texts[start : k + 1]]
            start, held = k + 1, 0
