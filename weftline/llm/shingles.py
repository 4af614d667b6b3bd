"""Hashed word shingles of texts, by whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftline.llm.tokens import by_bytes

#: Words of a shingle.
WIDTH = 5
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text hashed at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            up, down = np.full(n, BASE), np.full(n, BASE_INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


powers = Powers()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the offsets at which each text's words begin."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - first
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8, n, first)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    powers.grow(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=sums[1:])
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return mix((sums[b] - sums[a]) * powers.down[a]), np.searchsorted(a, offsets)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The different shingles of each text, sorted. A text of fewer words has one of all its words, one without words none."""
    texts = pc.fill_null(texts, "")
    for _, some in by_bytes(texts, SLICE):
        words, offsets = word_hashes(some)
        if len(words) >= width:
            rolled = np.zeros(len(words) - width + 1, np.uint64)
            for k in range(width):
                rolled = rolled * STEP + words[k : len(words) - width + 1 + k]
            rolled = mix(rolled)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                total = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        total = total * STEP + w
                yield mix(np.array([total + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
