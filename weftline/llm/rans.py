"""Static range asymmetric numeral system for token ids: interleaved lanes, checkpoints, and a checksum per block.

A block holds up to ``BLOCK`` ids. Id ``i`` belongs to lane ``i % LANES``; all lanes share one stream of 32-bit words,
and each step codes one id of every lane at once. Every ``STEPS`` steps the states of the lanes and the place in the
stream are noted, so that the parts of a block, like blocks themselves, can be decoded independently.

Layout, little-endian: magic, number of ids, number of parts, number of words and crc32 of the ids (32 bits each);
per part the words before it (32 bits) and ``LANES`` states (64 bits); the words.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = 0x31534E52
BLOCK, LANES, STEPS = 1 << 18, 2048, 64
#: Bits of the frequencies' common total, and the least state.
SCALE, LOW = 20, np.uint64(1 << 31)


def normalize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``1 << SCALE``, at least 1 for each id that occurs."""
    counts = np.asarray(counts, np.int64)
    total, size = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    used = counts > 0
    if used.sum() > size:
        raise ValueError("more different ids than the table has room for")
    freq = np.where(used, np.maximum(1, (counts.astype(float) * (size / total)).astype(np.int64)), 0)
    short = size - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    while short:
        # hand out or take back, from the most frequent on, never more than leaves 1
        share = np.maximum(1, np.abs(short) * freq[order] // size)
        if short < 0:
            share = np.minimum(share, freq[order] - 1)
        share = np.where(used[order], np.maximum(share, 0), 0)
        before = np.cumsum(share) - share
        share = np.clip(abs(short) - before, 0, share)
        freq[order] += np.sign(short) * share
        short -= int(np.sign(short) * share.sum())
    return freq


class Table:
    """The shared frequency table of a corpus, ready for coding."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.most = (LOW >> np.uint64(SCALE) << np.uint64(32)) * self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, np.int64))

    def encode(self, ids: np.ndarray) -> bytes:
        """One block. Ids that the table has no frequency for are refused."""
        ids = np.ascontiguousarray(ids, np.uint32)
        n = len(ids)
        if n > BLOCK or n and not self.freq[ids].all():
            raise ValueError("a block is too long or holds an id that the table lacks")
        steps = -(-n // LANES)
        state = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        written, parts = 0, []
        freq, start, most = self.freq[ids], self.start[ids], self.most[ids]
        low32, shift, scale = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(SCALE)
        for step in range(steps - 1, -1, -1):
            here = slice(step * LANES, min(n, (step + 1) * LANES))
            x, f = state[: here.stop - here.start], freq[here]
            full = x >= most[here]
            if full.any():
                out = (x[full] & low32).astype(np.uint32)
                words.append(out)
                written += len(out)
                x = np.where(full, x >> shift, x)
            q = x // f
            state[: here.stop - here.start] = (q << scale) + (x - q * f) + start[here]
            if step % STEPS == 0:
                parts.append((written, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        head = np.array([MAGIC, n, len(parts), written, zlib.crc32(ids.astype("<u4").tobytes())], "<u4").tobytes()
        noted = b"".join(np.uint32(written - w).astype("<u4").tobytes() + s.astype("<u8").tobytes() for w, s in parts[::-1])
        return head + noted + stream.astype("<u4").tobytes()

    def decode_part(self, block: bytes, part: int) -> np.ndarray:
        """The ids of one part of a block, from its checkpoint on."""
        _, n, _, n_words, _ = read_head(block)
        n_parts = -(-(-(-n // LANES)) // STEPS)
        at = 20 + part * (4 + 8 * LANES)
        place = int(np.frombuffer(block, "<u4", 1, at)[0])
        state = np.frombuffer(block, "<u8", LANES, at + 4).astype(np.uint64)
        words = np.frombuffer(block, "<u4", n_words, 20 + n_parts * (4 + 8 * LANES))
        first, last = part * STEPS * LANES, min(n, (part + 1) * STEPS * LANES)
        out = np.empty(last - first, np.uint32)
        mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for at in range(0, last - first, LANES):
            width = min(LANES, last - first - at)
            x = state[:width]
            slot = x & mask
            symbol = self.slots[slot]
            out[at : at + width] = symbol
            x = self.freq[symbol] * (x >> scale) + slot - self.start[symbol]
            need = np.flatnonzero(x < LOW)
            if len(need):
                x[need] = (x[need] << shift) | words[place : place + len(need)]
                place += len(need)
            state[:width] = x
        return out

    def decode(self, block: bytes) -> np.ndarray:
        """All ids of a block, checked against its checksum."""
        _, n, n_parts, _, crc = read_head(block)
        ids = np.concatenate([self.decode_part(block, p) for p in range(n_parts)]) if n else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids don't match its checksum")
        return ids


def read_head(block: bytes) -> tuple[int, ...]:
    head = tuple(int(v) for v in np.frombuffer(block, "<u4", 5))
    if head[0] != MAGIC:
        raise ValueError("not a block of this format")
    return head


def crc32_combine(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from their own and the second's length."""

    def times(matrix: list[int], vector: int) -> int:
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector, i = vector >> 1, i + 1
        return out

    if not length:
        return first
    matrix = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit, for the polynomial of crc32
    for _ in range(3):
        matrix = [times(matrix, row) for row in matrix]  # one zero byte
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix = [times(matrix, row) for row in matrix]
        length >>= 1
    return first ^ second
