"""Packing tokenized documents into windows by Karmarkar-Karp multiway differencing.

Whole windows are cut off long documents first. What is left of each document is partitioned, group by group: partial
partitions merge so that the fullest window of one meets the emptiest of the other, which gives near-equal windows; if
the fullest exceeds the capacity, the group gets one more. Then the next documents are cut to fill each window up.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_of
from weftline.llm.tokens import PieceCodec, give_back

#: Windows of a group, and the share of their room that is partitioned; the rest is filled up.
GROUP, SHARE = 8, 0.85
#: Longest piece in a partition's last group, which nothing is left to fill up.
LAST_PIECE = 128
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Partition positions of ``sizes`` into ``windows`` lists of near-equal sums by the largest differencing method."""
    if windows == 1 or len(sizes) < 2:
        return [list(range(len(sizes))), *([] for _ in range(windows - 1))]
    # a partial partition: windows by rising sum above the least, each with a chain of positions
    heap = [(-size, i, [(0, None)] * (windows - 1) + [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(
            ((x + y, (p, q) if p is not None and q is not None else q if p is None else p) for (x, p), (y, q) in zip(a, reversed(b), strict=True)),
            key=lambda window: window[0],
        )
        least = merged[0][0]
        heapq.heappush(heap, (least - merged[-1][0], made, [(s - least, chain) for s, chain in merged]))
        made += 1
    out = []
    for _, chain in heap[0][2]:
        found, todo = [], [chain]
        while todo:
            link = todo.pop()
            if isinstance(link, tuple):
                todo += link
            elif link is not None:
                found.append(link)
        out.append(sorted(found))
    return out


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: as few as can hold the sum, more while differencing exceeds it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if max(sum(sizes[i] for i in own) for own in found) <= capacity:
            return [own for own in found if own]
        windows += 1


class Packer:
    """Packs a stream of (key, size) into windows; returns (key, start, length, window, offset) of pieces."""

    def __init__(self, capacity: int):
        self.capacity, self.window = capacity, 0
        self.items: deque = deque()
        self.size = 0

    def add(self, key, size: int) -> list[tuple]:
        out, at = [], 0
        while size - at >= self.capacity:
            out.append((key, at, self.capacity, self.window, 0))
            self.window, at = self.window + 1, at + self.capacity
        if size > at:
            self.items.append((key, at, size - at))
            self.size += size - at
        if self.size >= 2 * GROUP * self.capacity:  # enough to fill up even half-full windows
            out += self.group()
        return out

    def group(self) -> list[tuple]:
        chosen, total = [], 0
        while total < SHARE * GROUP * self.capacity:
            chosen.append(self.items.popleft())
            total += chosen[-1][2]
        self.size -= total
        return self.windows(chosen, fill=True)

    def windows(self, chosen: list[tuple], fill: bool) -> list[tuple]:
        out = []
        for own in partition([size for _, _, size in chosen], self.capacity):
            offset = 0
            for i in own:
                key, at, size = chosen[i]
                out.append((key, at, size, self.window, offset))
                offset += size
            while fill and offset < self.capacity and self.items:
                key, at, size = self.items.popleft()
                take = min(size, self.capacity - offset)
                if take < size:
                    self.items.appendleft((key, at + take, size - take))
                out.append((key, at, take, self.window, offset))
                offset, self.size = offset + take, self.size - take
            self.window += 1
        return out

    def end(self) -> list[tuple]:
        """The last group: what is left, cut small."""
        cut = [(key, at + k, min(LAST_PIECE, size - k)) for key, at, size in self.items for k in range(0, size, LAST_PIECE)]
        self.items.clear()
        self.size = 0
        return self.windows(cut, fill=False) if cut else []


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs(doc_id, text)``: what of the document goes where in which window.

    Tokenizes and packs within the partitions as they are read, without a shuffle; a partition's last group alone has
    windows that aren't full. ``with_ids`` adds the piece's ids. A null text is an empty one, its only id the end id.
    Repeated rows are packed as often as they occur; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        codec, packer = PieceCodec.of(tokenizer_path), Packer(capacity)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}
        serial = 0

        def rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not pieces:
                return
            cols: list[list] = [[] for _ in range(8)]
            for key, start, length, window, offset in pieces:
                doc_id, ids, left = own = held[key]
                part = ids[start : start + length]
                values = (doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + window, offset, part if with_ids else None)
                for col, value in zip(cols, values, strict=True):
                    col.append(value)
                own[2] = left - length
                if not own[2]:
                    del held[key]
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([p.astype(np.int32) for p in cols[7]], pa.list_(pa.int32())))
            yield pa.record_batch(arrays, names)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, ids, bounds in codec.ids_of(batch.column(1), end_id):
                out: list[tuple] = []
                for i in range(len(bounds) - 1):
                    own = ids[bounds[i] : bounds[i + 1]]
                    held[serial] = [doc_ids[first + i], own, len(own)]
                    out += packer.add(serial, len(own))
                    serial += 1
                yield from rows(out)
                for own in held.values():
                    own[1] = own[1].copy()  # else a few documents keep the ids of the whole slice
        yield from rows(packer.end())

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), text_of().cast("string")).mapInArrow(run, schema)
