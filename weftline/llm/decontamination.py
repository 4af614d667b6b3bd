"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most ``e`` edits leaves at least one of any ``e + 1`` disjoint pieces of it
intact. So each item is split into that many pieces, all pieces are looked for exactly in one pass of an Aho-Corasick
automaton. Cut into tiles of a few characters, all but ``e`` of an item's tiles lie in the text around a hit, too; where
they do, Myers' bit-parallel edit distance decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_of
from weftline.llm.tokens import give_back

#: Edits allowed, as a share of an item's length after normalization.
ERRORS = 0.08
#: Items, and their code points, that one broadcast holds at most; more items are taken in several such blocks.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8 << 20
#: Characters of a tile.
TILE = 4
WORD = re.compile(r"[^\W_]+")
LEAKS = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str) -> str:
    """The words of a text in lower case, joined by one space."""
    return " ".join(WORD.findall(text.lower()))


def budget(length: int, errors: float = ERRORS) -> int:
    return int(length * errors)


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """An item's error-budget-plus-one disjoint pieces of near-equal length, with their offsets."""
    k = budget(len(item), errors) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item for Myers' algorithm: the positions of each of its characters as bits, and its tiles."""

    def __init__(self, item: str):
        self.length = len(item)
        self.tiles = [item[i : i + TILE] for i in range(0, len(item) - TILE + 1, TILE)]
        self.positions: dict[str, int] = {}
        for i, c in enumerate(item):
            self.positions[c] = self.positions.get(c, 0) | 1 << i

    def near(self, text: str, most: int) -> bool:
        """False only if ``best`` finds nothing: an edit spoils one tile at most, so all but ``most`` occur in ``text``."""
        for tile in self.tiles:
            if tile not in text:
                most -= 1
                if most < 0:
                    return False
        return True

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """The least distance of the pattern to any substring of ``text``, and where the first such ends; none over ``most``."""
        m = self.length
        mask, top = (1 << m) - 1, 1 << m - 1
        plus, minus, score = mask, 0, m
        found, end, get = most + 1, -1, self.positions.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            x = eq | minus
            d0 = (((x & plus) + plus) ^ plus) | x
            hp = minus | ~(d0 | plus) & mask
            hm = plus & d0
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
                if score < found:
                    found, end = score, j
                    if not score:
                        break
            hp = hp << 1 & mask
            plus = hm << 1 & mask | ~(d0 | hp) & mask
            minus = hp & d0
        return (found, end) if end >= 0 else None


class Matcher:
    """Finds all items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        import ahocorasick

        self.items = [(item_id, n) for item_id, text in items if (n := normal(text))]
        self.budgets = [budget(len(n), errors) for _, n in self.items]
        self.patterns: dict[int, Pattern] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, n) in enumerate(self.items):
            for offset, piece in pieces(n, errors):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match of each item, in the normalized text; ``first``: stop at one."""
        n = normal(text)
        if self.empty or not n:
            return []
        tried: dict[int, set[int]] = {}
        found: dict[int, tuple[int, int, int, int]] = {}
        for last, (size, at) in self.automaton.iter(n):
            for i, offset in at:
                most = self.budgets[i]
                known = found.get(i)
                if known and not known[1]:
                    continue
                start = last + 1 - size - offset
                if start in (seen := tried.setdefault(i, set())):
                    continue
                seen.add(start)
                item = self.items[i][1]
                length = len(item)
                if start >= 0 and n.startswith(item, start):
                    if most or (start == 0 or n[start - 1] == " ") and n[start + length : start + length + 1] in ("", " "):
                        found[i] = (i, 0, start, start + length)
                elif most:
                    low = max(0, start - most)
                    window = n[low : start + length + most]
                    least = most if not known else known[1] - 1
                    pattern = self.pattern(i)
                    if pattern.near(window, least) and (got := pattern.best(window, least)):
                        end = low + got[1]
                        found[i] = (i, got[0], max(low, end - length), end)
                if first and found:
                    return list(found.values())
        return list(found.values())

    def pattern(self, i: int) -> Pattern:
        if (p := self.patterns.get(i)) is None:
            p = self.patterns[i] = Pattern(self.items[i][1])
        return p


def span(text: str, start: int, end: int) -> tuple[int, int]:
    """Where a span of the normalized text lies in the text itself, widened to whole words."""
    at, first, last = 0, None, 0
    for m in WORD.finditer(text.lower()):
        stop = at + m.end() - m.start()
        if stop > start and first is None:
            first = m.start()
        if at < end:
            last = m.end()
        at = stop + 1
    return first or 0, last


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items with a text, in blocks that are small enough to broadcast each. Blocks are fetched one by one."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def find_leaks(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """doc_id, item_id, distance, start and end of each item that occurs in each of ``docs(doc_id, text)``.

    ``start`` and ``end`` are code points of the text, widened to whole words. Texts and items are compared by their
    lower-case words; an item matches with at most ``errors`` of its length in edits, and may then be glued to the
    words around it. An item too short for an edit matches whole words only. Where edits insert or delete, ``start``
    is the end less the item's length. Null and empty texts and items without a word match nothing. Repeated rows give
    repeated results. No shuffle; the items are broadcast in blocks of bounded size, the texts read once for each.
    """
    out = None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    for block in item_blocks(items):
        bound = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            give_back()
            matcher = Matcher(bound.value, errors)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for i, distance, start, end in matcher.find(text):
                        rows.append((doc_id, matcher.items[i][0], distance, *span(text, start, end)))
                cols = zip(*rows, strict=True) if rows else ([],) * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        found = source.mapInArrow(find, LEAKS)
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``text`` holds no item; as ``find_leaks`` finds them."""
    at = docs.columns.index("text")
    for block in item_blocks(items):
        bound = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], bound=bound) -> Iterator[pa.RecordBatch]:
            give_back()
            matcher = Matcher(bound.value, errors)
            for batch in batches:
                clean = np.fromiter((not t or not matcher.find(t, first=True) for t in batch.column(at).to_pylist()), bool, batch.num_rows)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
