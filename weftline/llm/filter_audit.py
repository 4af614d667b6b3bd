"""Interaction of filters: what each removes in every order that they can be applied in.

A document's failures are a mask with a bit per filter, and only how many documents share a mask goes on from there.
The orders of the filters are walked by adjacent transpositions, so two neighbouring orders differ in two steps only;
these two are updated from the mask cells, and each filter's removals over all orders add up along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import let, text_of, words
from weftline.session import materialize

#: The filters, in the order of their bits: too short, repetitive, shouting, symbols, a copy of an earlier text.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, "[#$%&*|]"
COPY = 1 << FILTERS.index("E")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: Column) -> Column:
    """The mask of the filters A to D, which a text fails by itself."""
    found = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different"))
    mask = lambda n: reduce(add, (F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate((
        n["n"] < LEAST_WORDS,
        100 * n["different"] < DISTINCT_PERCENT * n["n"],
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        text.rlike(MARKS),
    ))))
    return let(let(words(text), found), mask).cast("int")


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of each row of ``docs(doc_id, text, lang)``, with the bit of E for later copies.

    Texts are read once; from then on a row is its id, a sha-256 of the text and a few numbers. The first of equal
    texts is found by an aggregation with partial sums, and looked up by text and id together, so a text that a third
    of the rows share is spread by its ids; rows without an id are spread by a number of their own. A document with
    several labels is good or toxic if any of them says so. A row without an id has no label and is no copy, and makes none.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_of().cast("string").alias("text"))
    rows = rows.select("doc_id", "part", own_failures(F.col("text")).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0))
    known = labels.select(doc_id.alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    rows = materialize(rows.join(known, ["doc_id", "spread"], "left"), "audit-documents")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(COPY)
    return rows.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def transpositions(n: int) -> Iterator[int]:
    """Places k where k and k + 1 of an order of ``n`` are to be swapped, one after the other, to visit all orders once."""
    order, leftwards = list(range(n)), [True] * n
    while True:
        for item in range(n - 1, -1, -1):
            at = order.index(item)
            to = at - 1 if leftwards[item] else at + 1
            if 0 <= to < n and order[to] < item:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        leftwards[item + 1 :] = [not d for d in leftwards[item + 1 :]]
        yield min(at, to)


class Walk:
    """The steps of one order at a time over ``cells``: documents, good and toxic ones (rows) by mask (columns)."""

    def __init__(self, cells: np.ndarray, filters: str = FILTERS):
        self.cells, self.masks, self.filters = cells, np.arange(cells.shape[1]), filters
        self.order = list(range(len(filters)))
        self.kept, self.lost = [0] * len(filters), [np.zeros(len(cells), np.int64)] * len(filters)
        self.visited, self.since, self.totals = 0, [0] * len(filters), [0] * len(filters)
        self.fails = [int(cells[0, self.masks >> f & 1 > 0].sum()) for f in self.order]
        self.alone = [int(cells[0, 1 << f]) for f in self.order]
        self.updated = 0
        for step in self.order:
            self.update(step)

    def update(self, step: int) -> None:
        """Work out a step from the cells: what its filter removes of the masks that no earlier filter fails."""
        before, own = sum(1 << f for f in self.order[:step]), 1 << self.order[step]
        left = self.masks & before == 0
        self.lost[step] = self.cells[:, left & (self.masks & own > 0)].sum(1)
        self.kept[step] = int(self.cells[0, left & (self.masks & own == 0)].sum())
        self.updated += 1

    def settle(self, step: int) -> None:
        """Add a filter's removals in the orders since its last change."""
        f = self.order[step]
        self.totals[f] += (self.visited - self.since[f]) * int(self.lost[step][0])
        self.since[f] = self.visited

    def rows(self) -> Iterator[tuple]:
        """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost of the current order."""
        name = "".join(self.filters[f] for f in self.order)
        for step, f in enumerate(self.order):
            removed, good, toxic = map(int, self.lost[step])
            yield name, step + 1, self.kept[step], removed, self.fails[f] - removed, self.alone[f], good, toxic

    def run(self) -> list[tuple]:
        """The rows of all orders; ``totals`` has each filter's removals over all of them afterwards."""
        out = list(self.rows())
        self.visited = 1
        for at in transpositions(len(self.order)):
            self.settle(at)
            self.settle(at + 1)
            self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]
            self.update(at)
            self.update(at + 1)
            out += self.rows()
            self.visited += 1
        for step in range(len(self.order)):
            self.settle(step)
        return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: what is kept, removed, redundant, ... (``SCHEMA``).

    Parts are the values of ``lang``, null as the empty string. A null text is an empty one, which fails A alone; equal
    rows (same id, same text) are no copies of each other. ``labels`` may be empty; an empty table of documents gives
    no rows. A part is at most 128 cells when it is walked, however many documents it has.
    """
    masks = document_masks(docs, labels)
    one = lambda flag: F.sum(F.col(flag).cast("long")).alias(flag)
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((3, 1 << len(FILTERS)), np.int64)
        table[:, group["mask"]] = group[["n", "good", "toxic"]].to_numpy(np.int64).T
        tour = Walk(table)
        rows = tour.run()
        shapley = dict(zip(FILTERS, tour.totals, strict=True))
        return pd.DataFrame([(key[0], *r, shapley[r[0][r[1] - 1]]) for r in rows], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return cells.groupBy("part").applyInPandas(walk, SCHEMA)
