"""Closures over a dependency relation, for one target or for many at once."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.session import discard, materialize

#: Targets whose reach is kept in one number.
BITS = 64

#: From so many targets on, parts of the graph that nothing connects are told apart, and those of at most so many edges are
#: walked by a task each.
MANY, SMALL_PART = 256, 1_500_000

#: Rows that are sent to all tasks, at most.
MOST_BROADCAST = 2_000_000


class Reach(NamedTuple):
    """What reaches 64 targets at a time: ``bits(block, id, any, exact)``, two numbers with a bit for each of the targets
    (block, bit, target); a target is no part of its own reach."""

    bits: DataFrame
    targets: DataFrame

    def pairs(self, *columns: str) -> DataFrame:
        """target, id, exact of all pairs, and columns that ``bits`` may have been joined with."""
        rows = self.bits.join(F.broadcast(self.targets) if self.targets.count() <= MOST_BROADCAST // 8 else self.targets, "block")
        return rows.where("(any & bit) <> 0").select("target", "id", ((F.col("exact").bitwiseAND(F.col("bit"))) != 0).alias("exact"), *columns)

    def gathered(self) -> Reach:
        """The same with the rows of a block in a few tasks, for sums by target."""
        return self._replace(bits=self.bits.repartition("block", F.pmod(F.xxhash64("id"), F.lit(8))))


def closure(deps: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """target, id, exact of all that reaches each target of ``seeds(target, id, exact)`` over ``deps(src, dst, exact)``.

    A path is exact if all its hops are, a node if some path to it is; at a bound of ``depth`` hops, if some exact path
    is that short. The target is never part of its own closure and is not walked through. Cycles and duplicate edges
    are fine; rows with null ends reach nothing, a null confidence counts as heuristic.
    """
    return reach(deps, seeds, depth).pairs()


def reach(deps: DataFrame, seeds: DataFrame, depth: int | None = None) -> Reach:
    """The pairs of ``closure``, before they are made.

    Targets are numbered in their order, and what reaches 64 of them is one row per node: a number with a bit for each
    target, and one for those that an exact path leads to. A round is a join of the rows with new bits, a bitwise-or with
    partial aggregation, and one write of what is known by then into the shared folder, so plans stay short, a round is
    one job, and lost executors cost no more than that.

    A round of many targets sends rows for each edge and block. So parts of the graph that nothing connects are found
    first; those that have no more than ``SMALL_PART`` edges go to a task each, which walks them in its memory.
    """
    deps = deps.select(F.col("src").alias("next"), F.col("dst").alias("id"), F.coalesce("exact", F.lit(False)).alias("hop")).where("next is not null and id is not null")
    seeds = seeds.where("id <> target").select("target", "id", F.coalesce("exact", F.lit(False)).alias("exact"))
    whole_numbers = {kind for d in (deps, seeds) for c, kind in d.dtypes if c in ("id", "target", "next")} <= {"int", "bigint"}
    targets = seeds.select("target").distinct()
    if depth is not None or not whole_numbers or targets.count() < MANY:
        return _by_rounds(deps, seeds, _numbered(targets, "target"), depth)
    part = parts(deps.select(F.col("next").alias("src"), F.col("id").alias("dst")))
    by_id = part.select("id", "part")
    seeds = materialize(seeds.join(_some(by_id), "id", "left").select("target", "id", "exact", F.coalesce("part", F.col("id").cast("long")).alias("part")), "seeds")
    # targets of one part stand together, so that its rows are full
    numbers = _numbered(seeds.groupBy("target").agg(F.min("part").alias("part")), "part", "target")
    edges = deps.join(_some(by_id), "id")
    large = materialize(edges.groupBy("part").count().where(F.col("count") > SMALL_PART).select("part"), "large-parts")
    found = _by_parts(edges.join(large, "part", "left_anti"), seeds.join(large, "part", "left_anti"), numbers)
    if large.isEmpty():
        return Reach(found, numbers)
    rest = _by_rounds(materialize(edges.join(large, "part", "left_semi").drop("part"), "large-deps"), seeds.join(large, "part", "left_semi").drop("part"), numbers)
    return Reach(found.unionByName(rest.bits), numbers)


def _numbered(targets: DataFrame, *order: str) -> DataFrame:
    """block, bit, target; targets that follow one another are in one block."""
    rows = materialize(targets.orderBy(*order).select("target", F.monotonically_increasing_id().alias("n")), "targets")
    numbered = rows.select(F.expr(f"n div {BITS}").alias("block"), F.expr(f"shiftleft(1L, cast(n % {BITS} as int))").alias("bit"), "target")
    return numbered


def _some(rows: DataFrame) -> DataFrame:
    """A table of nodes, to be broadcast if it is counted to be small."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def parts(edges: DataFrame) -> DataFrame:
    """id and part of every end of ``edges(src, dst)``, whole numbers: equal for two that any edges connect.

    Every node points to the least that it leads to, if that is less than itself, and pointers are followed to their ends. What
    edges are left between ends are few, and are treated in the same way until there are none.
    """
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    nodes = edges.groupBy("src").agg(F.min("dst").alias("to")).select(F.col("src").alias("id"), F.least("src", "to").alias("part"))
    nodes = nodes.unionAll(edges.select("dst", "dst").distinct()).groupBy("id").agg(F.min("part").alias("part"))
    at = _ends(materialize(nodes, "parts"))
    while True:
        of = lambda end: _some(at.select(F.col("id").alias(end), F.col("part").alias(f"of_{end}")))
        left = edges.join(of("src"), "src").join(of("dst"), "dst").where("of_src <> of_dst")
        left = materialize(left.select(F.greatest("of_src", "of_dst").alias("src"), F.least("of_src", "of_dst").alias("dst")).distinct(), "between-parts")
        if left.isEmpty():
            discard(left)
            return at
        ends = _ends(materialize(left.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("part")), "parts"))
        was, at = at, materialize(at.join(_some(ends.toDF("part", "onward")), "part", "left").select("id", F.coalesce("onward", "part").alias("part")), "parts")
        # the edges that were within parts stay within them
        discard(was, ends)
        edges = left


def _ends(pointers: DataFrame) -> DataFrame:
    """id and the end of its way along ``pointers(id, part)``, each to no greater a number; all ways are halved until none is left."""
    while True:
        onward = pointers.where("part <> id").toDF("part", "onward")
        watched = Observation()
        step = pointers.join(_some(onward), "part", "left")
        step = step.select("id", F.coalesce("onward", "part").alias("part"), F.col("onward").isNotNull().alias("moved"))
        jumped = materialize(step.observe(watched, F.count_if("moved").alias("n")).drop("moved"), "parts")
        discard(pointers)
        pointers = jumped
        if not watched.get["n"]:
            return pointers


def _by_parts(edges: DataFrame, seeds: DataFrame, numbers: DataFrame) -> DataFrame:
    """block, id, any, exact: each part of ``edges(next, id, hop, part)`` walked by one task."""
    kind = dict(seeds.dtypes)["id"]
    own = _some(numbers.withColumnRenamed("target", "of"))
    asked = seeds.select("part", F.col("id").cast("long").alias("next"), F.col("target").alias("of"), F.col("exact").alias("hop")).join(own, "of")
    asked = asked.select("part", "next", F.col("of").cast("long").alias("id"), "hop", "block", "bit")
    steps = edges.join(asked.select("part").distinct(), "part", "left_semi").select("part", F.col("next").cast("long").alias("next"), F.col("id").cast("long").alias("id"), "hop", F.lit(None).cast("long").alias("block"), F.lit(0).cast("long").alias("bit"))
    walked = steps.unionAll(asked).groupBy("part").applyInArrow(_walk, "block long, id long, any long, exact long")
    return materialize(walked.select("block", F.col("id").cast(kind).alias("id"), "any", "exact"), "closure")


def _walk(table):
    """What reaches the targets of one part: rows with a block say where a target is reached first, the others are edges."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    first = table.filter(pc.is_valid(table["block"]))
    edges = table.filter(pc.is_null(table["block"]))
    column = lambda t, name: t[name].to_numpy()
    nodes = np.unique(np.concatenate([column(table, "next"), column(table, "id")]))
    place = lambda t, name: np.searchsorted(nodes, column(t, name)).astype(np.int32)
    to, start, hop = place(edges, "next"), place(edges, "id"), column(edges, "hop")
    order = np.argsort(to, kind="stable")
    to, start, hop = to[order], start[order], hop[order]
    firsts = np.flatnonzero(np.diff(to, prepend=-1))
    heads, exact_start = to[firsts], np.flatnonzero(hop)
    exact_firsts = np.flatnonzero(np.diff(to[exact_start], prepend=-1))
    exact_heads, exact_from = to[exact_start][exact_firsts], start[exact_start]
    seed, target = place(first, "next"), place(first, "id")
    blocks, bits, sure = column(first, "block"), column(first, "bit").astype(np.int64).view(np.uint64), column(first, "hop")
    out = []
    for block in np.unique(blocks):
        mine = blocks == block
        own = np.zeros(len(nodes), np.uint64)
        np.bitwise_or.at(own, target[mine], bits[mine])
        found = []
        for begun, sources, begin, ends in ((mine, start, firsts, heads), (mine & sure, exact_from, exact_firsts, exact_heads)):
            has = np.zeros(len(nodes), np.uint64)
            np.bitwise_or.at(has, seed[begun], bits[begun])
            has &= ~own
            while len(begin):
                more = np.bitwise_or.reduceat(has[sources], begin) & ~own[ends]
                if not (more & ~has[ends]).any():
                    break
                has[ends] |= more
            found.append(has)
        some = np.flatnonzero(found[0])
        out.append(pa.table({"block": np.full(len(some), block), "id": nodes[some], "any": found[0][some].view(np.int64), "exact": found[1][some].view(np.int64)}))
    return pa.concat_tables(out)


def _by_rounds(deps: DataFrame, seeds: DataFrame, numbered: DataFrame, depth: int | None = None) -> Reach:
    first = seeds.join(numbered, "target").groupBy("block", "id").agg(_either(F.col("bit")).alias("any"), _either(F.when(F.col("exact"), F.col("bit")).otherwise(0)).alias("exact"))
    # a target counts as known to itself, so it is neither found nor passed
    own = numbered.groupBy("block", F.col("target").alias("id")).agg(_either(F.col("bit")).alias("any")).select("block", "id", "any", F.col("any").alias("exact"))
    known, left = _learn(own, first)
    rounds = 1
    while left and (depth is None or rounds < depth):
        new = known.where("new_any <> 0 or new_exact <> 0").select("block", "id", "new_any", "new_exact")
        exact = F.when(F.col("hop"), F.col("new_exact")).otherwise(0)
        found = new.join(deps, "id").groupBy("block", F.col("next").alias("id")).agg(_either(F.col("new_any")).alias("any"), _either(exact).alias("exact"))
        was = known
        known, left = _learn(was.select("block", "id", "any", "exact"), found)
        discard(was)  # the new table has all that it had
        rounds += 1
    own = own.select("block", "id", F.col("any").alias("own"))
    others = lambda c: F.col(c).bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0).cast("long")))).alias(c)
    bits = known.join(F.broadcast(own) if numbered.count() <= MOST_BROADCAST // 8 else own, ["block", "id"], "left").select("block", "id", others("any"), others("exact"))
    return Reach(bits.where("any <> 0"), numbered)


def _either(bits: Column) -> Column:
    return F.bit_or(bits.cast("long"))


def _learn(known: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """What is known with what was found, the bits of both that are new, and how many rows have such."""
    was, now = known.toDF("block", "id", "was_any", "was_exact"), found.toDF("block", "id", "now_any", "now_exact")
    bits = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    both = was.join(now, ["block", "id"], "full_outer")
    new = lambda kind: bits(f"now_{kind}").bitwiseAND(F.bitwise_not(bits(f"was_{kind}"))).alias(f"new_{kind}")
    every = lambda kind: bits(f"now_{kind}").bitwiseOR(bits(f"was_{kind}")).alias(kind)
    watched = Observation()
    rows = both.select("block", "id", every("any"), every("exact"), new("any"), new("exact"))
    written = materialize(rows.observe(watched, F.count_if((F.col("new_any") != 0) | (F.col("new_exact") != 0)).alias("n")), "closure")
    return written, watched.get["n"]


def dependents(deps: DataFrame, targets: DataFrame, depth: int | None = None) -> DataFrame:
    """target, id, exact: what depends on each of ``targets(target)``, directly or through others."""
    return closure(deps, direct(deps, targets), depth)


def direct(deps: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id, exact: what has a dependency on each of ``targets(target)`` itself."""
    return deps.join(targets, deps["dst"] == targets["target"]).select("target", F.col("src").alias("id"), "exact")


def dependencies(deps: DataFrame, targets: DataFrame, depth: int | None = None) -> DataFrame:
    """target, id, exact: what each of ``targets(target)`` depends on, directly or through others."""
    return dependents(deps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "exact"), targets, depth)


def reached_from(deps: DataFrame, entries: DataFrame) -> DataFrame:
    """id, exact: what any of ``entries(id)`` depends on, directly or through others; an entry too, if another does."""
    first = deps.join(entries.select(F.col("id").alias("src")), "src").select(F.lit("").alias("target"), F.col("dst").cast("string").alias("id"), "exact")
    backwards = deps.select(F.col("dst").cast("string").alias("src"), F.col("src").cast("string").alias("dst"), "exact")
    kind = dict(entries.dtypes)["id"]
    return closure(backwards, first).select(F.col("id").cast(kind).alias("id"), "exact")


#: Rounds that are kept apart before they are written into one table.
ROUNDS = 8


def reachable(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """id of ``seeds(id)`` and of all that a way along ``pairs(src, dst)`` leads to from them.

    A round writes what is new alone. Every few rounds these are merged into one table and removed, so neither plans
    nor the folder grow with the number of rounds. The result is a table in the shared folder.
    """
    pairs = materialize(pairs.select("src", "dst"), "pairs")
    parts = [materialize(seeds.where("id is not null").distinct(), "reached")]
    while not parts[-1].isEmpty():
        found = parts[-1].join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).where("id is not null").distinct()
        parts.append(materialize(found.join(reduce(DataFrame.unionAll, parts), "id", "left_anti"), "reached"))
        if len(parts) > ROUNDS:
            # the newest stays apart, as the next round starts from it
            merged = materialize(reduce(DataFrame.unionAll, parts[:-1]), "reached")
            discard(*parts[:-1])
            parts = [merged, parts[-1]]
    whole = materialize(reduce(DataFrame.unionAll, parts), "reached")
    discard(pairs, *parts)
    return whole
