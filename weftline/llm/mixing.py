"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source starts with the same number of copies, the source's target over its size: a whole part and
a probability of one copy more. Pairs of documents pass expected words between them at random, so that each keeps its
probability on average and the two keep their words together, until one of them has none or a whole copy. A group of
documents is rounded down to one open document at most; these meet in groups again, up a tree of a few levels. Only the
last open document of a source is rounded without a partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import let, text_of, words
from weftline.llm.components import look_up
from weftline.operators.ranking import running_sum
from weftline.session import materialize

#: Weights of the sources in their order, repeating, and how often a document may be taken at most.
WEIGHTS, MOST_COPIES = (1, 2, 3), 3
#: Documents of a group on average; as they are dealt by a hash, none has more than a few times as many.
FAN_IN = 128
SEED = 12
#: One part in so many of a source's words is in its small documents at least.
SMALL = 8
#: Shares of a copy that are taken for none or a whole one, as additions aren't exact.
CLOSE = 1e-9


def size_class() -> Column:
    """The binary digits of a size: sizes of a class differ by less than a factor of two."""
    return F.length(F.bin("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Size, target, copies and classes of each source of ``sizes(key, source, size, class, n)``; ``n`` rows have such a size.

    Sources are weighed by their place in the order of code points, null last. All sizes are shared by weight; a
    source above ``MOST_COPIES`` times its own size stops there and the excess is shared again, until none is above.
    Every round of that is one aggregation to a pair of whole numbers; shares only rise, so who stops once has stopped.

    ``small_class`` is the least class that has, with those below, ``SMALL`` of the source's words (``small_words``).
    """
    classes = sizes.groupBy("key", "source", "class").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"))
    every = F.array_sort(F.collect_list(F.struct("class", "words", "n"))).alias("classes")  # 64 at most
    sources = classes.groupBy("key", "source").agg(F.sum("words").alias("source_size"), every)
    up_to = lambda c, part: F.aggregate(F.filter("classes", lambda x: x["class"] <= c), F.lit(0).cast("long"), lambda n, x: n + x[part])
    small = F.filter("classes", lambda x: up_to(x["class"], "words") * SMALL >= F.col("source_size"))
    sources = sources.withColumn("small_class", F.get(small, 0)["class"])
    sources = sources.withColumns({"small_words": up_to(F.col("small_class"), "words"), "n_small": up_to(F.col("small_class"), "n")})
    sources = sources.withColumn("n_large", F.aggregate("classes", F.lit(0).cast("long"), lambda n, x: n + x["n"]) - F.col("n_small")).drop("classes")
    placed = running_sum(sources.withColumns({"last": F.col("source").isNull().cast("int"), "one": F.lit(1)}), ["last", "source"], "one", "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    placed = materialize(placed.select("key", "n_large", "n_small", "small_class", "small_words", "source_size", (MOST_COPIES * F.col("source_size")).alias("most"), weight.alias("weight")), "mix-sources")
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")
    left, weights = (int(x) for x in placed.agg(whole("source_size"), whole("weight")).first())
    total, all_weights, stops = left, weights, F.lit(False)
    while weights:
        stops = F.col("most").cast("decimal(38,0)") * F.lit(weights) <= F.col("weight") * F.lit(left).cast("decimal(38,0)")
        gone, of_weight = (int(x) for x in placed.where(stops).agg(whole("most"), whole("weight")).first())
        now = total - gone, all_weights - of_weight
        if now == (left, weights):
            break
        left, weights = now
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(max(1, weights)))
    placed = placed.withColumn("target", F.when(stops, F.col("most").cast("double")).otherwise(share)).drop("most", "weight")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return placed.withColumns({"copies": copies, "n": F.col("n_large") + F.col("n_small")})


def uniform(*of: Column) -> Column:
    """A number in [0, 1) that is fixed by the values it is of."""
    return F.shiftrightunsigned(F.xxhash64(*of, F.lit(SEED)), 11) / F.lit(float(1 << 53))


def pivot(a: Column, b: Column) -> Column:
    """Two open documents after one of them has given or taken all it can: an array of both.

    Words pass from ``a`` to ``b`` or back. Each direction is as likely as the other one is far, so neither's expected
    words change.
    """
    there = F.least(a["words"], b["size"] - b["words"])
    back = F.least(b["words"], a["size"] - a["words"])
    moved = F.when(uniform(a["draw"], b["draw"]) * (there + back) < back, -there).otherwise(back)

    def after(step: Column) -> Column:
        changed = lambda d, w: F.struct(d["size"].alias("size"), d["draw"].alias("draw"), d["doc_id"].alias("doc_id"), w.alias("words"))
        return F.array(changed(a, a["words"] + step), changed(b, b["words"] - step))

    return let(moved, after)


def is_open(d: Column) -> Column:
    return (d["words"] > CLOSE * d["size"]) & (d["words"] < (1 - CLOSE) * d["size"])


def round_group(members: Column) -> Column:
    """``open``, at most one document, and ``done``, all others, of an array of open documents, the largest first.
    """
    nothing = F.slice(members, 1, 0)

    def meet(state: Column, d: Column) -> Column:
        pair = F.when(F.size(state["open"]) == 0, F.array(d)).otherwise(pivot(F.get(state["open"], 0), d))
        split = lambda p: F.struct(F.filter(p, is_open).alias("open"), F.concat(state["done"], F.filter(p, lambda x: ~is_open(x))).alias("done"))
        return let(pair, split)

    order = lambda x, y: F.when(x["size"] != y["size"], F.when(x["size"] > y["size"], -1).otherwise(1)).when(x["draw"] != y["draw"], F.when(x["draw"] < y["draw"], -1).otherwise(1)).otherwise(0)
    return F.aggregate(F.array_sort(members, order), F.struct(nothing.alias("open"), nothing.alias("done")), meet)


def round_source(rows: DataFrame, copies: Column, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Results of all rows but the last open document of each source, and a table of these.

    ``rows(key, doc_id, size, copy, source_size, target, n)`` gets ``copies`` of each document; ``n`` is how many rows the
    source has here, ``most`` the largest of these. Each level of the tree has a ``FAN_IN``-th of the rows of the one below.
    """
    rows = rows.withColumn("copies", copies).withColumn("base", F.floor("copies")).withColumn("words", (F.col("copies") - F.col("base")) * F.col("size"))
    document = F.struct("size", F.xxhash64("key", "doc_id", "size", "copy", F.lit(SEED)).alias("draw"), "doc_id", "words")
    where = ["key", "source_size", "target", "base"]
    rows = rows.select(*where, F.ceil(F.col("n") / FAN_IN).alias("groups"), document.alias("d"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("d.draw"), F.col("groups")))
    d = F.col("d")
    parts = [taken(rows.where(~is_open(d)), is_whole(d))]
    rows, groups = rows.where(is_open(d)), -(-most // FAN_IN)
    while groups:
        grouped = rows.groupBy(*where, "groups", "group").agg(F.collect_list("d").alias("members"))
        level = materialize(grouped.select(*where, "groups", "group", round_group(F.col("members")).alias("rounded")), "mix-level")
        parts.append(taken(level.select(*where, F.explode("rounded.done").alias("d")), is_whole(d)))
        rows = level.select(*where, F.ceil(F.col("groups") / FAN_IN).alias("groups"), F.expr(f"`group` div {FAN_IN}").alias("group"), F.explode("rounded.open").alias("d"))
        groups = 0 if groups == 1 else -(-groups // FAN_IN)
    return parts, rows


def is_whole(d: Column) -> Column:
    return (d["size"] > 0) & (d["words"] >= (1 - CLOSE) * d["size"])


def one_more(d: Column) -> Column:
    """Whether the last open document has a copy more: as probably as it is open."""
    return uniform(d["draw"]) * d["size"] < d["words"]


def taken(rows: DataFrame, more: Column) -> DataFrame:
    return rows.select("d.doc_id", "d.size", "source_size", "target", (F.col("d.size") * (F.col("base") + more.cast("int"))).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of ``docs(doc_id, text, source)``.

    ``size`` is the number of words, 0 for a null text; ``source_size`` and ``target`` are its source's; ``taken`` is
    a whole number of copies times the size, and never above ``MOST_COPIES`` copies. Which documents get one more is
    drawn from hashes of the source, the ids and the sizes alone, so reruns agree, however the rows are dealt out.
    Repeated rows are drawn for one by one; a null source is a source; a source without words has target 0; other
    columns are ignored; an empty table gives no rows.

    A pair's larger document is mostly the one that stays open, so the large documents of a source go first; what the
    last of them is rounded by is spread over the small ones, as a change of their number of copies, before these are
    rounded. So a source misses its target by a part of a small document, where it has as many words in small ones.
    Texts are read once; from then on a row is an id, a source and a size.
    """
    source = F.col("source").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.size(words(text_of().cast("string"))).cast("long").alias("size"))
    key = F.when(F.col("source").isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), F.col("source")))
    sizes = materialize(own.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumns({"key": key, "class": size_class()}), "mix-sizes")
    targets = materialize(source_targets(sizes), "mix-targets")
    n_rows = sizes.count()
    most_large, most_small = (n or 0 for n in targets.agg(F.max("n_large"), F.max("n_small")).first())
    one_by_one = sizes.select("key", "doc_id", "size", "class", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    large = look_up(one_by_one, targets, "key", n_rows).where("class > small_class").withColumn("n", F.col("n_large"))
    parts, last = round_source(large, F.col("copies"), most_large)
    last = materialize(last, "mix-last")
    parts.append(taken(last, one_more(F.col("d"))))
    # at most one row per source
    owed = last.select("key", (F.col("d.words") - F.when(one_more(F.col("d")), F.col("d.size")).otherwise(0)).alias("owed"))
    changed = F.col("copies") + F.coalesce("owed", F.lit(0.0)) / F.col("small_words")
    targets = materialize(targets.join(owed, "key", "left").withColumn("copies", F.when(F.col("small_words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(MOST_COPIES)), changed))).otherwise(0.0)), "mix-changed")
    small = look_up(one_by_one, targets, "key", n_rows).where("class <= small_class").withColumn("n", F.col("n_small"))
    others, last = round_source(small, F.col("copies"), most_small)
    parts += [*others, taken(last, one_more(F.col("d")))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
