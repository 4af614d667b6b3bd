"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import discard, materialize

#: Keys with fewer rows are never hot; hot ones are so many at most, as the limit rises with the rows.
LEAST_HOT, MOST_HOT = 256, 2000


def look_up(rows: DataFrame, values: DataFrame, key: str, n_rows: int) -> DataFrame:
    """An inner join of ``rows`` with ``values(key, n, ...)``, where ``n`` is how many of the rows have the key.

    Keys with more rows than ``n_rows / MOST_HOT`` are fewer than ``MOST_HOT``, so their values are broadcast and
    their rows stay where they are; all others are shuffled. ``n`` isn't part of the result.
    """
    hot = F.col("n") > max(LEAST_HOT, n_rows // MOST_HOT)
    few, rest = F.broadcast(values.where(hot).drop("n")), values.where(~hot).drop("n")
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def star_state(links: DataFrame) -> tuple[int, int]:
    """The number of ``links(u, v)``, and of nodes that keep them from being stars: with two links to others, or one to
    another and one from another."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if(F.expr("ups > 1 or ups = 1 and least = 0"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of each node of ``edges(a, b)``, two long columns without nulls.

    Alternates large-star and small-star steps until the edges are a star around each least node. Every step is an
    aggregation with partial sums and a look-up that leaves the edges of hot nodes, as a star's centre is one, in
    their tasks. What a look-up reads is written to the shared folder before: it reads its inputs several times, so
    the driver would else hold plans that grow fivefold with each step; and lost executors cost no more than a step.
    Nodes without edges to others come back as their own components; an empty table gives none.
    """
    edges = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        n, astray = star_state(links)
        if not astray:
            break
        # large star: what is above a node goes to its least neighbour
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        above = materialize(look_up(both, least, "u", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "above")
        discard(links, least)
        # small star: a node and what is below it go to the least of these
        least = materialize(above.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        below = look_up(above, least, "u", 2 * n).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e")).select("e.u", F.col("e.m").alias("v"))
        links = materialize(below.where("u <> v").distinct(), "links")
        discard(above, least)
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
