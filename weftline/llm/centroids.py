"""Centroid clustering by Yinyang bounds.

The centroids are put into groups once. Every vector keeps an upper bound of the distance to its own centroid and one
lower bound per group of the distance to any other one there. After the centroids have moved, a vector whose upper
bound is below all lower bounds stays where it is without a distance being computed; otherwise only the groups whose
bound isn't above are looked at, and there only the centroids that the group's bound, less their own way, doesn't rule out.
Coordinates are whole numbers, so distances and means are exact and the bounds never decide a tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import discard, materialize

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Centroids of a group on average.
GROUP = 10
#: Coordinates up to here are computed in doubles, which hold squared distances exactly; larger ones as Python numbers.
EXACT = 1 << 22
#: What roots and sums of doubles may be wrong by, relative to them; bounds are widened by it.
SLACK = 1e-9
STATE = "vec_id long, x array<double>, cluster int, previous int, distance long, upper double, lower array<double>, scanned int"
LARGEST = (1 << 63) - 1


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the floors of ``SCALE`` times the components, of vectors with ``DIMENSIONS`` finite components."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float("inf")))
    # floor to a long would cut what is larger; a double of 2**52 or more has no fraction
    floor = lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)
    return rows.where((F.size("v") == DIMENSIONS) & finite).select("vec_id", F.transform("v", lambda c: floor(c * SCALE)).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The ``k`` vectors with the least sha-256 of ``2:<vec_id>``; all, if there are fewer. Those without an id come last."""
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "x").orderBy(F.asc_nulls_last("name"), "x").limit(k).collect()
    return whole(np.array([r.x for r in rows]).reshape(-1, DIMENSIONS))


def whole(values: np.ndarray) -> np.ndarray:
    """Whole numbers: 64 bits where all are small, otherwise Python's."""
    if values.dtype != object and (not values.size or np.abs(values).max() < EXACT):
        return values.astype(np.int64)
    return np.array([[int(c) for c in row] for row in values], object).reshape(values.shape)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each centroid, exact."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
        return np.array([[sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids] for row in x], object).reshape(len(x), len(centroids))
    a, b = x.astype(np.float64), centroids.astype(np.float64)
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def group_centroids(centroids: np.ndarray, n_groups: int | None = None) -> np.ndarray:
    """The group of each centroid: a few rounds of assignment to the means of groups, from evenly spaced ones."""
    k = len(centroids)
    n = n_groups or max(1, -(-k // GROUP))
    points = centroids.astype(np.float64)
    means = points[np.linspace(0, k - 1, n).astype(int)] if k else points
    group = np.zeros(k, np.int64)
    for _ in range(5 if k else 0):
        group = ((points[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([points[group == g].mean(0) if (group == g).any() else means[g] for g in range(n)])
    return group


class Step:
    """One assignment of vectors to ``centroids``, which have moved from ``before`` (None: the first one)."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None):
        self.centroids, self.group, self.first = centroids, group, before is None
        self.n_groups = int(group.max()) + 1 if len(group) else 0
        self.members = [np.flatnonzero(group == g) for g in range(self.n_groups)]
        moved = np.zeros(len(centroids)) if before is None else roots(np.array([((a - b) ** 2).sum() for a, b in zip(centroids, before, strict=True)]))
        self.moved = moved * (1 + SLACK)
        self.most_moved = np.array([self.moved[m].max() if len(m) else 0.0 for m in self.members])

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """cluster, upper, lower and the number of distances that were computed, of each row; ties go to the smaller number."""
        n, k = len(x), len(self.centroids)
        if self.first:
            rows, near, cluster = np.arange(n), np.zeros((n, k)), np.zeros(n, np.int64)
            scan, scanned = np.ones((n, k), bool), np.full(n, k)
        else:
            cluster, scanned = cluster.copy(), np.zeros(n, np.int64)
            upper, was = upper + self.moved[cluster], lower
            lower = lower - self.most_moved
            rows = np.flatnonzero(~(upper < lower.min(1)))
            # a tight upper bound first: it may be enough
            own = np.array([squared(x[i : i + 1], self.centroids[cluster[i] : cluster[i] + 1])[0, 0] for i in rows], object) if x.dtype == object else self.own(x[rows], cluster[rows])
            upper[rows], scanned[rows] = roots(own) * (1 + SLACK), 1
            rows = rows[~(upper[rows] < lower[rows].min(1))]
            near = was[rows][:, self.group] - self.moved[None]  # by the old bound no centroid is nearer than this
            open_groups = ~(upper[rows, None] < lower[rows])
            scan = open_groups[:, self.group] & ~(upper[rows, None] < near)
            scan[np.arange(len(rows)), cluster[rows]] = True
            scanned[rows] += scan.sum(1) - 1
        if not len(rows):
            return cluster, upper, lower, scanned
        exact = np.full((len(rows), k), np.inf, object if x.dtype == object or self.centroids.dtype == object else np.float64)
        for g, members in enumerate(self.members):
            for_group = np.flatnonzero(scan[:, members].any(1))
            if len(for_group):
                block = np.ix_(for_group, members)
                exact[block] = np.where(scan[block], squared(x[rows[for_group]], self.centroids[members]), np.inf)
        best = exact.argmin(1)
        at = np.arange(len(rows))
        distance = np.where(scan, roots(np.where(scan, exact, 0)) * (1 - SLACK), np.maximum(near, 0))
        upper = upper.copy()
        upper[rows] = roots(exact[at, best]) * (1 + SLACK)
        distance[at, best] = np.inf
        lower = lower.copy() if not self.first else np.zeros((n, self.n_groups))
        for g, members in enumerate(self.members):
            # the bound of a group that wasn't looked at holds as it is, but for the centroid that the vector has left
            lower[rows, g] = distance[:, members].min(1) if len(members) else np.inf
        cluster[rows] = best
        return cluster, upper, lower, scanned

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """The squared distance of each row to its own centroid."""
        if self.centroids.dtype == object:
            return np.array([squared(x[i : i + 1], self.centroids[c : c + 1])[0, 0] for i, c in enumerate(cluster)], object)
        apart = x.astype(np.float64) - self.centroids[cluster]
        return (apart * apart).sum(1)


def assign(vectors: DataFrame, step: Step) -> DataFrame:
    """``STATE`` of each vector after an assignment; ``previous`` is -1 in the first one."""
    bound = vectors.sparkSession.sparkContext.broadcast(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = bound.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id"), batch.column("x")
            points = whole(x.flatten().to_numpy().reshape(-1, DIMENSIONS))
            if step.first:
                before, upper, lower = np.full(len(ids), -1), np.zeros(len(ids)), np.zeros((len(ids), step.n_groups))
            else:
                before, upper = batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy()
                lower = batch.column("lower").flatten().to_numpy().reshape(len(ids), -1)
            cluster, upper, lower, scanned = step.assign(points, before, upper, lower)
            distance = [min(int(d), LARGEST) for d in (step.own(points, cluster) if points.dtype != object else [squared(points[i : i + 1], step.centroids[c : c + 1])[0, 0] for i, c in enumerate(cluster)])]
            columns = [ids, x, pa.array(cluster, pa.int32()), pa.array(before, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper), pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), lower.shape[1]).cast(pa.list_(pa.float64())), pa.array(scanned, pa.int32())]
            yield pa.record_batch(columns, [c.split()[0] for c in STATE.split(", ")])

    return vectors.mapInArrow(run, STATE)


def cluster_sums(state: DataFrame, k: int) -> tuple[list[int], list[list[int]]]:
    """By how much the last assignment changed each cluster's count and component sums.

    Only vectors that changed their cluster are read. A task sends one row per cluster and component that it has seen;
    what comes to the driver is one row for each of them, as many as the centroids have components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            points = whole(batch.column("x").flatten().to_numpy().reshape(-1, DIMENSIONS))
            for sign, name in ((1, "cluster"), (-1, "previous")):
                clusters = batch.column(name).to_numpy()
                for c in np.unique(clusters[clusters >= 0]):
                    mine = points[clusters == c]
                    for pos, s in enumerate((len(mine), *mine.sum(0))):
                        totals[int(c), pos] = totals.get((int(c), pos), 0) + sign * int(s)
        rows = [(c, p, str(s)) for (c, p), s in totals.items()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["cluster", "pos", "sum"])

    rows = state.where("cluster <> previous").select("x", "cluster", "previous").mapInArrow(run, "cluster int, pos int, sum string")
    counts, sums = [0] * k, [[0] * DIMENSIONS for _ in range(k)]
    plain = rows.groupBy("cluster", "pos").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    for c, pos, s in plain.collect():
        if pos:
            sums[c][pos - 1] = int(s)
        else:
            counts[c] = int(s)
    return counts, sums


def centroid_name(centroid: np.ndarray) -> str:
    return sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def cluster_vectors(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that is kept.

    Vectors are those with ``DIMENSIONS`` components, all finite (``SCALE`` times as large, too); other rows of ``embeddings(vec_id, embedding)`` are
    left out, as are other columns. Rows that repeat are vectors of their own; one without an id is clustered, but a
    centroid starts from it only if there are fewer than ``k`` others. An empty table gives no rows. Distances and
    sums of distances are exact, up to the largest long, where they stop.

    Every round is one pass that writes vectors and bounds into the shared folder; the table of the round before is
    removed then. The driver holds the centroids and their sums, ``k`` times ``DIMENSIONS`` numbers, whatever the input.
    """
    vectors = kept_vectors(embeddings)
    centroids = first_centroids(vectors, k)
    k = len(centroids)
    group, before, state = group_centroids(centroids), None, None
    counts, sums = [0] * k, [[0] * DIMENSIONS for _ in range(k)]
    for at in range(rounds + 1):
        last, state = state, materialize(assign(vectors if state is None else state, Step(centroids, group, before)), "clusters")
        if last is not None:
            discard(last)
        if at < rounds and k:
            more, by = cluster_sums(state, k)
            counts = [a + b for a, b in zip(counts, more, strict=True)]
            sums = [[a + b for a, b in zip(own, new, strict=True)] for own, new in zip(sums, by, strict=True)]
            means = [[s // n for s in own] if n else list(old) for n, own, old in zip(counts, sums, centroids, strict=True)]
            before, centroids = centroids, whole(np.array(means, object if max(map(abs, sum(means, []))) >= EXACT else np.float64))
    inertia = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), LARGEST)
    own = [(c, min(inertia[c], LARGEST), total, centroid_name(centroids[c])) for c in sorted(inertia)]
    of_cluster = state.sparkSession.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
