"""Centroid clustering against plain Lloyd rounds in whole numbers, and against its SQL."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroids
from weftline.llm.oracles import ORACLES
from weftline.llm.queries import QUERIES

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain(rows, k=40, rounds=5):
    ok = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted((("0" + hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "1"), x) for i, x in ok)
    middles = [x for _, x in start[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), c) for c, m in enumerate(middles)) for _, x in ok]
        if r < rounds:
            for c in range(len(middles)):
                if own := [x for (_, x), (_, b) in zip(ok, near, strict=True) if b == c]:
                    middles[c] = tuple(sum(xs) // len(own) for xs in zip(*own, strict=True))
    of = Counter()
    for d, c in near:
        of[c] += d
    cut = lambda d: min(d, centroids.LARGEST)
    return Counter((i, c, cut(d), cut(of[c]), cut(sum(of.values())), hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(ok, near, strict=True))


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("clash"), "x": F.lit(1), "lower": F.lit(None)})


def clustered(n, seed, spread=0.05):
    rng = random.Random(seed)
    hearts = [[rng.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(9)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(hearts)]) for i in range(n)]


@pytest.mark.parametrize("n,seed", [(1, 1), (39, 2), (400, 3)])
def test_equals_plain_rounds(spark, n, seed):
    rows = clustered(n, seed)
    assert found(centroids.cluster_vectors(frame(spark, rows).repartition(5))) == plain(rows)


def test_ties_repeated_rows_and_rows_that_are_left_out(spark):
    zero, one = [0.0] * 64, [1.0] * 64
    rows = [(i, [float(i % 3)] * 64) for i in range(90)] + [(5, zero), (5, zero), (5, one), (None, one), (None, zero)]
    rows += [(200, None), (201, []), (202, [0.1] * 63), (203, [0.1] * 65), (204, [0.1] * 63 + [None]), (205, [float("nan")] * 64), (206, [0.1] * 63 + [float("inf")])]
    assert found(centroids.cluster_vectors(frame(spark, rows))) == plain(rows)
    assert centroids.cluster_vectors(frame(spark, [])).count() == 0
    assert centroids.cluster_vectors(frame(spark, rows[-7:])).count() == 0


def test_large_components_are_exact(spark):
    rows = clustered(60, 4) + [(100, [3e5] * 64), (101, [3e5] * 63 + [3.001e5]), (102, [-7e30] * 64), (103, [1e9 + 0.3] * 64)]
    assert found(centroids.cluster_vectors(frame(spark, rows))) == plain(rows)


def test_bounds_spare_most_distances_and_never_decide(spark):
    rng = np.random.default_rng(5)
    hearts = rng.integers(-150, 150, (60, 64))
    x = (hearts[rng.integers(0, 60, 3000)] + rng.integers(-9, 10, (3000, 64))).astype(np.int64)
    middles = x[:40].copy()
    group, before, scanned = centroids.group_centroids(middles), None, []
    cluster, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros((len(x), 4))
    for _ in range(8):
        step = centroids.Step(middles, group, before)
        cluster, upper, lower, n = step.assign(x, cluster, upper, lower)
        scanned.append(n.sum() / (len(x) * 40))
        apart = ((x[:, None] - middles[None]) ** 2).sum(2)
        assert (cluster == apart.argmin(1)).all()
        others = apart.astype(float)
        others[np.arange(len(x)), cluster] = np.inf
        assert (upper**2 >= apart[np.arange(len(x)), cluster] * (1 - 1e-12)).all()
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= np.sqrt(others[:, group == g].min(1)) + 1e-6).all()
        before, middles = middles, np.array([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else middles[c] for c in range(40)])
    assert scanned[0] == 1 and scanned[-1] < 0.1 and sum(scanned[1:]) < 0.5 * (len(scanned) - 1)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    cursor = duck.execute(ORACLES["op13_centroid_clustering"])
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall())
    assert found(QUERIES["op13_centroid_clustering"](spark, folder)) == want and want.total() == 500
