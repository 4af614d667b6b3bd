"""Every registered query with SQL against DuckDB on the same tables, and closures against plain search."""

from __future__ import annotations

import math
import random

import duckdb
import pytest

from weftline import catalog
from weftline.operators import fixpoint

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want and got


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("seed,depth", [(1, None), (2, 3), (3, None)])
def test_closure_equals_plain_search(spark, seed, depth):
    rng = random.Random(seed)
    edges = {(rng.randrange(25), rng.randrange(25)): rng.random() < 0.7 for _ in range(45)}
    deps = spark.createDataFrame([(a, b, e) for (a, b), e in edges.items()] + [(None, 1, True), (2, None, True)], "src int, dst int, exact boolean")
    targets = [0, 1, 2, 3, 99]
    got = {(r.target, r.id): r.exact for r in fixpoint.dependents(deps, spark.createDataFrame([(t,) for t in targets], "target int"), depth).collect()}
    want = {}
    for target in targets:
        for only_exact in (False, True):
            level, seen = {target}, set()
            hops = 0
            while level and (depth is None or hops < depth):
                level = {a for (a, b), e in edges.items() if b in level and (e or not only_exact) and a != target} - seen
                seen |= level
                hops += 1
            for node in seen:
                want[target, node] = only_exact or want.get((target, node), False)
    got = {k: v for k, v in got.items() if k[1] is not None}
    assert got == want
