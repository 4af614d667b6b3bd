"""The audit of filters against every order applied in turn, and against its SQL."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from weftline.llm import filter_audit
from weftline.llm.oracles import ORACLES
from weftline.llm.queries import QUERIES

NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def plain(rows, labels):
    """(part, order, step) -> numbers, by applying the filters one after the other."""
    rows = [(d, t or "", p or "") for d, t, p in rows]
    good, toxic = ({d for d, *ls in labels if d is not None and ls[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    tests = {
        "A": lambda d, t: len(words(t)) < 200,
        "B": lambda d, t: 100 * len(set(words(t))) < 50 * len(words(t)),
        "C": lambda d, t: 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": lambda d, t: any(c in "#$%&*|" for c in t),
        "E": lambda d, t: d is not None and first[t] < d,
    }
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    failed = [{f for f in tests if tests[f](d, t)} for d, t, _ in rows]
    out, shapley = {}, defaultdict(Counter)
    for order in itertools.permutations("ABCDE"):
        left = defaultdict(list)
        for k, (_, _, p) in enumerate(rows):
            left[p].append(k)
        everything = {p: list(ks) for p, ks in left.items()}
        for step, f in enumerate(order, 1):
            for p, ks in left.items():
                gone = [k for k in ks if f in failed[k]]
                left[p] = [k for k in ks if f not in failed[k]]
                fails = [k for k in everything[p] if f in failed[k]]
                shapley[p][f] += len(gone)
                out[p, "".join(order), step] = (len(left[p]), len(gone), len(fails) - len(gone), sum(failed[k] == {f} for k in fails), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone))
    return {k: (*v, shapley[k[0]][k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*NUMBERS, "shapley")) for r in df.collect()}


def test_every_order_and_step_equals_applying_the_filters(spark, odd_rows, odd_docs, no_docs):
    long = prose(250, 9)
    more = [(20, long, "en"), (21, long, "de"), (19, long, "en"), (22, "A" * 30 + long, "en"), (23, long + " 5%", "en"), (24, "ka " * 300, "de"), (24, "ka " * 300, "de"), (25, "ka " * 300, None), (26, "ka " * 300, "")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True).withColumn("mask", F.lit("clash")).repartition(7)
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (20, None, 1), (21, 1, None), (24, 1, 1), (None, 1, 1), (999, 1, 1)]
    out = filter_audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain([r[:3] for r in odd_rows] + more, labels)
    got = found(out)
    assert got == want and out.count() == len(want) == 600 * len({p for p, _, _ in want})
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(no_docs, no_labels).count() == 0
    bare = found(filter_audit.audit_filters(docs, no_labels))
    assert all(v[4:6] == (0, 0) for v in bare.values()) and {k: v[:4] for k, v in bare.items()} == {k: v[:4] for k, v in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_the_walk_swaps_neighbours_and_visits_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for at in filter_audit.transpositions(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) and set(seen) == set(itertools.permutations(range(n)))


def test_the_walk_updates_two_steps_an_order():
    tour = filter_audit.Walk(np.random.default_rng(1).integers(0, 50, (3, 32)))
    assert len(tour.run()) == 600 and tour.updated == 5 + 2 * 119
    assert sum(tour.totals) == 120 * int(tour.cells[0, 1:].sum())


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = duck.execute(ORACLES["op11_filter_audit"])
    names = [d[0] for d in cursor.description]
    want = {tuple(r[names.index(c)] for c in ("part", "filter_order", "step")): tuple(r[names.index(c)] for c in (*NUMBERS, "shapley")) for r in cursor.fetchall()}
    assert found(QUERIES["op11_filter_audit"](spark, folder)) == want and len(want) == 2400
