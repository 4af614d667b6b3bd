"""Running sums and percent ranks against plain Python."""

from __future__ import annotations

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from weftline.operators.ranking import percent_ranks, running_sum
from weftline.session import discard, materialize


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_running_sum(spark, n):
    amounts = [random.Random(7).randrange(9) for _ in range(n)]
    rows = [(f"k{i:04d}", a) for i, a in enumerate(amounts)]
    random.Random(1).shuffle(rows)
    got = running_sum(spark.createDataFrame(rows, "k string, a long").repartition(5), ["k"], "a").orderBy("k").collect()
    assert [r.before for r in got] == [0, *accumulate(amounts)][:n]


@pytest.mark.parametrize("n", [1, 2, 500])
def test_percent_ranks(spark, n):
    values = [None if i % 50 == 49 else random.Random(i).choice([3, 3, 3, 3, i % 40]) for i in range(n)]
    got = {r.id: r.rank for r in percent_ranks(spark.createDataFrame(list(enumerate(values)), "id long, v long"), "id", "v").collect()}
    order = sorted(-1 if v is None else v for v in values)
    want = {i: order.index(-1 if v is None else v) / max(1, n - 1) for i, v in enumerate(values)}
    assert got == pytest.approx(want)


def test_a_common_value_is_one_row_of_the_sum(spark):
    rows = spark.range(10_000).select("id", F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("v"))
    assert percent_ranks(rows, "id", "v").count() == 10_000


def test_discard_removes_what_was_written(spark):
    import os

    table = materialize(spark.range(3), "gone")
    path = table._weftline_path.removeprefix("file:")
    assert os.path.isdir(path)
    discard(table)
    discard(table, spark.range(1))
    assert not os.path.exists(path)
