"""Running sums and ranks over all rows of a table, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize


def running_sum(values: DataFrame, keys: list[str], amount: str, into: str = "before") -> DataFrame:
    """The rows of ``values`` with the sum of ``amount`` over all rows that come before, by ``keys`` in ascending order.

    Rows are dealt out by ranges of the keys and written once; each range is summed in its own task and offset by the
    sums of the ranges before it, of which there are no more than partitions. Keys must not repeat, or equal ones are
    put in some order: sum up equal ones first, which also keeps a common key from filling a range. Nulls come first.
    """
    dealt = materialize(values.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    offsets = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    own = F.sum(amount).over(Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    summed = dealt.withColumn("__own", F.coalesce(own, F.lit(0))).join(F.broadcast(offsets), "__range")
    return summed.withColumn(into, F.col("__own") + F.col("__offset")).drop("__range", "__own", "__offset")


def percent_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``rank`` of each row: the share of the other rows with a lesser ``value``, as SQL's percent_rank.

    Equal values are counted before they are ranked, so a value that most rows have is one row of the running sum.
    A single row has rank 0; null values come before all others.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("__n"))
    ranked = running_sum(counts, [value], "__n")
    ranked = ranked.select(F.col(value).alias("__value"), (F.col("before") / F.lit(max(1, rows.count() - 1))).alias("rank"))
    return rows.join(ranked, F.col(value).eqNullSafe(F.col("__value"))).select(key, "rank")
