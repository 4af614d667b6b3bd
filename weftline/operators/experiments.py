"""Experiment statistics: runs(run, task, condition, trial, status, metric) of a baseline and a treatment."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'ok' and metric is not null")


def task_effects(runs: DataFrame) -> DataFrame:
    """task, n_baseline, n_treatment, baseline, treatment, effect (difference of means) of tasks with both conditions."""
    of = lambda name: F.when(F.col("condition") == name, F.col("metric"))
    rows = usable(runs).groupBy("task").agg(
        F.count(of("baseline")).alias("n_baseline"), F.count(of("treatment")).alias("n_treatment"), F.avg(of("baseline")).alias("baseline"), F.avg(of("treatment")).alias("treatment")
    )
    return rows.where("n_baseline > 0 and n_treatment > 0").withColumn("effect", F.col("treatment") - F.col("baseline"))


def condition_means(runs: DataFrame) -> DataFrame:
    """condition, n, pooled_mean (over all runs, whatever their task) and n_tasks."""
    return usable(runs).groupBy("condition").agg(F.count("*").alias("n"), F.avg("metric").alias("pooled_mean"), F.count_distinct("task").alias("n_tasks"))


def paired(runs: DataFrame) -> DataFrame:
    """task, trial, baseline, treatment: the two runs of each block that has both."""
    of = lambda name: usable(runs).where(F.col("condition") == name).select("task", "trial", F.col("metric").alias(name))
    return of("baseline").join(of("treatment"), ["task", "trial"])


def log_ratio(runs: DataFrame) -> DataFrame:
    """n_tasks, effect (mean log ratio over tasks) and percent change; null if a mean isn't positive."""
    ratio = F.when((F.col("baseline") > 0) & (F.col("treatment") > 0), F.log(F.col("treatment") / F.col("baseline")))
    rows = task_effects(runs).select(ratio.alias("ratio"))
    all_there = F.count("ratio") == F.count("*")
    return rows.agg(F.count("*").alias("n_tasks"), F.when(all_there, F.avg("ratio")).alias("effect"), F.when(all_there, (F.exp(F.avg("ratio")) - 1) * 100).alias("percent"))


def draw(seed: int, *keys: Column) -> Column:
    """A number from 0 to 2**31 - 2 that depends on the keys alone, by integer arithmetic that any engine can repeat."""
    value = F.lit(seed).cast("long")
    for key in keys:
        value = ((value + key.cast("long") % 2147483647) * 48271 + 11) % 2147483647
        value = (value * 69621 + 7) % 2147483647
    return value


def draws(seed: int, resamples: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """What ``draw(seed, resample, run)`` gives, for all pairs of both."""
    modulus = 2147483647
    first = ((seed + resamples % modulus) * 48271 + 11) % modulus * 69621 + 7
    value = ((first % modulus)[None, :] + (runs % modulus)[:, None]) * 48271 + 11
    value %= modulus
    value *= 69621
    value += 7
    value %= modulus
    return value


#: Where the numbers of ``draw`` are cut for 0, 1, 2, ... occurrences of a run in a resample: a Poisson law of mean 1.
OCCURRENCES = tuple(int(2147483647 * sum(exp(-1) / factorial(k) for k in range(n + 1))) for n in range(9))
#: Resamples that a task draws at once.
AT_ONCE = 250


def resampled_means(runs: DataFrame, resamples: int, seed: int) -> DataFrame:
    """task, resample, baseline and treatment: the means of the runs drawn anew within each task and condition.

    How often a run is in a resample follows a Poisson law, given by a counter-based generator from the numbers of
    both alone. So no order of rows matters, no run is looked up or sent anywhere, and a task of Spark gives sums per
    resample for what it reads: what is shuffled doesn't grow with the runs. A condition without a run in a resample
    has no mean there.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, own in frame.groupby(["task", "condition"]):
                total = sums.setdefault(key, np.zeros((2, resamples)))
                for at in range(0, len(own), 4096):
                    run, metric = own["run"].to_numpy()[at : at + 4096], own["metric"].to_numpy()[at : at + 4096].astype(float)
                    for first in range(0, resamples, AT_ONCE):
                        last = min(resamples, first + AT_ONCE)
                        times = np.searchsorted(OCCURRENCES, draws(seed, np.arange(first, last), run), side="right").astype(float)
                        total[0, first:last] += times.sum(0)
                        total[1, first:last] += metric @ times
        for (task, condition), (n, total) in sums.items():
            yield pa.record_batch([pa.array([task] * resamples), pa.array([condition] * resamples), pa.array(np.arange(resamples)), pa.array(n), pa.array(total)], ["task", "condition", "resample", "n", "total"])

    rows = usable(runs).select(F.col("task").cast("string"), F.col("condition").cast("string"), F.col("run").cast("long"), F.col("metric").cast("double"))
    of = lambda name, value: F.sum(F.when(F.col("condition") == name, F.col(value)))
    parts = rows.mapInArrow(partial, "task string, condition string, resample long, n double, total double").groupBy("task", "resample")
    return parts.agg(*(F.try_divide(of(c, "total"), of(c, "n")).alias(c) for c in ("baseline", "treatment")))


def interval(column: str, level: float) -> list[Column]:
    tail = (1 - level) / 2
    return [F.percentile(column, tail).alias("low"), F.percentile(column, 1 - tail).alias("high")]


def bootstrap(runs: DataFrame, resamples: int = 10_000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """task, n, low and high: percentile interval of each task's effect over the resamples that have both conditions."""
    means = resampled_means(runs, resamples, seed).where("baseline is not null and treatment is not null")
    return means.select("task", (F.col("treatment") - F.col("baseline")).alias("effect")).groupBy("task").agg(F.count("*").alias("n"), *interval("effect", level))


def bootstrap_effect(runs: DataFrame, kind: str = "difference", resamples: int = 10_000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """estimate, low and high of the mean effect over tasks (a difference or a log-ratio): one row.

    All are null if a task lacks a condition, or for log ratios if a mean isn't positive; there is always a row.
    """
    ratio = F.when((F.col("baseline") > 0) & (F.col("treatment") > 0), F.log(F.col("treatment") / F.col("baseline")))
    effect = F.col("treatment") - F.col("baseline") if kind == "difference" else ratio
    mean = lambda name: F.avg(F.when(F.col("condition") == name, F.col("metric"))).alias(name)
    tasks = usable(runs).groupBy("task").agg(mean("baseline"), mean("treatment")).select(effect.alias("effect"))
    whole = lambda n: F.when((F.count("effect") == n) & (F.count("effect") > 0), F.avg("effect"))
    one = tasks.agg(whole(F.count("*")).alias("estimate"), F.count("*").alias("n_tasks"))
    drawn = resampled_means(runs, resamples, seed).select("resample", effect.alias("effect")).groupBy("resample").agg(F.avg("effect").alias("value"), F.count("effect").alias("n"))
    found = drawn.join(F.broadcast(one), F.col("n") == F.col("n_tasks")).agg(*interval("value", level))
    sure = F.col("estimate").isNotNull()  # both sides of the join are one row
    return one.join(F.broadcast(found), F.lit(True)).select("estimate", F.when(sure, F.col("low")).alias("low"), F.when(sure, F.col("high")).alias("high"))


def precision_recall(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """key, precision, recall of ``answers(key, item)`` against ``truth(key, item)``; an empty answer has precision 0."""
    given = answers.distinct().withColumn("given", F.lit(1))
    both = truth.distinct().withColumn("true", F.lit(1)).join(given, ["key", "item"], "full_outer")
    hit = F.count_if(F.col("given").isNotNull() & F.col("true").isNotNull())
    rows = both.groupBy("key").agg(hit.alias("hits"), F.count("given").alias("n_given"), F.count("true").alias("n_true"))
    share = lambda n: F.coalesce(F.try_divide(F.col("hits"), F.col(n)), F.lit(0.0))
    return rows.select("key", share("n_given").alias("precision"), share("n_true").alias("recall"))


#: Ranges of blocks that are summed apart; the sums of all of them are one small table.
RANGES = 200


def within_budget(blocks: DataFrame, cap: float) -> DataFrame:
    """Blocks(block, cost, ...) that run, in order, until what is spent reaches a cap: the one that crosses it still does.

    ``spent`` is what has been spent after the block. Ranges of blocks are summed apart and then offset by the sums of
    those before, so no task holds more than a range.
    """
    bounds = sorted(set(blocks.stat.approxQuantile("block", [k / RANGES for k in range(1, RANGES)], 1 / (4 * RANGES)))) if not blocks.isEmpty() else []
    part = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<double>"), lambda bound: bound < F.col("block")))
    rows = blocks.withColumn("part", part)
    sums = rows.groupBy("part").agg(F.sum("cost").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    own = F.sum("cost").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spent = rows.withColumn("own", own).join(F.broadcast(before), "part").withColumn("spent", F.col("own") + F.coalesce("before", F.lit(0)))
    return spent.where(F.col("spent") - F.col("cost") < cap).drop("part", "own", "before")


def remaining(schedule: DataFrame, done: DataFrame) -> DataFrame:
    """Schedule(task, trial, condition) without what has ended well; errors are run again."""
    return schedule.join(done.where("status = 'ok'"), ["task", "trial", "condition"], "left_anti")
