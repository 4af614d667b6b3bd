"""The whole report of an experiment from one joint resampling of all its measures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.experiments import AT_ONCE, OCCURRENCES, draws
from weftline.session import materialize

PARTS = "task string, condition string, metric int, resample int, n double, total double"


@dataclass(frozen=True)
class Comparison:
    """A measure that is compared: its name in the rows, ``part`` (primary, guard or secondary), kind of effect (difference
    or log-ratio), wanted side (more or less; of a guard: not less, or not more, by ``margin``) and level."""

    metric: str
    part: str = "secondary"
    kind: str = "difference"
    side: str = "more"
    level: float = 0.95
    margin: float = 0.0
    per_task: bool = False


def joint_sums(runs: DataFrame, metrics: list[str], resamples: int, seed: int) -> DataFrame:
    """task, condition, metric (its place), resample, n and total: sums of the drawn runs, for all metrics at once.

    ``runs(run, task, condition, <metrics>)`` are read once; how often a run is in a resample is drawn once and holds for
    all its measures, null ones left out, so their effects are resampled jointly. A task of Spark sends sums alone. The
    resample -1 is the runs as they are.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, own in frame.groupby(["task", "condition"]):
                total = sums.setdefault(key, np.zeros((2, len(metrics), resamples + 1)))
                for at in range(0, len(own), 4096):
                    some = own.iloc[at : at + 4096]
                    run, values = some["run"].to_numpy(), some[metrics].to_numpy(float).T
                    known, values = (~np.isnan(values)).astype(float), np.nan_to_num(values)
                    total[0, :, 0] += known.sum(1)
                    total[1, :, 0] += values.sum(1)
                    for first in range(0, resamples, AT_ONCE):
                        last = min(resamples, first + AT_ONCE)
                        times = np.searchsorted(OCCURRENCES, draws(seed, np.arange(first, last), run), side="right").astype(float)
                        total[0, :, first + 1 : last + 1] += known @ times
                        total[1, :, first + 1 : last + 1] += values @ times
        for (task, condition), (n, total) in sums.items():
            for k in range(len(metrics)):
                size = resamples + 1
                yield pa.record_batch(
                    [pa.array([task] * size), pa.array([condition] * size), pa.array([k] * size, pa.int32()), pa.array(np.arange(-1, resamples), pa.int32()), pa.array(n[k]), pa.array(total[k])],
                    [c.split()[0] for c in PARTS.split(", ")],
                )

    rows = runs.select(F.col("run").cast("long"), F.col("task").cast("string"), F.col("condition").cast("string"), *(F.col(m).cast("double") for m in metrics))
    return rows.mapInArrow(partial, PARTS)


def joint_report(runs: DataFrame, comparisons: list[Comparison], resamples: int = 10_000, seed: int = 7, reasons: list[str] | None = None) -> DataFrame:
    """part, metric, task, kind, n_tasks, estimate, low, high, percent, supported of each comparison, and of its tasks.

    ``runs(run, task, condition, status, <metrics>)``, of which those count whose status is ok. An effect is the mean over
    the tasks that have the measure in both conditions at all; a resample that lacks one of these is left out. ``task`` is
    null in the row of all tasks. ``supported`` tells whether the interval lies wholly on the wanted side, of a guard
    whether it keeps the margin (non-inferiority). A primary comparison is supported only if every guard holds, and,
    as all of an exploratory report (``reasons`` name why), never there. A log ratio of means that aren't positive is null.
    """
    metrics, spark = [c.metric for c in comparisons], runs.sparkSession
    of = lambda name, value: F.sum(F.when(F.col("condition") == name, F.col(value)))
    sums = joint_sums(runs.where("status = 'ok'"), metrics, resamples, seed).groupBy("metric", "task", "resample")
    means = sums.agg(*(F.try_divide(of(c, "total"), of(c, "n")).alias(c) for c in ("baseline", "treatment")))
    named = spark.createDataFrame([(k, c.kind, (1 - c.level) / 2) for k, c in enumerate(comparisons)], "metric int, kind string, tail double")
    ratio = F.when((F.col("baseline") > 0) & (F.col("treatment") > 0), F.log(F.col("treatment") / F.col("baseline")))
    effect = F.when(F.col("kind") == "difference", F.col("treatment") - F.col("baseline")).otherwise(ratio)
    effects = materialize(means.where("baseline is not null and treatment is not null").join(F.broadcast(named), "metric").select("metric", "kind", "tail", "task", "resample", effect.alias("effect")), "effects")
    over = effects.groupBy("metric", "kind", "tail", "resample").agg(F.avg("effect").alias("effect"), F.count("effect").alias("n"), F.count("*").alias("n_tasks")).withColumn("task", F.lit(None).cast("string"))
    every = effects.select("metric", "kind", "tail", "resample", "effect", F.col("effect").isNotNull().cast("long").alias("n"), F.lit(1).cast("long").alias("n_tasks"), "task").where(F.col("metric").isin(*[k for k, c in enumerate(comparisons) if c.per_task]))
    both = over.select(every.columns).unionAll(every)
    whole = both.where("resample = -1").select("metric", "task", "n_tasks", F.when(F.col("n") == F.col("n_tasks"), F.col("effect")).alias("estimate"))
    drawn = both.where("resample >= 0").join(F.broadcast(whole.withColumnsRenamed({"metric": "m", "task": "t", "n_tasks": "all"})), (F.col("metric") == F.col("m")) & F.col("task").eqNullSafe(F.col("t"))).where("n = all and estimate is not null")
    found = drawn.groupBy("metric", "task", "tail").agg(F.sort_array(F.collect_list("effect")).alias("e"))  # as many as there are resamples
    place = lambda p: (F.size("e") - 1) * p
    at = lambda p: F.get("e", F.floor(place(p)).cast("int")) + (place(p) - F.floor(place(p))) * (F.get("e", F.ceil(place(p)).cast("int")) - F.get("e", F.floor(place(p)).cast("int")))
    found = found.select(F.col("metric").alias("m"), F.col("task").alias("t"), at(F.col("tail")).alias("low"), at(1 - F.col("tail")).alias("high"))
    rows = whole.join(found, (F.col("metric") == F.col("m")) & F.col("task").eqNullSafe(F.col("t")), "left").drop("m", "t")
    told = spark.createDataFrame([(k, c.part, c.metric, c.kind, c.side, float(c.margin)) for k, c in enumerate(comparisons)], "metric int, part string, name string, kind string, side string, margin double")
    rows = rows.join(F.broadcast(told), "metric")
    margin = F.when(F.col("part") == "guard", F.col("margin")).otherwise(0.0)
    holds = F.when(F.col("low").isNotNull(), F.when(F.col("side") == "more", F.col("low") > -margin).otherwise(F.col("high") < margin))
    rows = materialize(rows.select("part", F.col("name").alias("metric"), "task", "kind", "n_tasks", "estimate", "low", "high", F.when(F.col("kind") == "log-ratio", (F.exp("estimate") - 1) * 100).alias("percent"), holds.alias("holds")), "report")
    guards = [r["holds"] for r in rows.where("part = 'guard' and task is null").select("holds").collect()]  # one row per guard
    allowed = not reasons and all(g is True for g in guards) and len(guards) == sum(c.part == "guard" for c in comparisons)
    return rows.select("part", "metric", "task", "kind", "n_tasks", "estimate", "low", "high", "percent", F.when(F.col("part") == "primary", F.coalesce("holds", F.lit(False)) & F.lit(allowed)).otherwise(F.col("holds")).alias("supported"))


def exploratory_reasons(registered: dict | None, ran: dict) -> list[str]:
    """Why a report is exploratory: what of a registration (suite, trials, model, seed, ...) the run departs from."""
    if registered is None:
        return ["no registration"]
    return [f"{name} differs from the registration" for name in sorted(registered) if ran.get(name) != registered[name]]
