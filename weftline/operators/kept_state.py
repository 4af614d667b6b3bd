"""Events folded into a state that is kept between batches, where a batch may be given again.

What a batch says of a key is a partial state: for each column the value that arrived first or last, with its place, a
count or a greatest value. Partial states merge in any order to what one fold of all events gives. Each batch has its
own partition of the kept table, which is overwritten when the batch comes again, so a batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A column of the state: ``how`` is first, last (of the values by ``seq``), greatest or count; ``value`` an expression,
    of the events for which ``where`` holds; null values don't count."""

    how: str
    value: str
    where: str = "true"

    def partial(self) -> Column:
        found = F.when(F.expr(self.where) & F.expr(self.value).isNotNull(), F.expr(self.value))
        placed = F.when(found.isNotNull(), F.struct(F.col("seq"), found.alias("value")))
        return {"first": F.min(placed), "last": F.max(placed), "greatest": F.max(found), "count": F.count(found)}[self.how]

    def merged(self, name: str) -> Column:
        return {"first": F.min(name), "last": F.max(name), "greatest": F.max(name), "count": F.sum(name)}[self.how]

    def finished(self, name: str) -> Column:
        return F.col(name)["value"] if self.how in ("first", "last") else F.col(name)


@dataclass(frozen=True)
class Fold:
    """Keys, columns and the rows that a state is of; ``finish`` makes the result of the merged columns."""

    keys: tuple[str, ...]
    parts: dict[str, Part]
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows
    where: str = "true"

    def partial(self, events: DataFrame) -> DataFrame:
        return events.where(self.where).groupBy(*self.keys).agg(*(p.partial().alias(name) for name, p in self.parts.items()))

    def merge(self, partials: DataFrame) -> DataFrame:
        merged = partials.groupBy(*self.keys).agg(*(p.merged(name).alias(name) for name, p in self.parts.items()))
        return self.finish(merged.select(*self.keys, *(p.finished(name).alias(name) for name, p in self.parts.items())))


class KeptState:
    """A fold that is kept at ``path``, one partition per batch, by Spark's own saves."""

    def __init__(self, spark: SparkSession, fold: Fold, path: str):
        self.spark, self.fold, self.path = spark, fold, path

    def add(self, events: DataFrame, batch_id: int) -> None:
        """Fold a batch in; given again, with the same or with corrected events, it replaces what it said before.

        The signature is that of ``foreachBatch``. A batch without events leaves what an earlier one of its number said.
        """
        rows = self.fold.partial(events).withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def current(self) -> DataFrame:
        """What one fold of the events of all batches gives."""
        return self.fold.merge(self.spark.read.parquet(self.path).drop("batch"))

    def batches(self) -> list[int]:
        return sorted(r["batch"] for r in self.spark.read.parquet(self.path).select("batch").distinct().collect())


ENDS = "type = 'tool_call_end'"
#: As ``events.tool_calls``.
TOOL_CALLS = Fold(
    ("session", "tool_use"),
    {
        "ts": Part("first", "ts"), "tool": Part("first", "tool"), "args": Part("first", "args"), "outcome": Part("last", "outcome", f"{ENDS} and outcome <> 'unknown'"),
        "ended_at": Part("last", "ts", ENDS), "duration_ms": Part("last", "ms", ENDS),
    },
    lambda rows: rows.withColumn("outcome", F.coalesce("outcome", F.lit("unknown"))),
    "type in ('tool_call_start', 'tool_call_end')",
)

START, BORDER = "type = 'session_start'", "type in ('session_start', 'session_end')"


def _ended(rows: DataFrame) -> DataFrame:
    over = F.col("border.type") == "session_end"
    return rows.select("*", F.when(over, F.col("border.ts")).alias("ended_at"), F.when(over, F.col("border.reason")).alias("reason")).drop("border")


#: As ``events.session_states``.
SESSIONS = Fold(
    ("session",),
    {
        "started_at": Part("first", "ts"), "last_event_at": Part("greatest", "ts"), "cwd": Part("first", "cwd"), "source": Part("first", "source", START), "model": Part("last", "model", START),
        "git_head": Part("last", "git_head", START), "border": Part("last", "struct(type, ts, reason)", BORDER), "n_turns": Part("count", "1", "type = 'turn_end'"),
        "n_compactions": Part("count", "1", "type = 'compaction'"), "n_prompts": Part("count", "1", "type = 'prompt'"),
    },
    _ended,
)
