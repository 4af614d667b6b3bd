"""The event log as Structured Streaming: translate raw payloads, merge tool calls, pair edits, deduplicate context.

Every stream has a batch form over the same rows in ``weftline.operators.events``; on a finished stream both agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftline.functions.text import preview, text_hash
from weftline.operators.events import merge_tool_calls, session_rollup
from weftline.operators.kept_state import KeptState

EVENT = "seq long, ts timestamp, session long, tool_use long, tool string, phase string, ms long, path long, added long"
PAYLOAD = "seq long, ts timestamp, session_id string, hook_event_name string, prompt string, tool_name string, tool_use_id string, source string, model string, cwd string, reason string, trigger string, tool_input string, tool_response string, duration_ms long"

# fixed values: the neutral name of each payload kind; other kinds are dropped
KINDS = {
    "SessionStart": "session_start",
    "UserPromptSubmit": "prompt",
    "PreToolUse": "tool_call_start",
    "PostToolUse": "tool_call_end",
    "PostToolUseFailure": "tool_call_end",
    "PreCompact": "compaction",
    "PostCompact": "compaction",
    "Stop": "turn_end",
    "SessionEnd": "session_end",
}


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of events from the Parquet files that appear at ``path``."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def translate(payloads: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """Neutral events of raw payloads (see PAYLOAD): unknown kinds, oversized inputs and rows without a session go.

    Prompts keep a hash of their text and a redacted preview only.
    """
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("hook_event_name")]
    rows = payloads.withColumn("type", kind).where("type is not null and session_id is not null")
    rows = rows.where(F.coalesce(F.octet_length("tool_input"), F.lit(0)) <= most_bytes)
    prompt = F.when(F.col("type") == "prompt", F.col("prompt"))
    outcome = F.when(F.col("hook_event_name") == "PostToolUse", "ok").when(F.col("hook_event_name") == "PostToolUseFailure", "failed")
    return rows.select(
        "seq", "ts", F.col("session_id").alias("session"), "type", F.col("tool_name").alias("tool"), F.col("tool_use_id").alias("tool_use"), "source", "model", "cwd", "reason", "trigger",
        text_hash(prompt).alias("text_hash"), preview(prompt).alias("text_preview"), outcome.alias("outcome"), F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0)).alias("duration_ms"),
    )


def merged_calls(events: DataFrame) -> DataFrame:
    """Tool calls from starts and ends in either order; for output mode update or complete. State holds every call that was:
    ``finished_calls`` holds open ones alone."""
    return merge_tool_calls(events)


CALL = "session long, tool_use long, ts timestamp, tool string, ended_at timestamp, duration_ms long, partial boolean"
HALVES = "first_seq long, ts timestamp, tool string, ended_at timestamp, last_seq long, duration_ms long, started boolean"


def finished_calls(events: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """Each tool call once, as ``merged_calls`` has it, as soon as both halves have come, in either order; what lacks one
    after ``ttl`` of event time is given without it. What is given is forgotten, so state holds open calls alone.

    For output mode append. A half that comes more than ``ttl`` behind the latest event is left out, as it may be one
    of a call that is given already; a third event of a call that is given begins it anew.
    """
    import pandas as pd

    def fold(key, frames, state):
        first_seq, ts, tool, ended_at, last_seq, ms, started = state.get if state.exists else (None, None, None, None, None, None, False)
        timed_out = state.hasTimedOut
        for frame in frames:
            for e in frame.sort_values("seq").itertuples(index=False):
                if first_seq is None or e.seq < first_seq:
                    first_seq, ts, tool = int(e.seq), e.ts, e.tool
                started = started or e.phase == "start"
                if e.phase == "end":
                    ended_at = e.ts if ended_at is None else max(ended_at, e.ts)
                    if not pd.isna(e.ms) and (last_seq is None or e.seq > last_seq):
                        last_seq, ms = int(e.seq), int(e.ms)
        if timed_out or (started and ended_at is not None):
            state.remove()
            row = pd.DataFrame([(*key, ts, tool, ended_at, ms, not started)], columns=[c.split()[0] for c in CALL.split(", ")])
            yield row.astype({"duration_ms": "Int64", "ended_at": "datetime64[ns]"})
        else:
            state.update((first_seq, ts, tool, ended_at, last_seq, ms, started))
            state.setTimeoutTimestamp(max(int(ts.timestamp() * 1000), state.getCurrentWatermarkMs()) + milliseconds)

    milliseconds = events.sparkSession.range(1).select(F.expr(f"cast(unix_micros(timestamp_micros(0) + interval {ttl}) / 1000 as long)")).first()[0]
    rows = events.select("seq", "ts", "session", "tool_use", "tool", "phase", "ms").withWatermark("ts", ttl)
    return rows.groupBy("session", "tool_use").applyInPandasWithState(fold, CALL, HALVES, "append", "EventTimeTimeout")


def ended_sessions(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """session, started_at, last_event_at, n_events, first_tool, last_tool of each stretch of a session without a pause of
    ``idle``, once such a pause is over: for output mode append, with state for the stretches that go on alone."""
    rows = events.withWatermark("ts", idle).groupBy("session", F.session_window("ts", idle).alias("stretch"))
    rows = rows.agg(F.min_by("ts", "seq").alias("started_at"), F.max("ts").alias("last_event_at"), F.count("*").alias("n_events"), F.min_by("tool", "seq").alias("first_tool"), F.max_by("tool", "seq").alias("last_tool"))
    return rows.drop("stretch")


def keep_state(events: DataFrame, state: KeptState, checkpoint: str) -> DataStreamWriter:
    """A writer that folds the stream into a kept state; a batch that is run again after a failure counts once."""
    return events.writeStream.foreachBatch(state.add).option("checkpointLocation", checkpoint)


def rolled_sessions(events: DataFrame) -> DataFrame:
    """Sessions so far; a stream can count distinct tools only by sketch, so that column is left out."""
    return session_rollup(events) if not events.isStreaming else events.groupBy("session").agg(
        F.min_by("ts", "seq").alias("started_at"), F.max("ts").alias("last_event_at"), F.count("*").alias("n_events"), F.min_by("tool", "seq").alias("first_tool"), F.max_by("tool", "seq").alias("last_tool")
    )


def paired_edits(events: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """Ends of edits with the start that came at most ``ttl`` before, by an interval join with watermarks; an end whose
    start hasn't come by then is given as partial with nothing added."""
    start = events.where("phase = 'start'").select(F.col("session").alias("s"), F.col("tool_use").alias("u"), F.col("ts").alias("start_ts"), F.col("added").alias("before")).withWatermark("start_ts", ttl)
    end = events.where("phase = 'end'").select("session", "tool_use", F.col("ts").alias("end_ts"), F.col("added").alias("after")).withWatermark("end_ts", ttl)
    near = (F.col("start_ts") <= F.col("end_ts")) & (F.col("start_ts") >= F.col("end_ts") - F.expr(f"interval {ttl}"))
    both = end.join(start, (F.col("session") == F.col("s")) & (F.col("tool_use") == F.col("u")) & near, "left_outer")
    return both.select("session", "tool_use", F.coalesce(F.greatest(F.col("after") - F.col("before"), F.lit(0)), F.lit(0)).alias("added"), F.col("start_ts").isNull().alias("partial"))


def first_mentions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event of each session and path: a file is explained once per session."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "path"])


def bursts(events: DataFrame, gap: str = "200 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """One row per burst of events that are less than ``gap`` apart."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"))
