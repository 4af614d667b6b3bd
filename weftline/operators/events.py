"""The event log: sessions, tool calls, edits and hook calls folded from an append-only stream of events.

The order of arrival is ``seq``; what comes first or last is decided by it, not by the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(value: str, where: str | None = None) -> Column:
    """The value that arrived first, of rows that have one (and fulfil a condition)."""
    seen = F.col(value).isNotNull() if where is None else F.col(value).isNotNull() & F.expr(where)
    return F.min_by(F.when(seen, F.col(value)), F.when(seen, F.col("seq")))


def last_seen(value: str, where: str | None = None) -> Column:
    """The value that arrived last, of rows that have one (and fulfil a condition)."""
    seen = F.col(value).isNotNull() if where is None else F.col(value).isNotNull() & F.expr(where)
    return F.max_by(F.when(seen, F.col(value)), F.when(seen, F.col("seq")))


def session_rollup(events: DataFrame) -> DataFrame:
    """session, started_at, last_event_at, n_events, n_tools, first_tool, last_tool."""
    return events.groupBy("session").agg(
        first_seen("ts").alias("started_at"),
        F.max("ts").alias("last_event_at"),
        F.count("*").alias("n_events"),
        F.count_distinct("tool").alias("n_tools"),
        first_seen("tool").alias("first_tool"),
        last_seen("tool").alias("last_tool"),
    )


def merge_tool_calls(events: DataFrame) -> DataFrame:
    """One row per tool call from its start and end, whichever arrived first; a missing half leaves nulls."""
    return events.groupBy("session", "tool_use").agg(
        first_seen("ts").alias("ts"),
        first_seen("tool").alias("tool"),
        F.max(F.when(F.col("phase") == "end", F.col("ts"))).alias("ended_at"),
        last_seen("ms", "phase = 'end'").alias("duration_ms"),
        (F.count_if(F.col("phase") == "start") == 0).alias("partial"),
    )


def hook_percentiles(events: DataFrame) -> DataFrame:
    """tool, n_calls and the nearest-rank percentiles of the time taken."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ms)")
    return events.where("ms is not null").groupBy("tool").agg(F.count("*").alias("n_calls"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max("ms").alias("max_ms"))


def diffs_by_path(events: DataFrame) -> DataFrame:
    """session, path, added, removed, n_edits and whether some edit there lacks its start, of the ends of edits."""
    edits = pair_edits(events)
    return edits.groupBy("session", "path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("n_edits"), F.max("partial").alias("partial"))


def pair_edits(events: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """session, tool_use, path, added, removed, partial: ends of edits with the start that came at most ``ttl`` before.

    Those without one are partial and count no lines. Events may come without ``removed``, which is 0 then.
    """
    if "removed" not in events.columns:
        events = events.withColumn("removed", F.lit(0).cast("long"))
    start = events.where("phase = 'start'").select("session", "tool_use", F.col("ts").alias("start_ts"), F.col("added").alias("before"))
    end = events.where("phase = 'end'").select("session", "tool_use", "path", "removed", F.col("ts").alias("end_ts"), F.col("added").alias("after"))
    near = (F.col("start_ts") <= F.col("end_ts")) & (F.col("start_ts") >= F.col("end_ts") - F.expr(f"interval {ttl}"))
    both = end.join(start, (end["session"] == start["session"]) & (end["tool_use"] == start["tool_use"]) & near, "left")
    removed = F.when(F.col("start_ts").isNull(), 0).otherwise(F.col("removed")).cast("long").alias("removed")
    return both.select(end["session"], end["tool_use"], end["path"], removed, F.coalesce(F.greatest(F.col("after") - F.col("before"), F.lit(0)), F.lit(0)).alias("added"), F.col("start_ts").isNull().alias("partial"))


def prune(events: DataFrame, idle: str) -> DataFrame:
    """Events of the sessions whose last one is at most ``idle`` before the last of all."""
    last = events.groupBy("session").agg(F.max("ts").alias("last"))
    now = events.agg(F.max("ts").alias("now"))
    live = last.join(F.broadcast(now)).where(F.col("last") >= F.col("now") - F.expr(f"interval {idle}"))
    return events.join(live, "session", "left_semi")


def tool_tally(events: DataFrame) -> DataFrame:
    """session, by_tool: calls by tool name as a map, from the starts alone."""
    counts = events.where("phase = 'start'").groupBy("session", "tool").agg(F.count("*").alias("n"))
    return counts.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("by_tool"))


def session_report(events: DataFrame) -> DataFrame:
    """One row per session: rollup, merged calls and edits together; without calls or edits the counts are 0."""
    calls = merge_tool_calls(events).groupBy("session").agg(F.count("*").alias("n_calls"), F.count_if("partial").alias("n_partial"), F.sum("duration_ms").alias("total_ms"))
    edits = diffs_by_path(events).groupBy("session").agg(F.count("*").alias("n_paths"), F.sum("added").alias("added"))
    rollup = session_rollup(events).select("session", "n_events", "first_tool", "last_tool")
    return rollup.join(calls, "session", "left").join(edits, "session", "left").na.fill(0, ["n_calls", "n_partial", "total_ms", "n_paths", "added"])


def full_report(events: DataFrame, edits: DataFrame, hooks: DataFrame, most_prompts: int = 20) -> DataFrame:
    """Everything about each session: its state, calls by tool and by outcome, edits that count, and hooks.

    ``events`` as for ``session_states``, ``edits(session, tool_use, path, added, removed, partial)``,
    ``hooks(session, ms, sync, context_chars)``. Each part is folded by session on its own and joined by that alone; a
    session without calls, edits or hooks has zeros and empty maps. ``prompts`` are the numbers (``seq``) of the latest
    ``most_prompts`` prompts, in order. Percentiles are nearest ranks of the hooks that were waited for.
    """
    calls = tool_calls(events)
    by = lambda column: calls.groupBy("session", column).agg(F.count("*").alias("n")).groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}"))
    # the limit is applied in every task before the rows are dealt out
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))
    latest = events.where("type = 'prompt'").select("session", "seq").withColumn("place", place).where(F.col("place") <= most_prompts)
    prompts = latest.groupBy("session").agg(F.array_sort(F.collect_list("seq")).alias("prompts"))
    per_path = edits_that_count(edits, calls).groupBy("session", "path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("n"), F.max("partial").alias("partial"))
    changed = per_path.groupBy("session").agg(F.count("*").alias("n_paths"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("n").alias("n_edits"), F.count_if("partial").alias("n_partial_paths"))
    took = F.when(F.col("sync"), F.greatest(F.lit(0), F.round("ms")).cast("long"))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY took)")
    waited = hooks.withColumn("took", took).groupBy("session").agg(F.count("*").alias("n_hooks"), F.count_if("sync").alias("n_sync"), F.count_if(F.col("context_chars") > 0).alias("n_with_context"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max("took").alias("max_ms"))
    totals = calls.groupBy("session").agg(F.count("*").alias("n_calls"))
    out = session_states(events)
    for part in (totals, by("tool"), by("outcome"), prompts, changed, waited):
        out = out.join(part, "session", "left")
    numbers = ["n_calls", "n_paths", "added", "removed", "n_edits", "n_partial_paths", "n_hooks", "n_sync", "n_with_context"]
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,n:bigint>>"))
    out = out.na.fill(0, numbers).withColumns({c: F.coalesce(c, empty) for c in ("by_tool", "by_outcome")})
    return out.withColumn("prompts", F.coalesce("prompts", F.array().cast("array<bigint>")))


def session_states(events: DataFrame) -> DataFrame:
    """One row per session of ``events(session, seq, type, ts, cwd, source, model, git_head, reason)``.

    What a session began with is what arrived first, where it stands is what arrived last: ``source`` is the first
    start's, ``model`` and ``git_head`` are the latest that a start told, and an end counts only until the next start.
    """
    start, border = "type = 'session_start'", F.col("type").isin("session_start", "session_end")
    of = lambda kind: F.count_if(F.col("type") == kind)
    rows = events.groupBy("session").agg(
        first_seen("ts").alias("started_at"), F.max("ts").alias("last_event_at"), first_seen("cwd").alias("cwd"),
        first_seen("source", start).alias("source"), last_seen("model", start).alias("model"), last_seen("git_head", start).alias("git_head"),
        F.max_by(F.struct("type", "ts", "reason"), F.when(border, F.col("seq"))).alias("border"),
        of("turn_end").alias("n_turns"), of("compaction").alias("n_compactions"), of("prompt").alias("n_prompts"),
    )
    over = F.col("border.type") == "session_end"
    return rows.select("*", F.when(over, F.col("border.ts")).alias("ended_at"), F.when(over, F.col("border.reason")).alias("reason")).drop("border")


def tool_calls(events: DataFrame) -> DataFrame:
    """One row per call of ``events(session, tool_use, seq, type, ts, tool, args, outcome, ms)``, whichever half came first.

    Time and arguments are those that arrived first; an unknown outcome never replaces a known one.
    """
    ends = "type = 'tool_call_end'"
    rows = events.where("type in ('tool_call_start', 'tool_call_end')").groupBy("session", "tool_use")
    return rows.agg(
        first_seen("ts").alias("ts"), first_seen("tool").alias("tool"), first_seen("args").alias("args"),
        F.coalesce(last_seen("outcome", f"{ends} and outcome <> 'unknown'"), F.lit("unknown")).alias("outcome"),
        last_seen("ts", ends).alias("ended_at"), last_seen("ms", ends).alias("duration_ms"),
    )


def outcome_tally(calls: DataFrame) -> DataFrame:
    """session, outcome, n of merged calls."""
    return calls.groupBy("session", "outcome").agg(F.count("*").alias("n"))


def edits_that_count(edits: DataFrame, calls: DataFrame) -> DataFrame:
    """Edits(session, tool_use, ...) without those whose call failed or was denied: they changed nothing."""
    return edits.join(calls.where("outcome in ('failed', 'denied')"), ["session", "tool_use"], "left_anti")


def latest_session(sessions: DataFrame) -> DataFrame:
    """The session with the last event; of several the first by its key."""
    return sessions.orderBy(F.desc("last_event_at"), "session").limit(1)


def hook_stats(calls: DataFrame) -> DataFrame:
    """Per hook of ``calls(hook, ms, sync, context_chars, failed)``: counts and nearest-rank percentiles of the time."""
    took = F.greatest(F.lit(0), F.round("ms")).cast("long")
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY took)")
    rows = calls.withColumn("took", took).groupBy("hook")
    return rows.agg(
        F.count("*").alias("n"), F.count_if("sync").alias("n_sync"), F.count_if(F.col("context_chars") > 0).alias("n_with_context"), F.count_if("failed").alias("n_failed"),
        rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max("took").alias("max_ms"),
    )
