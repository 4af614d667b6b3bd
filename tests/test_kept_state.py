"""Kept states against one fold of all events, and streams whose state ends with what they are of."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import events as batch
from weftline.operators import kept_state as ks
from weftline.sources import lens
from weftline.streaming import event_log

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fold,whole", [(ks.TOOL_CALLS, batch.tool_calls), (ks.SESSIONS, batch.session_states)])
def test_batches_in_any_order_and_twice_equal_one_fold(spark, tmp_path, fold, whole):
    events = lens.session_events(spark, SF).withColumn("n", F.pmod(F.xxhash64("seq"), F.lit(5))).cache()
    state = ks.KeptState(spark, fold, str(tmp_path / "state"))
    for n in (3, 0, 4, 3, 1, 0, 2, 2):
        state.add(events.where(f"n = {n}").drop("n"), n)
    got, want = state.current(), whole(events.drop("n"))
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()
    assert state.batches() == [0, 1, 2, 3, 4]
    # a batch that comes again with other events replaces what it said
    state.add(events.where("n = 4 and seq % 2 = 0").drop("n"), 4)
    less = whole(events.where("n <> 4 or seq % 2 = 0").drop("n"))
    assert state.current().select(less.columns).exceptAll(less).isEmpty() and state.current().count() == less.count()
    events.unpersist()


def test_a_stream_into_a_kept_state(spark, tmp_path):
    columns = "seq long, ts timestamp, session long, type string, cwd string, source string, model string, git_head string, reason string, tool_use long, tool string, args string, outcome string, ms long"
    events = lens.session_events(spark, SF).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in columns.split(", ")))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    state = ks.KeptState(spark, ks.TOOL_CALLS, str(tmp_path / "state"))
    for run in range(2):  # the second run forgets its checkpoint and gives every batch again
        stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        event_log.keep_state(stream, state, str(tmp_path / f"checkpoint{run}")).trigger(availableNow=True).start().awaitTermination(120)
        want = batch.tool_calls(events)
        assert state.current().count() == want.count() and state.current().select(want.columns).exceptAll(want).isEmpty()


def test_calls_leave_the_state_when_they_are_given(spark, tmp_path):
    rng, rows, seq = random.Random(4), [], 0
    for call in range(60):
        at, halves = 600 * call, ["start", "end"] if call % 5 else [rng.choice(["start", "end"])]
        for k, phase in enumerate(halves if call % 3 else halves[::-1]):
            seq += 1
            rows.append((seq, 1_700_000_000 + at + 30 * k, call % 4, call, "edit", phase, 5 + k, 1, 2))
    rows.append((9999, 1_700_000_000 + 600 * 400, 99, 9999, "last", "start", 1, 1, 1))
    events = spark.createDataFrame(rows, "seq long, t long, session long, tool_use long, tool string, phase string, ms long, path long, added long").select("seq", F.timestamp_seconds("t").alias("ts"), "session", "tool_use", "tool", "phase", "ms", "path", "added")
    for k in range(6):
        events.where(f"seq between {k * 20} and {k * 20 + 19}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events.where("seq = 9999").write.mode("append").parquet(str(tmp_path / "in"))
    stream = event_log.finished_calls(event_log.read_events(spark, str(tmp_path / "in"), 1))
    query = stream.writeStream.format("memory").queryName("finished").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = spark.table("finished")
    want = batch.merge_tool_calls(events).where("session <> 99")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 12 and held[-1] <= 1


def test_sessions_end_after_a_pause(spark, tmp_path):
    rows = [(1, 0, 1), (2, 60, 1), (3, 10_000, 1), (4, 30, 2), (5, 90_000, 3)]
    events = spark.createDataFrame(rows, "seq long, t long, session long").select("seq", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts"), "session", F.lit(1).cast("long").alias("tool_use"), F.concat(F.lit("t"), "seq").alias("tool"),
        F.lit("start").alias("phase"), F.lit(1).cast("long").alias("ms"), F.lit(1).cast("long").alias("path"), F.lit(1).cast("long").alias("added"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = event_log.ended_sessions(event_log.read_events(spark, str(tmp_path / "in"), 1))
    query = stream.writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.session, r.n_events, r.first_tool, r.last_tool) for r in spark.table("ended").collect()) == [(1, 1, "t3", "t3"), (1, 2, "t1", "t2"), (2, 1, "t4", "t4")]


def test_sessions_without_calls_or_edits_are_reported(spark):
    events = spark.createDataFrame([(1, 1, 7, 1, "edit", "start", 3, 1, 2), (2, 2, 7, 1, "edit", "end", 3, 1, 5), (3, 3, 8, 2, "read", "start", None, None, None)], "seq long, t long, session long, tool_use long, tool string, phase string, ms long, path long, added long")
    got = {r.session: (r.n_events, r.n_calls, r.n_paths, r.added, r.total_ms) for r in batch.session_report(events.withColumn("ts", F.timestamp_seconds("t"))).collect()}
    assert got == {7: (2, 1, 1, 3, 3), 8: (1, 1, 0, 0, 0)}
