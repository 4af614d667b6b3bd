"""Streams against their batch forms on the same events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import events as batch
from weftline.sources import lens
from weftline.streaming import event_log

SF = "/root/testdata/sf0.001"


def drained(spark, stream, mode, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_merged_calls_and_sessions_equal_the_batch(spark, tmp_path):
    events = lens.tool_events(spark, SF).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in event_log.EVENT.split(", ")))
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = event_log.read_events(spark, str(tmp_path / "in"), 2)
    got = drained(spark, event_log.merged_calls(stream), "complete", tmp_path)
    want = batch.merge_tool_calls(events)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    sessions = drained(spark, event_log.rolled_sessions(stream), "complete", tmp_path)
    assert sessions.exceptAll(batch.session_rollup(events).drop("n_tools")).isEmpty()


def test_edits_pair_within_ten_minutes(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, 1, "start", 5), (2, "2024-01-01 00:05:00", 1, 1, "end", 9), (3, "2024-01-01 00:00:00", 1, 2, "start", 1),
            (4, "2024-01-01 00:20:00", 1, 2, "end", 8), (5, "2024-01-01 00:30:00", 1, 3, "end", 4), (6, "2024-01-02 00:00:00", 9, 9, "start", 0), (7, "2024-01-02 00:00:00", 9, 8, "end", 0)]
    events = spark.createDataFrame(rows, "seq long, t string, session long, tool_use long, phase string, added long")
    events = events.select("seq", F.to_timestamp("t").alias("ts"), "session", "tool_use", F.lit("edit").alias("tool"), "phase", F.lit(1).cast("long").alias("ms"), F.lit(1).cast("long").alias("path"), "added")
    events.where("seq < 6").write.parquet(str(tmp_path / "in"))
    events.where("seq > 5").write.mode("append").parquet(str(tmp_path / "in"))
    stream = event_log.read_events(spark, str(tmp_path / "in"), 1)
    got = {(r.session, r.tool_use): (r.added, r.partial) for r in drained(spark, event_log.paired_edits(stream), "append", tmp_path).collect()}
    want = {(r.session, r.tool_use): (r.added, r.partial) for r in batch.pair_edits(events).collect()}
    assert want == {(1, 1): (4, False), (1, 2): (0, True), (1, 3): (0, True), (9, 8): (0, True)}
    assert got.items() <= want.items() and got[1, 1] == (4, False)


def test_translate(spark):
    rows = [(1, "s", "UserPromptSubmit", "password = hunter22 and\n more", None), (2, "s", "Unknown", None, None), (3, None, "Stop", None, None), (4, "s", "PostToolUseFailure", None, "x" * 50), (5, "s", "Stop", None, None)]
    payloads = spark.createDataFrame(rows, "seq long, session_id string, hook_event_name string, prompt string, tool_input string")
    for column in event_log.PAYLOAD.split(", "):
        name, kind = column.split()
        if name not in payloads.columns:
            payloads = payloads.withColumn(name, F.lit(None).cast(kind))
    got = {r.seq: r for r in event_log.translate(payloads, most_bytes=20).collect()}
    assert set(got) == {1, 5} and got[1].type == "prompt" and "hunter22" not in got[1].text_preview and got[1].text_preview.startswith("password = [REDACTED]")
    assert {r.seq for r in event_log.translate(payloads).collect()} == {1, 4, 5}


def test_first_mentions_and_bursts(spark, tmp_path):
    rows = [(i, 1704067200.0 + t, 1, p) for i, (t, p) in enumerate([(0, 1), (0.1, 1), (0.15, 2), (5, 1), (5.1, 3), (100, 1)])]
    events = spark.createDataFrame(rows, "seq long, t double, session long, path long").select("seq", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "session", F.lit(1).cast("long").alias("tool_use"),
        F.lit("e").alias("tool"), F.lit("start").alias("phase"), F.lit(1).cast("long").alias("ms"), "path", F.lit(1).cast("long").alias("added"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = event_log.read_events(spark, str(tmp_path / "in"))
    assert {(r.session, r.path) for r in drained(spark, event_log.first_mentions(stream), "append", tmp_path).collect()} == {(1, 1), (1, 2), (1, 3)}
    assert sorted(r.n_events for r in event_log.bursts(events).collect()) == [1, 2, 3]
