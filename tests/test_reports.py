"""Long logs in splits, hashes of folders in any order, and the joint report."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import experiments, reports
from weftline.sources import logs


def test_a_log_of_many_splits_is_numbered_as_one(spark, tmp_path):
    rng, want = random.Random(1), {}
    for name in ("a", "b"):
        lines = []
        for i in range(400):
            kind = rng.random()
            lines.append("" if kind < 0.05 else "{broken" if kind < 0.1 else json.dumps({"type": "assistant", "message": {"id": f"m{i // 3}", "usage": {"input_tokens": i, "output_tokens": 1}, "content": [{"type": "tool_use", "name": "t", "input": "x" * rng.randrange(200)}]}}))
        want[name] = lines
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        got = {(r.run, r.at): r.line for r in logs.numbered_lines(spark, str(tmp_path)).collect()}
        summary = sorted(map(tuple, logs.transcript_summary(logs.read_transcripts(spark, str(tmp_path))).select("run", "tokens").collect()))
        odd = {(r.run, r.at) for r in logs.malformed_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == {(n, i): line for n, lines in want.items() for i, line in enumerate(lines)}
    assert odd == {(n, i) for n, lines in want.items() for i, line in enumerate(lines) if line == "{broken"}
    last = {n: {} for n in want}
    for n, lines in want.items():
        for line in lines:
            if line.startswith('{"'):
                e = json.loads(line)
                last[n][e["message"]["id"]] = e["message"]["usage"]["input_tokens"] + 1
    assert summary == [(n, sum(last[n].values())) for n in sorted(last)]


@pytest.mark.parametrize("n", [0, 3, 1500])
def test_folder_hash_is_the_same_for_any_partitions(spark, n, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK", 16)
    rows = [(f"d{i % 7}/f{i}", f"text {i}") for i in range(n)]
    frame = lambda rows, k: spark.createDataFrame(rows, "path string, content string").repartition(k)
    first = logs.folder_hash(frame(rows, 1)).first()["hash"]
    assert first == logs.folder_hash(frame(rows[::-1], 7)).first()["hash"]
    if n:
        assert first != logs.folder_hash(frame([*rows[:-1], (rows[-1][0], "other")], 3)).first()["hash"] != logs.folder_hash(frame(rows[1:], 3)).first()["hash"]


def runs_of(spark, rows):
    return spark.createDataFrame(rows, "run long, task string, condition string, status string, tokens double, recall double")


def test_report_equals_single_comparisons_and_guards_decide(spark):
    rng = random.Random(3)
    rows = [(i, f"t{i % 3}", ("baseline", "treatment")[i // 3 % 2], "ok" if i % 17 else "error", float(rng.randrange(50, 60) - 20 * (i // 3 % 2)), float(rng.randrange(80, 90)) if i % 5 else None) for i in range(240)]
    runs = runs_of(spark, rows)
    wanted = [reports.Comparison("tokens", "primary", "log-ratio", "less", per_task=True), reports.Comparison("recall", "guard", margin=5.0)]
    out = {(r.metric, r.task): r for r in reports.joint_report(runs, wanted, 400, 5).collect()}
    assert set(out) == {("tokens", None), ("recall", None), *(("tokens", f"t{k}") for k in range(3))}
    for metric, kind in (("tokens", "log-ratio"), ("recall", "difference")):
        alone = experiments.bootstrap_effect(runs.withColumn("metric", F.col(metric)), kind, 400, 0.95, 5).first()
        one = out[metric, None]
        assert (one.estimate, one.low, one.high) == pytest.approx((alone.estimate, alone.low, alone.high))
    assert out["tokens", None].supported and out["recall", None].supported and out["tokens", None].percent < -20
    strict = [wanted[0], reports.Comparison("recall", "guard", margin=0.0)]
    assert not {r.metric: r for r in reports.joint_report(runs, strict, 100, 5).where("task is null").collect()}["tokens"].supported
    assert not reports.joint_report(runs, wanted, 100, 5, ["no registration"]).where("metric = 'tokens' and task is null").first().supported
    none = reports.joint_report(runs.withColumn("tokens", F.lit(None).cast("double")), wanted, 50, 5)
    assert none.where("metric = 'tokens'").count() == 0 and none.where("metric = 'recall'").count() == 1


def test_departures_from_a_registration():
    assert reports.exploratory_reasons(None, {}) == ["no registration"]
    assert reports.exploratory_reasons({"seed": 1, "trials": 5}, {"seed": 1, "trials": 4}) == ["trials differs from the registration"]
