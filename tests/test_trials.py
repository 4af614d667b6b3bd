from __future__ import annotations

import json
import math

import pytest

from weftline.operators import context, trials
from weftline.sources import logs


def test_generator_and_schedule(spark):
    random = trials.Random(1)
    assert [round(random(), 6) for _ in range(3)] == [0.627074, 0.002736, 0.527447]
    assert sorted(trials.Random(5).shuffled(list(range(20)))) == list(range(20)) != trials.Random(5).shuffled(list(range(20)))
    rows = trials.schedule(spark, ["a", "b"], 3, 9).collect()
    assert {(r.task, r.trial) for r in rows} == {(t, k) for t in "ab" for k in range(3)} and [r.block for r in rows] == list(range(6))
    assert rows == trials.schedule(spark, ["a", "b"], 3, 9).collect() and {r.first for r in rows} <= set(trials.CONDITIONS)
    assert trials.plan(7, 20, 0.1)["runs"] == 280


def test_sequential_bootstrap():
    assert trials.sequential_bootstrap([([1.0] * 4, [3.0] * 4), ([2.0] * 3, [5.0] * 3)], "difference", 0.95, 1, 200) == (2.5, 2.5, 2.5)
    assert trials.sequential_bootstrap([([1.0], [])], "difference", 0.95, 1) is None
    assert trials.sequential_bootstrap([([0.0], [1.0])], "log-ratio", 0.95, 1) is None
    one, low, high = trials.sequential_bootstrap([([1, 2, 3, 4.0], [2, 4, 6, 8.0])], "log-ratio", 0.9, 3, 500)
    assert math.isclose(one, math.log(2)) and low < one < high
    assert trials.sequential_bootstrap([([1, 2, 3.0], [4, 5, 6.0])], "difference", 0.95, 7, 300) == trials.sequential_bootstrap([([1, 2, 3.0], [4, 5, 6.0])], "difference", 0.95, 7, 300)


def test_numbers_are_those_of_the_generator():
    for seed in (0, 1, 12345, 2**32 - 1):
        random = trials.Random(seed)
        assert [random() for _ in range(50)] == trials.numbers(seed, 50).tolist()


def test_sequential_bootstrap_equals_a_plain_loop():
    groups, seed, rounds = [([1.0, 2.0, 4.0], [3.0, 5.0]), ([2.0, 2.5], [4.0, 1.0, 7.0])], 11, 400
    random, values = trials.Random(seed), []
    for _ in range(rounds):
        effects = []
        for b, t in groups:
            mb, mt = (sum(v[int(random() * len(v))] for _ in v) / len(v) for v in (b, t))
            effects.append(mt - mb)
        values.append(sum(effects) / 2)
    values.sort()
    at = lambda q: values[int((rounds - 1) * q)] + (values[min(rounds - 1, int((rounds - 1) * q) + 1)] - values[int((rounds - 1) * q)]) * ((rounds - 1) * q % 1)
    got = trials.sequential_bootstrap(groups, "difference", 0.9, seed, rounds)
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[1:], (at(0.05), at(0.95)), strict=True))


def test_report(spark):
    rows = [("pass", t, i, c, "ok", float(c == "treatment")) for t in "ab" for i, c in enumerate(trials.CONDITIONS * 5)]
    rows += [("tokens", "a", i, c, "ok", 100.0 + i if c == "baseline" else 50.0 + i) for i, c in enumerate(trials.CONDITIONS * 6)] + [("tokens", "a", 99, "baseline", "error", 9e9)]
    runs = spark.createDataFrame(rows, "metric string, task string, run int, condition string, status string, value double")
    got = {r.metric: r for r in trials.report(runs, {"pass": ("difference", "more", 0.975), "tokens": ("log-ratio", "less", 0.975)}, 3).collect()}
    assert (got["pass"].estimate, got["pass"].low, got["pass"].supported) == (1.0, 1.0, True)
    assert got["tokens"].supported and -60 < got["tokens"].percent < -40
    assert trials.run_counts(runs).first().asDict() == {"n_runs": 33, "n_ok": 32, "n_invalid": 0, "n_error": 1, "n_missing": 0}


def test_grading(spark):
    kind = "array<struct<edge: string, test_failed: boolean, type_error: boolean>>"
    rows = [(1, "baseline", True, [("exact", True, None), ("none", True, False)], {"read": 2}), (2, "treatment", True, [("exact", False, False), ("none", True, None)], {"read": 1, "ask": 3}), (3, "treatment", False, [], {})]
    runs = spark.createDataFrame(rows, f"run int, condition string, accepted boolean, dependents {kind}, tool_calls map<string, int>")
    assert {r.run: (r.n_broken, r.controls_broken, r.passed) for r in trials.grade_edits(runs).collect()} == {1: (1, 1, False), 2: (0, 1, True), 3: (0, 0, False)}
    assert {(r.edge, r.condition): r.mean_broken for r in trials.broken_by_edge(runs).collect()}["exact", "baseline"] == 1.0
    assert {(r.condition, r.tool): r.per_run for r in trials.tool_calls_per_run(runs).collect()} == {("baseline", "read"): 2.0, ("treatment", "read"): 0.5, ("treatment", "ask"): 1.5}


def test_transcripts_and_logs(spark, tmp_path):
    usage = lambda n: {"input_tokens": n, "output_tokens": 1}
    call = {"type": "tool_use", "name": "read", "input": {"path": "secret.txt"}}
    said = lambda i, n, content=(): {"type": "assistant", "message": {"id": i, "usage": usage(n), "content": list(content)}}
    done = [{"type": "system", "subtype": "init", "model": "m"}, said("a", 5, [call]), {"type": "result", "subtype": "success", "is_error": False, "usage": usage(40), "num_turns": 3, "total_cost_usd": 0.5}]
    cut = [said("a", 5), said("a", 7, [call]), said("b", 10)]
    for name, events in (("done", done), ("cut", cut)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join([*map(json.dumps, events), "not json", ""]))
    events = logs.read_transcripts(spark, str(tmp_path / "*.jsonl"))
    got = {r.run: r for r in logs.transcript_summary(events).collect()}
    assert (got["done"].tokens, got["done"].finished, got["done"].turns, got["done"].model) == (41, True, 3, "m")
    assert (got["cut"].tokens, got["cut"].finished) == (19, False)
    assert {(r.run, r.tool, r.calls) for r in logs.transcript_tools(events).collect()} == {("done", "read", 1), ("cut", "read", 1)}
    assert {r.run for r in logs.touched(events, ["secret", "other"]).collect()} == {"done", "cut"}
    (tmp_path / "log").write_text("t\tx\ts1\tboom\nt\ty\ts1\tbang\nt\tz\n")
    assert [(r.session, r.n_failures) for r in logs.failures(spark, [str(tmp_path / "log")]).collect()] == [("s1", 2)]
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    assert logs.folder_hash(files).first() == logs.folder_hash(files.orderBy("content", ascending=False)).first() != logs.folder_hash(files.limit(1)).first()


def test_targets_and_context(spark):
    files = spark.createDataFrame([("a/x.ts",), ("b.py",)], "path string")
    symbols = spark.createDataFrame([("a/x.ts", "f"), ("a/x.ts", "C.f"), ("a/x.ts", "C.g"), ("b.py", "D.g"), ("b.py", "h")], "path string, name string")
    find = lambda spec: context.resolve_target(files, symbols, spec)
    assert find("./a//x.ts") == ("a/x.ts", None) and find("a/x.ts#f") == ("a/x.ts", "f") and find("a/x.ts#g") == ("a/x.ts", "C.g") and find("h") == ("b.py", "h")
    with pytest.raises(context.TargetError) as error:
        find("g")
    assert error.value.candidates == ["a/x.ts#C.g", "b.py#D.g"]
    for spec in ("nothing", "a/x.ts#zz", "H"):
        with pytest.raises(context.TargetError):
            find(spec)
    assert context.page(symbols, 3)[1] and not context.page(symbols, 5)[1]
    summary = spark.createDataFrame([("a/x.ts", 12, 30, 4, 2, True, False), ("b.py", 0, 0, 0, 0, False, False)], "target string, n_direct long, n_transitive long, n_covered long, n_packages long, published boolean, covered boolean")
    direct = spark.createDataFrame([("a/x.ts", f"src/{'long' * 20}/{i}.ts", i < 6) for i in range(12)], "target string, path string, tested boolean")
    note = {r.target: r.note for r in context.edit_context(summary, direct).collect()}
    assert set(note) == {"a/x.ts"} and len(note["a/x.ts"]) <= 800 and "6 without a test first" in note["a/x.ts"] and "more)" in note["a/x.ts"] and note["a/x.ts"].index("/6.ts") > 0
    packages, hubs = spark.createDataFrame([("p", 3)], "name string, n_files int"), spark.createDataFrame([("a/x.ts", 9)], "path string, n_dependents int")
    assert '"a/x.ts" (9)' in context.session_context(packages, hubs, 5, 1) and context.session_context(packages, hubs, 0, 0) is None
