"""Strong components against Tarjan's, and policies against plain matching."""

from __future__ import annotations

import fnmatch
import random

import pytest
from weftline.operators import components, policies


def plain_components(edges):
    nodes = {x for e in edges for x in e}
    ahead = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not ahead[b] <= ahead[a]:
                ahead[a] |= ahead[b]
                changed = True
    return {n: min(m for m in nodes if m in ahead[n] and n in ahead[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_equal_mutual_reach(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(100 + i, 101 + i) for i in range(12)} | {(112, 104), (200, 201), (201, 200), (300, 300)}
    want = plain_components({e for e in edges if e[0] != e[1]})
    rows = spark.createDataFrame([(a, b, (a + b) % 3 > 0) for a, b in edges] + [(None, 1, True), (2, None, True)], "src long, dst long, exact boolean")
    found = components.strong_components(rows)
    got = [(r.id, r.component) for r in found.collect()]
    assert dict(got) == want and len(got) == len(want)
    between = {(want[a], want[b]) for a, b in edges if a != b and want[a] != want[b]}
    assert {(r.src, r.dst) for r in components.condensed(rows, found).collect()} == between
    cycles = {r.component: (r.n_files, r.n_deps) for r in components.cycles(rows).collect()}
    assert cycles == {c: (sum(v == c for v in want.values()), sum(want[a] == want[b] == c for a, b in edges if a != b)) for c in set(want.values()) if list(want.values()).count(c) > 1}


def test_no_edges(spark):
    assert components.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


RULES = [("own", "src/**", "record_only"), ("billing", "src/billing/**", "ask_human"), ("tests", "**/*.test.ts", "tell_agent"), ("one", "src/billing/invoice.ts", "block"), ("odd", "src/a[!x]/?.ts", "tell_agent"), ("top", "*.md", "record_only")]
PATHS = ["src/a.ts", "src/billing/x/y.ts", "src/billing/invoice.ts", "src/billing/invoice.test.ts", "lib/q.test.ts", "q.test.ts", "src/ab/c.ts", "src/ax/c.ts", "README.md", "docs/x.md", "other"]


def test_the_strongest_rule_decides(spark):
    rules = spark.createDataFrame(RULES, "rule string, pattern string, on_match string")
    got = {r.path: (r.on_match, r.matched) for r in policies.decide(spark.createDataFrame([(p,) for p in PATHS], "path string"), rules).collect()}
    fits = {"own": lambda p: p.startswith("src/"), "billing": lambda p: p.startswith("src/billing/"), "tests": lambda p: p.endswith(".test.ts"), "one": lambda p: p == "src/billing/invoice.ts",
            "odd": lambda p: fnmatch.fnmatchcase(p, "src/a[!x]/?.ts"), "top": lambda p: p.endswith(".md") and "/" not in p}
    want = {}
    for p in PATHS:
        if matched := sorted((n for n, _, _ in RULES if fits[n](p))):
            want[p] = (max((a for n, _, a in RULES if n in matched), key=policies.ACTIONS.index), matched)
    assert got == want


def test_architecture_rules(spark):
    files = [(p,) for p in ("web/a.ts", "web/b.ts", "db/index.ts", "db/inner.ts", "api/c.ts", "lib/d.ts")]
    deps = [("web/a.ts", "db/inner.ts", True), ("web/a.ts", "web/b.ts", True), ("web/b.ts", "api/c.ts", False), ("api/c.ts", "db/index.ts", True), ("api/c.ts", "db/inner.ts", False), ("db/index.ts", "db/inner.ts", True), ("api/c.ts", "lib/d.ts", True)]
    rules = [("no-web-to-db", "forbid", "web/**", "db/**", "block"), ("web-uses-lib", "allow_only", "web/**", "lib/**", "block"), ("db-entry", "entrypoint_only", "db/**", "db/index.ts", "block")]
    out = policies.violations(spark.createDataFrame(deps, "src string, dst string, exact boolean"), spark.createDataFrame(files, "path string"), spark.createDataFrame(rules, "rule string, kind string, from_pattern string, to_pattern string, on_match string"))
    assert sorted(map(tuple, out.collect())) == [
        ("db-entry", "api/c.ts", "db/inner.ts", "ask_human"), ("db-entry", "web/a.ts", "db/inner.ts", "block"), ("no-web-to-db", "web/a.ts", "db/inner.ts", "block"),
        ("web-uses-lib", "web/a.ts", "db/inner.ts", "block"), ("web-uses-lib", "web/b.ts", "api/c.ts", "ask_human"),
    ]
    uses = spark.createDataFrame([("web/a.ts", "react"), ("db/inner.ts", "react"), ("web/b.ts", "pg")], "path string, external string")
    banned = spark.createDataFrame([("no-pg", "web/**", "pg"), ("no-react", "db/**", "react")], "rule string, pattern string, external string")
    assert sorted(map(tuple, policies.forbidden_externals(uses, banned).collect())) == [("no-pg", "web/b.ts", "pg"), ("no-react", "db/inner.ts", "react")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
