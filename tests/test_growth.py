"""How work grows: what a task holds, and how many rows the steps of a query make."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import facts as fx
from weftline.operators import components, fixpoint, resolve
from weftline.sources import repository, source_lens


def test_facts_are_held_a_piece_at_a_time():
    assert list(fx.pieces([5, 5, 5, 30, 1], 10)) == [(0, 2), (2, 1), (3, 1), (4, 1)]
    assert list(fx.pieces([], 10)) == [] and list(fx.pieces([1] * 6, 100)) == [(0, 6)]


def test_the_shortest_span_holds_a_line():
    assert fx._holders([(1, 9, "Whole"), (2, 3, "Whole.b"), (2, 3, "Whole.a"), (9, 9, "last")]) == {**dict.fromkeys(range(1, 9), "Whole"), 2: "Whole.a", 3: "Whole.a", 9: "last"}


def names_asked(spark, monkeypatch, n):
    """The published names of a package whose index has ``n`` stars, and the rows of all steps that their resolution made."""
    tree = {"package.json": '{"name": "shop", "main": "src/index.ts"}', "src/index.ts": "".join(f'export * from "./p{k}";\n' for k in range(n))}
    tree |= {f"src/p{k}.ts": f"export class C{k} {{}}\nexport function f{k}() {{}}\n" for k in range(n)}
    files = source_lens.files(spark.createDataFrame(list(tree.items()), "path string, content string"))
    made, write = [], resolve.materialize
    monkeypatch.setattr(resolve, "materialize", lambda df, name: made.append((name, out := write(df, name))) or out)
    got = {tuple(r) for r in resolve.published_api(fx.extract(files), repository.packages(files)).collect()}
    return got, sum(t.count() for name, t in made if name == "steps")


def test_names_are_not_asked_of_every_star(spark, monkeypatch):
    got, rows = names_asked(spark, monkeypatch, 12)
    assert got == {(f"src/p{k}.ts", f"{c}{k}") for k in range(12) for c in "Cf"}
    assert rows <= 2 * 24, "each of the 24 names has one star that knows it; every name at every star would be 288"


def test_files_are_tried_for_the_bases_that_mean_them(spark):
    paths = ["a/b.ts", "a/b.d.ts", "a/b.tsx", "a/b/index.ts", "a/b.js", "a/b/index.d.ts", "index.ts", "a.mts", "a/b.mjs", "c/index.jsx", "x.txt"]
    bases = ["a/b", "a/b.js", "a/b.jsx", "a/b.ts", "a/b/index", "a", "", "a.mjs", "c", "x.txt", "a/b.mjs"]
    want = {b: [p for p in spark.createDataFrame([(b,)], "b string").select(resolve.probes(F.col("b")).alias("p")).first().p if p in paths] for b in bases}
    rows = resolve.tried(spark.createDataFrame([(p,) for p in paths], "target string")).where("way = 'script'").orderBy("base", "step").collect()
    got = {b: list(dict.fromkeys(r.target for r in rows if r.base == b)) for b in bases}
    assert got == {b: list(dict.fromkeys(p)) for b, p in want.items()} and any(len(p) > 2 for p in want.values())


@pytest.mark.parametrize("small_part", [1000, 6])
def test_parts_of_a_graph_are_walked_apart(spark, monkeypatch, small_part):
    """Random graphs beside each other with cycles, ends and chains between numbers; parts over the limit go by rounds."""
    monkeypatch.setattr(fixpoint, "MANY", 1)
    monkeypatch.setattr(fixpoint, "SMALL_PART", small_part)
    rng = random.Random(5)
    edges = {(100 * k + rng.randrange(12), 100 * k + rng.randrange(12)): rng.random() < 0.7 for k in range(6) for _ in range((4, 20)[k % 2])}
    edges |= {(900, 903): True, (901, 903): True, (901, 905): False, (904, 905): True}
    seen = {n: {n} for e in edges for n in e}
    for a, b in [*edges] * 20:
        seen[a] |= seen[b]
        seen[b] |= seen[a]
    rows = spark.createDataFrame([(a, b, e) for (a, b), e in edges.items()] + [(None, 1, True), (2, None, True)], "src long, dst long, exact boolean")
    got = {r.id: r.part for r in fixpoint.parts(rows.where("src is not null and dst is not null")).collect()}
    assert got == {n: min(s) for n, s in seen.items()}
    targets = sorted(seen)
    found = {(r.target, r.id): r.exact for r in fixpoint.dependents(rows, spark.createDataFrame([(t,) for t in targets], "target long")).collect()}
    want = {}
    for target in targets:
        for only_exact in (False, True):
            level, known = {target}, set()
            while level:
                level = {a for (a, b), e in edges.items() if b in level and (e or not only_exact) and a != target} - known
                known |= level
            want |= {(target, n): only_exact for n in known}
    assert found == want and len(want) > 100


def test_targets_of_one_part_share_rows(spark, monkeypatch):
    """Ten stars of 20 with all their points as targets: a few rows a node, not one for each target."""
    monkeypatch.setattr(fixpoint, "MANY", 1)
    edges = [(1000 * k + i + 1, 1000 * k + i, True) for k in range(10) for i in range(20)]
    deps = spark.createDataFrame(edges, "src long, dst long, exact boolean")
    reach = fixpoint.reach(deps, fixpoint.direct(deps, deps.select(F.col("dst").alias("target"))))
    assert reach.pairs().count() == 10 * 210 and reach.bits.count() <= 2 * 200


def test_cycles_beside_each_other_are_found_at_once(spark, monkeypatch):
    calls, reach = [], components.reachable
    monkeypatch.setattr(components, "reachable", lambda *a: calls.append(1) or reach(*a))
    edges = [(10 * k + a, 10 * k + b) for k in range(8) for a, b in ((1, 2), (2, 3), (3, 1), (3, 5), (5, 6), (6, 5))]
    found = {r.component: (r.n_files, r.n_deps) for r in components.cycles(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {10 * k + 1: (3, 3) for k in range(8)} | {10 * k + 5: (2, 2) for k in range(8)}
    assert len(calls) <= 4, "two rounds, not one for each of the eight graphs"
