"""A build that is brought up to date edit by edit equals a full one after each, and resolves only what it has to."""

from __future__ import annotations

import pytest

from weftline.functions import facts as fx
from weftline.operators import graph, resolve
from weftline.operators.fixpoint import reachable
from weftline.session import materialize
from weftline.sources import repository, source_lens

START = {
    "package.json": '{"name": "shop", "main": "src/index.ts"}',
    "src/index.ts": 'export * from "./money";\nexport { Cart as Basket } from "./cart";\nexport * as units from "./units";\n',
    "src/money.ts": "export function format(n) { return n; }\nexport function round(n) { return n; }\n",
    "src/cart.ts": 'import { round } from "./money";\nexport class Cart { total() { return round(1); } }\n',
    "src/units.ts": "export const kilo = 1000;\n",
    "src/page.ts": 'import { Basket, format, units } from "./index";\nexport class Page extends Basket { show() { return format(units.kilo); } }\n',
    "src/other.ts": "export const other = 1;\n",
    "src/far.ts": 'import { other } from "./other";\nexport const far = other;\n',
    "test/page.test.ts": 'import { Page } from "../src/page";\nnew Page();\n',
    "py/pyproject.toml": '[project]\nname = "app"\n',
    "py/app/__init__.py": "from .core import price\n",
    "py/app/core.py": "def price(n):\n    return n\n",
    "py/app/stars.py": "from .core import *\nx = price(2)\n",
    "py/app/use.py": "from app import price\nfrom app import extra\ndef run():\n    extra.more()\n    return price(1)\n",
}
#: name, what is written (None: deleted), and the files that are resolved again.
EDITS = [
    ("an export gets another name", {"src/money.ts": "export function shape(n) { return n; }\nexport function round(n) { return n; }\n"}, {"src/money.ts", "src/cart.ts", "src/index.ts", "src/page.ts"}),
    ("behind a namespace of the barrel", {"src/units.ts": "export const mega = 1e6;\n"}, {"src/units.ts", "src/index.ts", "src/page.ts"}),
    ("the barrel drops a module", {"src/index.ts": 'export { Cart as Basket } from "./cart";\n'}, {"src/index.ts", "src/page.ts"}),
    ("a file that was missed is added", {"py/app/extra.py": "def more():\n    pass\n"}, {"py/app/extra.py", "py/app/use.py"}),
    ("a name moves through stars", {"py/app/core.py": "def cost(n):\n    return n\n"}, {"py/app/core.py", "py/app/__init__.py", "py/app/stars.py", "py/app/use.py"}),
    ("a file with users is deleted", {"src/other.ts": None}, {"src/far.ts"}),
    ("a module of a package is deleted", {"py/app/extra.py": None}, {"py/app/use.py"}),
]


def read(spark, tree):
    files = materialize(source_lens.files(spark.createDataFrame(sorted(tree.items()), "path string, content string")), "files")
    return materialize(fx.extract(files), "facts"), materialize(repository.packages(files), "packages")


def rows(edges):
    return sorted(tuple(r) for r in graph.merge_edges(edges).select("src", "dst", "kind", "exact", "lines").collect())


def test_each_edit_gives_what_a_full_build_gives(spark):
    tree = dict(START)
    facts, packages = read(spark, tree)
    kept = resolve.build(facts, packages)
    assert {r.path for r in kept.resolved.collect()} == {p for p in tree if p.endswith((".ts", ".py"))}
    for name, written, again in EDITS:
        tree = {p: c for p, c in (tree | written).items() if c is not None}
        facts, packages = read(spark, tree)
        kept = resolve.rebuild(kept, facts, packages)
        full = resolve.build(facts, packages)
        assert rows(kept.edges) == rows(full.edges), name
        assert sorted(map(str, kept.imports.collect())) == sorted(map(str, full.imports.select(kept.imports.columns).collect())), name
        got = {r.path for r in kept.resolved.collect()}
        assert again <= got <= again | {"py/app/__init__.py", "py/app/use.py", "py/app/stars.py"}, (name, got)


def test_surfaces_leave_out_lines_bodies_and_imports_that_are_not_passed_on(spark):
    def told(text):
        facts, packages = read(spark, START | {"src/cart.ts": text})
        return {r.path: r.surface for r in resolve.surfaces(facts, resolve.resolve_imports(facts, packages)).collect()}["src/cart.ts"]

    first = told(START["src/cart.ts"])
    assert first == told("// one\n// two\n" + START["src/cart.ts"].replace("round(1)", "2")) == told('import "./other";\n' + START["src/cart.ts"])
    assert first != told(START["src/cart.ts"] + "export const more = 1;\n") and first != told(START["src/cart.ts"] + 'export * from "./other";\n')


@pytest.mark.parametrize("n", [0, 5, 40])
def test_reachable_follows_long_chains_and_cycles(spark, n):
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(n)] + [("a3", "a0"), (None, "x"), ("x", None), ("y", "z")]
    got = {r.id for r in reachable(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("a0",), (None,)], "id string")).collect()}
    assert got == {f"a{i}" for i in range(n + 1)}
