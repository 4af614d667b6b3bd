"""Source trees of our own, with hand-derived answers: facts, import resolution, edges, coverage and incremental facts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.functions import facts as fx
from weftline.operators import fixpoint, graph, resolve
from weftline.sources import repository

TREE = {
    "package.json": '{"name": "shop", "main": "dist/index.js", "dependencies": {"left-pad": "1"}, "workspaces": ["packages/*"]}',
    "src/index.ts": 'export * from "./money";\nexport { Cart as Basket } from "./cart/index.js";\n',
    "src/money.ts": "export function format(n: number) { return `${n}`; }\nexport default class Money {}\nfunction hidden() {}\n",
    "src/cart/index.ts": 'import pad from "left-pad";\nimport { format as f } from "../money";\nexport class Cart { total() { return f(pad(1)); } }\n',
    "src/ui/page.tsx": 'import { Basket, format } from "..";\nimport * as fs from "node:fs";\nexport class Page extends Basket { show() { return format(2); } }\n',
    "src/cycle/a.ts": 'export * from "./b";\nexport const a = 1;\n',
    "src/cycle/b.ts": 'export * from "./a";\nexport const b = 2;\n',
    "src/late.js": "const { format } = require('./money');\nconst m = import(`./${x}`);\nmodule.exports = { run() { return format(3); } };\n",
    "src/uses.ts": 'import { b } from "./cycle/a";\nimport { gone } from "./missing";\nimport fmt from "shop-tools";\nexport const c = b;\nfmt();\n',
    "test/money.test.ts": 'import { format } from "../src/index";\nformat(1);\n',
    "packages/tools/package.json": '{"name": "shop-tools", "private": true, "exports": {".": "./dist/main.js"}}',
    "packages/tools/src/main.ts": "export default function fmt() {}\n",
    "node_modules/left-pad/index.js": "module.exports = 1;\n",
    "py/pyproject.toml": '[project]\nname = "Py_Shop"\ndependencies = ["requests>=2"]\n',
    "py/src/py_shop/__init__.py": "from .core import price as cost\nfrom . import core\n",
    "py/src/py_shop/core.py": "__all__ = ['price']\ndef price(n):\n    return n\nclass Base: ...\n",
    "py/src/py_shop/more.py": "import os, requests\nimport py_shop.core as k\nfrom py_shop import cost\nclass Sub(k.Base):\n    def m(self):\n        return cost(1)\n",
    "py/src/py_shop/stars.py": "from .core import *\nx = price(2)\n",
    "py/tests/test_core.py": "from py_shop.core import price\nprice(1)\n",
    "py/src/py_shop/broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def built(spark, tree):
    from weftline.session import materialize

    files = materialize(repository.scan(spark, str(tree)), "files")
    packages = materialize(repository.packages(files), "packages")
    facts = materialize(fx.extract(files), "facts")
    edges = materialize(graph.merge_edges(resolve.build_edges(facts, packages)), "edges")
    return files, packages, facts, edges


def test_scan_and_packages(built):
    files, packages, facts, _ = built
    rows = {r.path: r for r in files.collect()}
    assert set(rows) == {p for p in TREE if not p.startswith("node_modules")}
    assert rows["test/money.test.ts"].is_test and rows["py/tests/test_core.py"].is_test and not rows["src/money.ts"].is_test
    got = {r.path: (r.name, r.published, r.dependencies) for r in packages.collect()}
    assert got == {"": ("shop", True, ["left-pad"]), "packages/tools": ("shop-tools", False, []), "py": ("py-shop", True, ["requests"])}
    assert {r.path: r.facts.parseErrors for r in facts.collect() if r.facts.parseErrors} == {"py/src/py_shop/broken.py": 1}


def test_imports(built):
    _, packages, facts, _ = built
    got = {(r.src, r.specifier): (r.target, r.external_kind, r.declared) for r in resolve.resolve_imports(facts, packages).collect()}
    assert got["src/ui/page.tsx", ".."] == ("src/index.ts", None, None)
    assert got["src/index.ts", "./cart/index.js"] == ("src/cart/index.ts", None, None)
    assert got["src/cart/index.ts", "left-pad"] == (None, "third_party", True)
    assert got["src/ui/page.tsx", "node:fs"] == (None, "builtin", None)
    assert got["src/uses.ts", "./missing"] == (None, "unresolved", None)
    assert got["src/uses.ts", "shop-tools"] == ("packages/tools/src/main.ts", None, None)
    assert got["src/late.js", "./${x}"] == (None, "unresolved", None)
    assert got["py/src/py_shop/more.py", "requests"] == (None, "third_party", True)
    assert got["py/src/py_shop/more.py", "os"] == (None, "builtin", None)
    assert got["py/src/py_shop/more.py", "py_shop"] == ("py/src/py_shop/__init__.py", None, None)
    assert got["py/src/py_shop/more.py", "py_shop.core"] == ("py/src/py_shop/core.py", None, None)
    assert got["py/tests/test_core.py", "py_shop.core"] == ("py/src/py_shop/core.py", None, None)


def test_edges(built):
    edges = {(r.src, r.dst, r.kind) for r in built[3].collect()}
    for edge in [
        ("src/ui/page.tsx#Page", "src/cart/index.ts#Cart", "inherits"),
        ("src/ui/page.tsx#Page.show", "src/money.ts#format", "calls"),
        ("src/cart/index.ts#Cart.total", "src/money.ts#format", "calls"),
        ("src/index.ts", "src/money.ts", "imports"),
        ("src/index.ts", "src/money.ts#format", "references"),
        ("src/index.ts", "src/cart/index.ts#Cart", "references"),
        ("src/uses.ts#c", "src/cycle/b.ts#b", "references"),
        ("src/uses.ts", "packages/tools/src/main.ts#fmt", "calls"),
        ("test/money.test.ts", "src/money.ts#format", "tests"),
        ("src/cart/index.ts", "external:left-pad", "depends_on"),
        ("py/src/py_shop/more.py#Sub", "py/src/py_shop/core.py#Base", "inherits"),
        ("py/src/py_shop/more.py#Sub.m", "py/src/py_shop/core.py#price", "calls"),
        ("py/src/py_shop/stars.py", "py/src/py_shop/core.py#price", "calls"),
        ("py/src/py_shop/__init__.py", "py/src/py_shop/core.py", "imports"),
        ("py/tests/test_core.py", "py/src/py_shop/core.py#price", "tests"),
    ]:
        assert edge in edges, edge
    assert not any("hidden" in d for _, d, _ in edges)


def test_dependents_and_coverage(spark, built):
    files = resolve.file_edges(built[3])
    deps = graph.file_deps(files)
    target = spark.createDataFrame([("src/money.ts",)], "target string")
    got = {r.id for r in fixpoint.dependents(deps, target).collect()}
    assert got == {"src/index.ts", "src/cart/index.ts", "src/ui/page.tsx", "src/late.js"}
    assert {r.file for r in graph.covered_files(files).collect()} == {"src/money.ts", "src/index.ts", "py/src/py_shop/core.py"}


def test_published_api(built):
    _, packages, facts, _ = built
    got = {(r.module, r.symbol) for r in resolve.published_api(facts, packages).collect()}
    assert got == {("src/money.ts", "format"), ("src/cart/index.ts", "Cart"), ("py/src/py_shop/core.py", "price")}


def test_incremental_facts_equal_a_full_build(spark, built, tree, tmp_path):
    import shutil

    _, packages, facts, _ = built
    other = tmp_path / "tree"
    shutil.copytree(tree, other)
    (other / "src/money.ts").write_text(TREE["src/money.ts"].replace("format", "shape"))
    (other / "src/late.js").unlink()
    (other / "src/new.ts").write_text('import { shape } from "./money";\nshape(1);\n')
    (other / "src/cart/index.ts").write_text(TREE["src/cart/index.ts"] + "\n// a comment\n")
    files = repository.scan(spark, str(other))
    extracted = []

    def extract(changed):
        extracted.extend(r.path for r in changed.select("path").collect())
        return fx.extract(changed)

    fresh = resolve.refresh(facts, files.where("lang is not null"), extract)
    full = fx.extract(files)
    assert fresh.exceptAll(full).isEmpty() and full.exceptAll(fresh).isEmpty()
    assert sorted(extracted) == ["src/cart/index.ts", "src/money.ts", "src/new.ts"]
    edges = lambda f: {(r.src, r.dst, r.kind) for r in graph.merge_edges(resolve.build_edges(f, packages)).collect()}
    assert edges(fresh) == edges(full)
    before, after = ({r.path: r.surface for r in resolve.surfaces(f, resolve.resolve_imports(f, packages)).collect()} for f in (facts, fresh))
    assert {p for p in before if p in after and before[p] != after[p]} == {"src/money.ts"}
    current = files.where("lang is not null").select("path", "content_hash")
    assert graph.freshness(facts, current).first().asDict() == {"n_changed": 2, "n_added": 1, "n_deleted": 1}


def test_path_aliases(spark):
    configs = {
        "tsconfig.json": '{ "extends": "./base", "compilerOptions": { "paths": { "@app/*": ["src/*"], "@app/x/*": ["lib/*", "src/x/*"], "one": ["src/one.ts"], }, } }',
        "base.json": '{ // a comment\n "compilerOptions": { "baseUrl": ".", "paths": {"no": ["no"]} } }',
        "sub/tsconfig.json": '{"extends": "../tsconfig.json"}',
        "loop/tsconfig.json": '{"extends": "./tsconfig"}',
    }
    sources = {
        "src/a.ts": 'import "@app/b"; import "@app/x/c"; import "one"; import "src/b"; import "react"; import "./b"; import "no";',
        "src/b.ts": "", "src/x/c.ts": "", "src/one.ts": "", "sub/d.ts": 'import "@app/b";', "loop/e.ts": 'import "@app/b";',
    }
    rows = [(p, t, p, "typescript" if p.endswith(".ts") else None, False) for p, t in (configs | sources).items()]
    files = spark.createDataFrame(rows, "path string, content string, content_hash string, lang string, is_test boolean")
    aliases = resolve.path_aliases(files)
    assert {(r.folder, r.pattern): r.targets for r in aliases.collect()}["sub", "@app/*"] == ["src/*"]
    got = {(r.src, r.specifier): r.target for r in resolve.resolve_imports(fx.extract(files), repository.packages(files), aliases).collect()}
    assert got == {
        ("src/a.ts", "@app/b"): "src/b.ts", ("src/a.ts", "@app/x/c"): "src/x/c.ts", ("src/a.ts", "one"): "src/one.ts", ("src/a.ts", "src/b"): "src/b.ts",
        ("src/a.ts", "react"): None, ("src/a.ts", "./b"): "src/b.ts", ("src/a.ts", "no"): None, ("sub/d.ts", "@app/b"): "src/b.ts", ("loop/e.ts", "@app/b"): None,
    }


def test_path_functions(spark):
    rows = spark.createDataFrame([("a/./b/../c//d",), ("../x",), ("",), ("a/b/c.ts",)], "p string").select(resolve.normal_path(F.col("p")), resolve.folder(F.col("p")), resolve.ancestors(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["a/c/d", "x", "", "a/b/c.ts"] and rows[3][1] == "a/b" and [a.folder for a in rows[3][2]] == ["", "a", "a/b"]


def test_typescript_forms():
    f = fx.file_facts('export default async function () {}\nconst re = x / 2 / 3, s = "a//b";\nexport { re as r2 };\nclass A { static b = () => 1; c<T>(x: T) { return /[/]}/.test(x) } }\n`${`', "typescript")
    assert [(s["name"], s["subkind"], s["exportNames"]) for s in f["symbols"]] == [("default", "function", ["default"]), ("re", "variable", []), ("s", "variable", []), ("A", "class", []), ("A.c", "method", [])]
    assert f["localExports"] == [{"local": "re", "exported": "r2", "line": 3}]
    assert fx.file_facts("", "javascript") == fx.empty() and fx.file_facts("", "python") == fx.empty()


def _facts(spark, sources):
    rows = spark.createDataFrame(list(sources.items()), "path string, content string")
    files = rows.select("path", "content", F.sha2("content", 256).alias("content_hash"), repository.language(F.col("path")).alias("lang"), repository.is_test(F.col("path")).alias("is_test"))
    return files, fx.extract(files)


def test_bindings_that_lead_out_are_final_and_stars_go_in_order(spark):
    sources = {
        "a.ts": 'import { x } from "react";\nexport { x };\nexport * from "./b";\n',
        "b.ts": "export const x = 1;\nexport const free = 2;\n",
        "stars.ts": 'export * from "./one";\nexport * from "./two";\n',
        "one.ts": 'export * from "./deep";\n',
        "deep.ts": "export function y() {}\n",
        "two.ts": "export function y() {}\nexport function only() {}\n",
        "loop.ts": 'export * from "./loop2";\nexport * from "./two";\n',
        "loop2.ts": 'export * from "./loop";\n',
        "use.ts": 'import { x, free } from "./a";\nimport { y, only } from "./stars";\nimport { only as o2 } from "./loop";\nimport { nothing } from "./loop2";\nx(); free(); y(); only(); o2(); nothing();\n',
    }
    files, facts = _facts(spark, sources)
    edges = resolve.build_edges(facts, spark.createDataFrame([], "path string, name string, manifest string, published boolean, dependencies array<string>, entries array<string>"))
    got = {(r.src, r.dst) for r in edges.where("src = 'use.ts' and dst like '%#%'").collect()}
    assert got == {("use.ts", "b.ts#free"), ("use.ts", "deep.ts#y"), ("use.ts", "two.ts#only")}


def test_two_manifests_in_one_folder(spark):
    files, facts = _facts(spark, {"app/package.json": '{"name": "web", "dependencies": {"react": "1"}}', "app/pyproject.toml": '[project]\nname = "srv"\ndependencies = ["requests>=2"]\n', "app/setup.py": 'setup(name="old")', "app/x.py": "import requests\nimport flask\n", "app/y.ts": 'import "react";\n', "z.py": ""})
    packages = repository.packages(files)
    assert {(r.path, r.name, r.manifest) for r in packages.collect()} == {("app", "web", "package.json"), ("app", "srv", "pyproject.toml")}
    assert {(r.path, r.package) for r in repository.nearest_package(files.where("lang is not null"), packages).collect()} == {("app/x.py", "srv"), ("app/y.ts", "web"), ("app/setup.py", "srv")}
    declared = {(r.external, r.declared) for r in resolve.resolve_imports(facts, packages).where("external_kind = 'third_party'").collect()}
    assert declared == {("requests", True), ("flask", False), ("react", True)}


def test_long_chains_of_configs(spark):
    rows = [("c0/tsconfig.json", '{"extends": "./t1.json"}')] + [(f"c0/t{i}.json", f'{{"extends": "./t{i + 1}.json"}}') for i in range(1, 20)] + [("c0/t20.json", '{"compilerOptions": {"baseUrl": "./src"}, "extends": "./t3.json"}')]
    got = resolve.path_aliases(spark.createDataFrame(rows, "path string, content string")).collect()
    assert [(r.folder, r.targets) for r in got] == [("c0", ["c0/src"])]
