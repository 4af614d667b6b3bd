"""Listings of trees: all files, whatever their names, and what ignore files leave out."""

from __future__ import annotations

import os
import shutil
import subprocess

import pytest

from weftline.sources import listing, repository

TREE = {
    "__tests__/a.test.ts": "", "pkg/__tests__/b.ts": "", "__mocks__/m.ts": "", "_lib/x.ts": "", ".storybook/main.ts": "", ".eslintrc.js": "", "src/a.ts": "", "node_modules/x/index.js": "", "src/dist/no.ts": "",
    ".gitignore": "*.log\n/gen\n!gen/keep.ts\nbuilt/\n# a comment\n\\#odd\ndocs/**/draft\nsp ace\\ \n*.t[mx]p\n", "gen/keep.ts": "", "sub/gen/x.ts": "", "a.log": "", "sub/b.log": "", "sub/.gitignore": "!b.log\n/c.ts\n", "sub/c.ts": "", "sub/sub/c.ts": "",
    "built": "", "x/built/y.ts": "", "docs/draft": "", "docs/a/b/draft": "", "#odd": "", "q.tmp": "", "q.txp": "", "q.txt": "", "x/y/z/deep.py": "",
}


def test_listing_equals_git(spark, tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    os.symlink(tmp_path, tmp_path / "loop")
    got = {r.path for r in listing.list_tree(spark, str(tmp_path), repository.IGNORED).collect()}
    assert {"__tests__/a.test.ts", "pkg/__tests__/b.ts", "__mocks__/m.ts", "_lib/x.ts", ".storybook/main.ts", ".eslintrc.js", "sub/b.log", "built", "q.txt"} <= got
    assert not got & {"node_modules/x/index.js", "src/dist/no.ts", "gen/keep.ts", "a.log", "sub/c.ts", "x/built/y.ts", "docs/draft", "docs/a/b/draft", "#odd", "q.tmp", "q.txp"}
    if shutil.which("git"):
        subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
        listed = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-z", "--others", "--exclude-standard"], capture_output=True, check=True).stdout.decode().split("\0")
        own = {p for p in listed if p and not set(p.split("/")[:-1]) & set(repository.IGNORED)} - {"loop"}
        assert got - {"loop"} == own
    everything = {r.path for r in listing.list_tree(spark, str(tmp_path), repository.IGNORED, follow_rules=False).collect()}
    assert everything - {"loop"} == {p for p in TREE if not set(p.split("/")[:-1]) & set(repository.IGNORED)}


def test_scan_reads_what_is_listed(spark, tmp_path):
    listing.write_tree(spark.createDataFrame([("a/_b.py", "x = 1\n"), ("a/.c/d.ts", "é"), ("e", "")], "path string, content string"), str(tmp_path / "tree"))
    got = {r.path: (r.content, r.lang) for r in repository.scan(spark, str(tmp_path / "tree")).collect()}
    assert got == {"a/_b.py": ("x = 1\n", "python"), "a/.c/d.ts": ("é", "typescript"), "e": ("", None)}


@pytest.mark.parametrize("path,is_folder,out", [("a", False, False), ("b/x", False, True), ("b/keep", False, False), ("b", True, False)])
def test_the_last_rule_decides(path, is_folder, out):
    rules = [("", listing.as_rule("b/*")), ("b/", listing.as_rule("!keep")), ("", listing.as_rule("a/"))]
    assert listing.is_left_out(path, is_folder, rules) == out
