from __future__ import annotations

from weftline.sources.versions import VersionedTable


def test_versions_upserts_and_deletes(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "path string, name string, n long", ["path", "name"])
    assert table.version() == 0 and table.read().count() == 0
    make = lambda *rows: spark.createDataFrame(list(rows), "path string, name string, n long, at long")
    table.upsert(make(("a", "x", 1, 1), ("a", "x", 2, 2), ("b", "y", 3, 1)), "at")
    assert {tuple(r) for r in table.read().collect()} == {("a", "x", 2), ("b", "y", 3)}
    table.upsert(make(("b", "y", 4, 1), ("c", "z", 5, 1)), "at")
    assert {tuple(r) for r in table.read().collect()} == {("a", "x", 2), ("b", "y", 4), ("c", "z", 5)}
    table.replace_where(spark.createDataFrame([("a",), ("c",)], "p string"), "path", make(("a", "new", 9, 1)).drop("at"))
    assert {tuple(r) for r in table.read().collect()} == {("a", "new", 9), ("b", "y", 4)}
    table.delete(spark.createDataFrame([("b", "y")], "path string, name string"))
    assert {tuple(r) for r in table.read().collect()} == {("a", "new", 9)}
    assert {tuple(r) for r in table.read(1).collect()} == {("a", "x", 2), ("b", "y", 3)} and table.version() == 4
