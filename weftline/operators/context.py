"""Targets by name, and the short texts that tell what depends on a file."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import cap, fit_list, json_quoted
from weftline.operators.graph import find_symbol

EDIT_MOST, SESSION_MOST, LISTED = 800, 1500, 8


class TargetError(ValueError):
    """A target that is unknown or ambiguous, with the targets that may be meant."""

    def __init__(self, message: str, candidates: list[str] = ()):
        super().__init__(message)
        self.candidates = list(candidates)


def resolve_target(files: DataFrame, symbols: DataFrame, spec: str) -> tuple[str, str | None]:
    """(path, symbol) for ``path``, ``path#Symbol`` or a bare symbol; an exact name goes before a method's.

    ``files(path)``, ``symbols(path, name)``. What comes to the driver are the matches of one name.
    """
    raw, mark, symbol = spec.partition("#")
    path = posixpath.normpath(raw)
    if not files.where(F.col("path") == path).isEmpty():
        if not mark:
            return path, None
        found = sorted({r["name"] for r in find_symbol(symbols.where(F.col("path") == path), symbol).collect()})
        found = [symbol] if symbol in found else found
        if len(found) == 1:
            return path, found[0]
        raise TargetError(f"{symbol!r} is {'ambiguous' if found else 'no symbol'} in {path}", [f"{path}#{n}" for n in found])
    if not mark:
        found = sorted({(r["path"], r["name"]) for r in find_symbol(symbols, spec).collect()})
        if len(found) == 1:
            return found[0]
        if found:
            raise TargetError(f"{spec!r} is ambiguous", [f"{p}#{n}" for p, n in found])
    raise TargetError(f"not in the graph: {spec}")


def page(rows: DataFrame, limit: int) -> tuple[list, bool]:
    """At most ``limit`` rows, and whether there are more."""
    found = rows.limit(limit + 1).collect()
    return found[:limit], len(found) > limit


def edit_context(summary: DataFrame, direct: DataFrame) -> DataFrame:
    """target, note for files that something depends on: how much, how well tested, and the direct dependents.

    ``summary(target, n_direct, n_transitive, n_covered, n_packages, published, covered)``, ``direct(target, path,
    tested)``. Dependents are listed, those that no test reaches first, as far as there is room; of each target the first
    ``LISTED`` are kept by a ranked window, never all of a hub's in one row, and all others are counted.
    """
    quoted = json_quoted(F.col("path"), 100)
    first = direct.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("tested", "path"))).where(F.col("rank") <= LISTED)
    listed = first.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", quoted.alias("path")))), lambda d: d["path"]).alias("paths"))
    listed = listed.join(direct.groupBy("target").agg(F.count_if(~F.col("tested")).alias("n_untested")), "target")
    head = F.concat(
        F.lit("About "), json_quoted(F.col("target"), 100), F.lit(", as data: direct dependents "), F.col("n_direct").cast("string"),
        F.lit(", all dependents "), F.col("n_transitive").cast("string"), F.lit(" in packages "), F.col("n_packages").cast("string"), F.lit("; with a test "), F.col("n_covered").cast("string"), F.lit(". "),
        F.when(F.col("published"), "Part of what its package publishes. ").otherwise(""),
        F.when(F.col("covered"), "Has a test of its own. ").otherwise("Has no test of its own: check its users by hand. "),
        F.lit("Users"), F.when(F.col("n_untested") > 0, F.concat(F.lit(" ("), F.col("n_untested").cast("string"), F.lit(" without a test first)"))).otherwise(""), F.lit(": "),
    )
    rows = summary.where("n_direct > 0").join(listed, "target").withColumn("head", head)
    room = F.greatest(F.lit(0), F.lit(EDIT_MOST - 20) - F.length("head"))
    shown = fit_list(F.col("paths"), room, more=F.col("n_direct").cast("int") - F.size("paths"))
    return rows.select("target", cap(F.concat("head", shown, F.lit(".")), EDIT_MOST).alias("note"))


def session_context(packages: DataFrame, hubs: DataFrame, n_files: int, n_tests: int) -> str | None:
    """A short map of the repository: packages(name, n_files), hubs(path, n_dependents) in order; None without files."""
    if not n_files:
        return None
    lines = [f"The repository in numbers, as data: files {n_files}, tests {n_tests}."]
    for label, rows, text in (("By package", packages.limit(7), lambda r: f'"{r["name"]}" ({r["n_files"]} files)'), ("With the most dependents", hubs.limit(6), lambda r: f'"{r["path"]}" ({r["n_dependents"]})')):
        own = [text(r) for r in rows.collect()]
        if own:
            lines.append(f"{label}: {', '.join(own[:6])}{' (and more)' if len(own) > 6 else ''}")
    note = "\n".join(lines)
    return note if len(note) <= SESSION_MOST else note[: SESSION_MOST - 1] + "…"
