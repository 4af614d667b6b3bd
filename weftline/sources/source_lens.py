"""A source tree written from the business tables, so that scans, extraction and resolution can be held against SQL.

A part is a TypeScript file in the package of its brand, and uses the parts that follow it in an order; in which way
depends on both keys. A supplier is a Python module of one project, and uses the suppliers that follow it. What the
files say is known from the tables, so SQL can state facts, edges and published names without reading any source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.lens import table
from weftline.sources.repository import is_test, language

#: Sizes of parts up to which a package declares its library, and up to which its index publishes the part.
DECLARED, PUBLISHED = 25, 10


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, package, module (the path without its ending), size of the file of each part."""
    part = table(spark, sf_dir, "part")
    package = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    module = F.when(F.col("p_size") % 10 == 0, _text(package, "/test/p", F.col("p_partkey"), ".test")).otherwise(_text(package, "/src/p", F.col("p_partkey")))
    return part.select(F.col("p_partkey").alias("key"), package.alias("package"), module.alias("module"), F.col("p_size").alias("size"))


def uses(spark: SparkSession, sf_dir: str, column: str, forms: int, until: str | None = None) -> DataFrame:
    """src, dst, form: what follows in an order, each pair once; with ``until`` what had by then been shipped."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows if until is None else rows.where(F.col("l_shipdate") < F.lit(until).cast("date"))
    line = rows.select("l_orderkey", "l_linenumber", F.col(column).alias("key"))
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("key").alias("dst"))
    pairs = line.join(after, ["l_orderkey", "l_linenumber"]).where("key <> dst").select(F.col("key").alias("src"), "dst").distinct()
    return pairs.withColumn("form", ((F.col("src") + F.col("dst")) % forms).cast("int"))


def _gathered(pairs: DataFrame, head: Column, body: Column, tail: Column) -> DataFrame:
    """src, and the lines of all its uses for the three places of a file, by dst."""
    lines = pairs.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", head.alias("head"), body.alias("body"), tail.alias("tail")))).alias("u"))
    part = lambda name: F.array_join(F.transform("u", lambda u: u[name]), "").alias(name)
    return lines.select("src", part("head"), part("body"), part("tail"))


def typescript(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """path and content of the files of parts, an index of each package that has published parts, and all manifests, as
    they are or as they were at a date."""
    own = modules(spark, sf_dir)
    to = own.select(F.col("key").alias("dst"), F.col("module").alias("to"))
    pairs = uses(spark, sf_dir, "l_partkey", 6, until).join(to, "dst")
    d, where = F.col("dst"), _text('"../../', F.col("to"), '";\n')
    by_form = lambda *options: F.element_at(F.array(*options), F.col("form") + 1)
    head = by_form(_text("import { f", d, " } from ", where), _text("import d", d, " from ", where), _text("import * as n", d, " from ", where), _text("import { C", d, " } from ", where), _text("export { f", d, " as r", d, " } from ", where), _text("import { f", d, " as a", d, " } from ", where))
    body = by_form(_text("  f", d, "();\n"), _text("  d", d, "();\n"), _text("  n", d, ".f", d, "();\n"), F.lit(""), F.lit(""), _text("  keep(a", d, ");\n"))
    tail = by_form(*[F.lit("")] * 3, _text("class S", d, " extends C", d, " {}\n"), F.lit(""), F.lit(""))
    files = own.join(_gathered(pairs, head, body, tail), own["key"] == F.col("src"), "left")
    k, none = F.col("key"), lambda c: F.coalesce(c, F.lit(""))
    content = _text('import "lib', F.col("size"), '";\n', none("head"), "export class C", k, " {}\nexport function f", k, "() {\n", none("body"), "}\nexport default f", k, ";\n", none("tail"))
    source = files.select(_text(F.col("module"), ".ts").alias("path"), content.alias("content"))
    shown = own.where((F.col("size") <= PUBLISHED) & (F.col("size") % 10 != 0))
    stars = F.array_sort(F.collect_list(_text('export * from "./p', F.col("key"), '";\n')))
    index = shown.groupBy("package").agg(F.array_join(stars, "").alias("content")).select(_text(F.col("package"), "/src/index.ts").alias("path"), "content")
    libraries = F.array_sort(F.collect_set(F.when(F.col("size") <= DECLARED, _text('"lib', F.col("size"), '": "1"'))))
    private = F.when(F.substring("package", -1, 1).cast("int") % 2 == 0, "false").otherwise("true")
    manifest = own.groupBy("package").agg(F.array_join(libraries, ", ").alias("d")).select(_text(F.col("package"), "/package.json").alias("path"), _text('{"name": "@shop/', F.col("package"), '", "private": ', private, ', "main": "src/index.ts", "dependencies": {', F.col("d"), "}}").alias("content"))
    return source.unionAll(index).unionAll(manifest)


def namespaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TypeScript tree with indexes that publish each part as a namespace."""
    tree = typescript(spark, sf_dir)
    spaces = F.regexp_replace("content", r'export \* from "\./(p[0-9]+)"', 'export * as n$1 from "./$1"')
    return tree.withColumn("content", F.when(F.col("path").endswith("/src/index.ts"), spaces).otherwise(F.col("content")))


def python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of the modules of suppliers and of their project's manifest."""
    pairs, d = uses(spark, sf_dir, "l_suppkey", 4), F.col("dst")
    by_form = lambda *options: F.element_at(F.array(*options), F.col("form") + 1)
    head = by_form(_text("from app.s", d, " import g", d, "\n"), _text("import app.s", d, " as m", d, "\n"), _text("from .s", d, " import K", d, "\n"), _text("from . import s", d, "\n"))
    body = by_form(_text("    g", d, "()\n"), _text("    m", d, ".g", d, "()\n"), F.lit(""), _text("    s", d, ".g", d, "()\n"))
    tail = by_form(F.lit(""), F.lit(""), _text("class S", d, "(K", d, "):\n    pass\n"), F.lit(""))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    files = supplier.join(_gathered(pairs, head, body, tail), supplier["key"] == F.col("src"), "left")
    k, none = F.col("key"), lambda c: F.coalesce(c, F.lit(""))
    content = _text("import os\nimport lib_", F.col("nation"), "\n", none("head"), "class K", k, ":\n    pass\ndef g", k, "():\n    pass\n", none("body"), none("tail"))
    source = files.select(_text("srv/app/s", k, ".py").alias("path"), content.alias("content"))
    declared = table(spark, sf_dir, "nation").where("n_nationkey < 10").agg(F.array_join(F.array_sort(F.collect_list(_text('"Lib.', F.col("n_nationkey"), ' >= 1"'))), ", ").alias("d"))
    manifest = declared.select(F.lit("srv/pyproject.toml").alias("path"), _text('[project]\nname = "Srv_App"\ndependencies = [', F.col("d"), "]\n").alias("content"))
    return source.unionAll(manifest).unionAll(spark.createDataFrame([("srv/app/__init__.py", "")], "path string, content string"))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of one small file for each part, in folders that begin with a dot or underscores, some of them in
    what the package's ignore file leaves out or takes back, and of these ignore files."""
    own = modules(spark, sf_dir)
    k, package, rest = F.col("key"), F.col("package"), F.col("size") % 10
    left_out = F.when(F.col("key") % 2 == 0, _text(package, "/gen/p", k, ".ts")).otherwise(_text(package, "/src/p", k, ".log"))
    path = F.when(rest == 0, _text(package, "/__tests__/p", k, ".js")).when(rest == 1, _text(package, "/.tools/_p", k, ".py")).when(rest == 2, _text(package, "/gen/keep-p", k, ".ts")).when(rest == 3, left_out)
    parts = own.select(path.otherwise(_text(package, "/_lib/p", k, ".txt")).alias("path"), _text("part ", k).alias("content"))
    return parts.unionAll(own.select(_text(package, "/.gitignore"), F.lit("/gen/*\n!keep-*\n*.log\n")).distinct())


def files(tree: DataFrame) -> DataFrame:
    """The tree as ``repository.scan`` gives one from a folder."""
    path = F.col("path")
    return tree.select("path", "content", F.substring(F.sha2("content", 256), 1, 20).alias("content_hash"), language(path).alias("lang"), is_test(path).alias("is_test"))
