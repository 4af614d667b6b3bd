"""Registered queries over the source lens, from the scan to the published names, and SQL that states their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.facts import extract
from weftline.operators import components, graph, resolve
from weftline.session import materialize, shared_dir
from weftline.sources import listing, repository, source_lens

#: The date of the older state that ``source_rebuild`` starts from.
BEFORE = "2000-01-01"


class Source:
    """Files, manifests and facts of one of the two trees; facts are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str, tree=source_lens.typescript):
        self.files = materialize(source_lens.files(tree(spark, sf_dir)), "tree")
        self.packages = materialize(repository.packages(self.files), "packages")

    def facts(self) -> DataFrame:
        return materialize(extract(self.files), "facts")

    def edges(self) -> DataFrame:
        """Merged edges without their lines."""
        return graph.merge_edges(resolve.build_edges(self.facts(), self.packages)).select("src", "dst", "kind", "exact")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Source(spark, sf_dir).files.select("path", "content_hash", "lang", "is_test")


def source_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = Source(spark, sf_dir).packages.unionAll(Source(spark, sf_dir, source_lens.python).packages)
    return both.select("path", "name", "manifest", "published", F.size("dependencies").alias("n_dependencies"))


def source_nearest_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(spark, sf_dir)
    return repository.nearest_package(s.files.where("lang is not null"), s.packages)


def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Source(spark, sf_dir).facts().select("path", F.explode("facts.symbols").alias("s"))
    return rows.select("path", "s.name", "s.subkind", F.array_join(F.array_sort("s.exportNames"), ",").alias("exported"))


def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Source(spark, sf_dir).facts().select("path", F.explode("facts.imports").alias("i"))
    return rows.groupBy("path", "i.kind").agg(F.count("*").alias("n_imports"), F.sum(F.size("i.bindings")).alias("n_bindings"))


def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Source(spark, sf_dir).facts().select("path", F.explode("facts.references").alias("r")).where("r.enclosing like 'f%'")
    return rows.select("path", "r.local", "r.member", "r.enclosing", "r.isCall")


def source_heritage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Source(spark, sf_dir).facts().select("path", F.explode("facts.heritage").alias("h")).select("path", "h.className", "h.base")


def source_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(spark, sf_dir)
    return resolve.resolve_imports(s.facts(), s.packages).where("target is not null").select("src", "target", "kind", "exact")


def source_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(spark, sf_dir)
    return resolve.externals(resolve.resolve_imports(s.facts(), s.packages))


def source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Source(spark, sf_dir).edges()


def source_file_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_deps(resolve.file_edges(Source(spark, sf_dir).edges()))


def source_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(spark, sf_dir)
    return resolve.published_api(s.facts(), s.packages)


def source_published_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is published where every package publishes its modules as namespaces."""
    s = Source(spark, sf_dir, source_lens.namespaced)
    return resolve.published_api(s.facts(), s.packages)


def source_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the tree, from a build of its state at a date and what has changed since then."""
    before = Source(spark, sf_dir, lambda spark, sf_dir: source_lens.typescript(spark, sf_dir, BEFORE))
    kept, now = resolve.build(before.facts(), before.packages), Source(spark, sf_dir)
    return graph.merge_edges(resolve.rebuild(kept, now.facts(), now.packages).edges).select("src", "dst", "kind", "exact")


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds of the tree when it is written into a folder, with tests and tools in hidden folders and ignore files."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    listing.write_tree(source_lens.scattered(spark, sf_dir), root)
    return repository.scan(spark, root).select("path", "content_hash", "lang", "is_test")


def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles of parts that follow one another in orders."""
    return components.cycles(source_lens.uses(spark, sf_dir, "l_partkey", 6))


def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Source(spark, sf_dir, source_lens.python).facts().select("path", F.explode("facts.symbols").alias("s"))
    return rows.select("path", "s.name", "s.subkind")


def python_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Source(spark, sf_dir, source_lens.python).edges()


def python_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Source(spark, sf_dir, source_lens.python)
    return resolve.externals(resolve.resolve_imports(s.facts(), s.packages))


QUERIES = {
    f.__name__: f
    for f in (
        source_files, source_packages, source_nearest_package, source_symbols, source_imports, source_references, source_heritage, source_resolved, source_externals,
        source_edges, source_file_deps, source_published, source_published_namespaces, source_rebuild, source_scan, dependency_cycles, python_symbols, python_edges, python_externals,
    )
}

# what the lens writes, stated from the tables
TREE = f"""WITH own AS (
    SELECT p_partkey AS key, lower(replace(p_brand, '#', '')) AS package, p_size AS size, p_size % 10 = 0 AS test,
           lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 10 = 0 THEN '/test/p' || p_partkey || '.test' ELSE '/src/p' || p_partkey END || '.ts' AS path FROM part),
  used AS (
    SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CAST((a.l_partkey + b.l_partkey) % 6 AS INT) AS form
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
  u AS (SELECT s.path AS src, d.path AS dst, form, s.test, s.key AS k, used.dst AS d FROM used JOIN own s ON s.key = used.src JOIN own d ON d.key = used.dst),
  shown AS (SELECT *, package || '/src/index.ts' AS index FROM own WHERE size <= {source_lens.PUBLISHED} AND NOT test),
  told AS (
    SELECT src, dst, CASE WHEN test THEN 'tests' ELSE 'imports' END AS kind FROM u
    UNION SELECT src, dst || '#' || CASE WHEN form = 3 THEN 'C' ELSE 'f' END || d, CASE WHEN test THEN 'tests' ELSE 'references' END FROM u WHERE form <> 2
    UNION SELECT src || '#f' || k, dst || '#f' || d, CASE WHEN test THEN 'tests' WHEN form = 5 THEN 'references' ELSE 'calls' END FROM u WHERE form IN (0, 1, 2, 5)
    UNION SELECT src || '#S' || d, dst || '#C' || d, CASE WHEN test THEN 'tests' ELSE 'inherits' END FROM u WHERE form = 3
    UNION SELECT src || '#S' || d, dst || '#C' || d, CASE WHEN test THEN 'tests' ELSE 'references' END FROM u WHERE form = 3
    UNION SELECT index, path, 'imports' FROM shown
    UNION SELECT index, path || '#' || letter || key, 'references' FROM shown, (VALUES ('C'), ('f')) AS l(letter)
    UNION SELECT s.index, u.dst || '#f' || u.d, 'references' FROM shown s JOIN u ON u.src = s.path WHERE u.form = 4)"""
SERVER = """WITH used AS (
    SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst, CAST((a.l_suppkey + b.l_suppkey) % 4 AS INT) AS form
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey),
  u AS (SELECT 'srv/app/s' || src || '.py' AS src, 'srv/app/s' || dst || '.py' AS dst, src AS s, dst AS d, form FROM used JOIN supplier ON s_suppkey = used.src)"""

ORACLES = {
    "source_packages": TREE + f"""
      SELECT package AS path, '@shop/' || package AS name, 'package.json' AS manifest, CAST(right(package, 1) AS INT) % 2 = 0 AS published,
             CAST(count(DISTINCT size) FILTER (size <= {source_lens.DECLARED}) AS INT) AS n_dependencies FROM own GROUP BY package
      UNION ALL SELECT 'srv', 'srv-app', 'pyproject.toml', true, CAST(count(*) AS INT) FROM nation WHERE n_nationkey < 10""",
    "source_nearest_package": TREE + " SELECT path, '@shop/' || package AS package, 'package.json' AS manifest FROM own UNION ALL SELECT DISTINCT index, '@shop/' || package, 'package.json' FROM shown",
    "source_symbols": TREE + """
      SELECT path, 'C' || key AS name, 'class' AS subkind, 'C' || key AS exported FROM own UNION ALL SELECT path, 'f' || key, 'function', 'f' || key FROM own
      UNION ALL SELECT src, 'S' || d, 'class', '' FROM u WHERE form = 3""",
    "source_imports": TREE + """
      SELECT path, kind, count(*) AS n_imports, CAST(sum(n) AS BIGINT) AS n_bindings FROM (
        SELECT path, 'import' AS kind, 0 AS n FROM own UNION ALL SELECT src, CASE WHEN form = 4 THEN 'reexport' ELSE 'import' END, 1 FROM u UNION ALL SELECT index, 'reexport_all', 0 FROM shown) GROUP BY ALL""",
    "source_references": TREE + """
      SELECT src AS path, ['f', 'd', 'n', '', '', 'a'][form + 1] || d AS local, CASE WHEN form = 2 THEN 'f' || d END AS member, 'f' || k AS enclosing, form <> 5 AS isCall FROM u WHERE form IN (0, 1, 2, 5)""",
    "source_heritage": TREE + " SELECT src AS path, 'S' || d AS className, 'C' || d AS base FROM u WHERE form = 3",
    "source_resolved": TREE + " SELECT src, dst AS target, CASE WHEN form = 4 THEN 'reexport' ELSE 'import' END AS kind, true AS exact FROM u UNION ALL SELECT index, path, 'reexport_all', true FROM shown",
    "source_externals": TREE + f" SELECT 'lib' || size AS external, 'third_party' AS external_kind, 'lib' || size AS specifiers, bool_or(size <= {source_lens.DECLARED}) AS declared, count(*) AS n_files FROM own GROUP BY size",
    "source_edges": TREE + """
      SELECT src, dst, kind, true AS exact FROM told UNION ALL SELECT path, 'external:lib' || size, 'depends_on', true FROM own""",
    "source_file_deps": TREE + """
      SELECT DISTINCT string_split(src, '#')[1] AS src, string_split(dst, '#')[1] AS dst, true AS exact FROM told WHERE kind <> 'tests' AND string_split(src, '#')[1] <> string_split(dst, '#')[1]""",
    "source_published": TREE + """, api AS (SELECT * FROM shown WHERE CAST(right(package, 1) AS INT) % 2 = 0)
      SELECT path AS module, letter || key AS symbol FROM api, (VALUES ('C'), ('f')) AS l(letter) UNION SELECT u.dst, 'f' || u.d FROM api a JOIN u ON u.src = a.path WHERE u.form = 4""",
    "python_symbols": SERVER + """
      SELECT 'srv/app/s' || s_suppkey || '.py' AS path, letter || s_suppkey AS name, kind AS subkind FROM supplier, (VALUES ('K', 'class'), ('g', 'function')) AS l(letter, kind)
      UNION ALL SELECT src, 'S' || d, 'class' FROM u WHERE form = 2""",
    "python_edges": SERVER + """
      SELECT DISTINCT src, dst, kind, true AS exact FROM (
        SELECT src, dst, 'imports' AS kind FROM u WHERE form <> 3
        UNION ALL SELECT src, 'srv/app/__init__.py', 'imports' FROM u WHERE form = 3
        UNION ALL SELECT src, dst, 'imports' FROM u WHERE form = 3
        UNION ALL SELECT src, dst || '#' || CASE WHEN form = 2 THEN 'K' ELSE 'g' END || d, 'references' FROM u WHERE form IN (0, 2)
        UNION ALL SELECT src || '#g' || s, dst || '#g' || d, 'calls' FROM u WHERE form <> 2
        UNION ALL SELECT src || '#S' || d, dst || '#K' || d, kind FROM u, (VALUES ('inherits'), ('references')) AS l(kind) WHERE form = 2
        UNION ALL SELECT 'srv/app/s' || s_suppkey || '.py', 'external:' || e, 'depends_on' FROM supplier, LATERAL (SELECT unnest(['os', 'lib_' || s_nationkey]) AS e))""",
    "python_externals": SERVER + """
      SELECT 'os' AS external, 'builtin' AS external_kind, 'os' AS specifiers, CAST(NULL AS BOOLEAN) AS declared, count(*) AS n_files FROM supplier
      UNION ALL SELECT 'lib_' || s_nationkey, 'third_party', 'lib_' || s_nationkey, s_nationkey < 10, count(*) FROM supplier GROUP BY s_nationkey""",
}

ORACLES["source_published_namespaces"], ORACLES["source_rebuild"] = ORACLES["source_published"], ORACLES["source_edges"]
ORACLES["source_scan"] = TREE + """,
  texts AS (
    SELECT CASE WHEN test THEN package || '/__tests__/p' || key || '.js' WHEN size % 10 = 1 THEN package || '/.tools/_p' || key || '.py' WHEN size % 10 = 2 THEN package || '/gen/keep-p' || key || '.ts' ELSE package || '/_lib/p' || key || '.txt' END AS path,
           'part ' || key AS content, CASE WHEN test THEN 'javascript' WHEN size % 10 = 1 THEN 'python' WHEN size % 10 = 2 THEN 'typescript' END AS lang, test AS is_test FROM own WHERE size % 10 <> 3
    UNION ALL SELECT DISTINCT package || '/.gitignore', '/gen/*' || chr(10) || '!keep-*' || chr(10) || '*.log' || chr(10), NULL, false FROM own)
  SELECT path, substr(sha256(content), 1, 20) AS content_hash, lang, is_test FROM texts"""
ORACLES["dependency_cycles"] = """WITH RECURSIVE e AS (
    SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
  reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
  strong AS (SELECT a.src AS id, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)
  SELECT s.component, count(DISTINCT s.id) AS n_files, count(e.dst) AS n_deps FROM strong s JOIN strong t ON t.component = s.component JOIN e ON e.src = s.id AND e.dst = t.id GROUP BY s.component"""

HEAD = """CASE form WHEN 0 THEN 'import { f' || d || ' } from ' WHEN 1 THEN 'import d' || d || ' from ' WHEN 2 THEN 'import * as n' || d || ' from ' WHEN 3 THEN 'import { C' || d || ' } from '
  WHEN 4 THEN 'export { f' || d || ' as r' || d || ' } from ' ELSE 'import { f' || d || ' as a' || d || ' } from ' END || '"../../' || replace(dst || '$', '.ts$', '') || '";' || chr(10)"""
BODY = """CASE form WHEN 0 THEN '  f' || d || '();' || chr(10) WHEN 1 THEN '  d' || d || '();' || chr(10) WHEN 2 THEN '  n' || d || '.f' || d || '();' || chr(10) WHEN 5 THEN '  keep(a' || d || ');' || chr(10) ELSE '' END"""
ORACLES["source_files"] = TREE + f""",
  lines AS (SELECT k, string_agg({HEAD}, '' ORDER BY d) AS head, string_agg({BODY}, '' ORDER BY d) AS body,
                   string_agg(CASE WHEN form = 3 THEN 'class S' || d || ' extends C' || d || ' {{}}' || chr(10) ELSE '' END, '' ORDER BY d) AS tail FROM u GROUP BY k),
  texts AS (
    SELECT path, 'import "lib' || size || '";' || chr(10) || coalesce(head, '') || 'export class C' || key || ' {{}}' || chr(10) || 'export function f' || key || '() {{' || chr(10)
           || coalesce(body, '') || '}}' || chr(10) || 'export default f' || key || ';' || chr(10) || coalesce(tail, '') AS content, 'typescript' AS lang, test AS is_test FROM own LEFT JOIN lines ON k = key
    UNION ALL SELECT index, string_agg(line, '' ORDER BY line), 'typescript', false FROM (SELECT index, 'export * from "./p' || key || '";' || chr(10) AS line FROM shown) GROUP BY index
    UNION ALL SELECT package || '/package.json', '{{"name": "@shop/' || package || '", "private": ' || CASE WHEN CAST(right(package, 1) AS INT) % 2 = 0 THEN 'false' ELSE 'true' END
           || ', "main": "src/index.ts", "dependencies": {{' || coalesce(string_agg(lib, ', ' ORDER BY lib), '') || '}}}}', NULL, false
      FROM (SELECT DISTINCT package, CASE WHEN size <= {source_lens.DECLARED} THEN '"lib' || size || '": "1"' END AS lib FROM own) GROUP BY package)
  SELECT path, substr(sha256(content), 1, 20) AS content_hash, lang, is_test FROM texts"""
