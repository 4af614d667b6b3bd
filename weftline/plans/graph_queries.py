"""Registered graph queries, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import fixpoint, graph
from weftline.session import materialize
from weftline.sources import lens

#: Parameters of the queries on one target.
TARGET, SYMBOL = 10, "fn7"

EDGES_SQL = """
  files AS (SELECT p_partkey AS file, p_type || '/' || p_brand || '/' || p_partkey AS path, p_brand AS package, p_type AS directory,
                   p_size % 10 = 0 AS is_test, CAST(right(p_brand, 1) AS INT) % 2 = 0 AS published, CAST(p_size AS BIGINT) AS size FROM part),
  raw AS (
    SELECT a.l_partkey AS src, b.l_partkey AS dst,
           CASE WHEN f.is_test THEN 'tests' ELSE ['imports', 'calls', 'references', 'inherits'][a.l_linenumber % 4 + 1] END AS kind,
           a.l_returnflag <> 'N' AS exact, a.l_linenumber AS line
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN files f ON f.file = a.l_partkey
    WHERE a.l_partkey > b.l_partkey),
  edges AS (SELECT src, dst, kind, bool_or(exact) AS exact, list_sort(list_distinct(list(line))) AS lines FROM raw GROUP BY ALL),
  deps AS (SELECT src, dst, bool_or(exact) AS exact FROM edges WHERE kind <> 'tests' GROUP BY ALL),
  covered AS (SELECT DISTINCT dst AS file FROM edges WHERE kind = 'tests')"""


def reach_sql(seeds: str, step: str = "r.id = d.dst", to: str = "d.src") -> str:
    return f"""
  steps AS ({seeds} UNION
    SELECT r.target, {to}, r.exact AND d.exact FROM steps r JOIN deps d ON {step} WHERE {to} <> r.target),
  reach AS (SELECT target, id, bool_or(exact) AS exact FROM steps GROUP BY ALL)"""


ONE = f"SELECT dst AS target, src AS id, exact FROM deps WHERE dst = {TARGET}"
ASKED = f"SELECT dst AS target, src AS id, exact FROM deps WHERE dst % {lens.QUERY_STEP} = 0"


def with_sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


class Graph:
    """The lens tables of one folder; what is used several times is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.files = spark, lens.files(spark, sf_dir)
        self.raw = lens.raw_edges(spark, sf_dir)
        self.edges = graph.merge_edges(self.raw)
        self.sf_dir = sf_dir

    def deps(self) -> DataFrame:
        """Of the raw edges, as neither kinds nor lines matter: one aggregation instead of two."""
        return materialize(graph.file_deps(self.raw.where("src <> dst")), "file-deps")

    def target(self, key: int = TARGET) -> DataFrame:
        return self.spark.range(key, key + 1).toDF("target")


def dependents_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_deps(Graph(spark, sf_dir).edges).where(F.col("dst") == TARGET).select(F.col("src").alias("id"), "exact")


def dependents_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return fixpoint.dependents(g.deps(), g.target()).select("id", "exact")


def dependents_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return fixpoint.dependents(g.deps(), g.target(), depth=2).select("id", "exact")


def dependents_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = materialize(lens.cyclic_deps(spark, sf_dir), "file-deps")
    return fixpoint.dependents(deps, Graph(spark, sf_dir).target()).select("id", "exact")


def dependencies_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file of the query set depends on."""
    g = Graph(spark, sf_dir)
    return fixpoint.dependencies(g.deps(), lens.query_set(g.files))


def _reach_asked(g: Graph) -> tuple[fixpoint.Reach, DataFrame]:
    deps = g.deps()
    direct = deps.join(lens.query_set(g.files), deps["dst"] == F.col("target")).select("target", F.col("src").alias("id"), "exact")
    return fixpoint.reach(deps, direct), direct


def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    reach, direct = _reach_asked(g)
    return graph.impact_summary(reach, direct, g.files, graph.covered_files(g.edges))


def blast_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_score(impact_summary(spark, sf_dir))


def impact_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    reach = fixpoint.dependents(g.deps(), g.target())
    return reach.join(graph.covered_files(g.edges).toDF("id"), "id", "left_anti").select("id", "exact")


def impact_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    reach = fixpoint.dependents(g.deps(), g.target())
    return reach.join(g.files, reach["id"] == g.files["file"]).groupBy("package").agg(F.count("*").alias("n_files"))


def evidence_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.evidence(Graph(spark, sf_dir).edges, F.lit(TARGET))


def hubs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return graph.hubs(graph.file_deps(g.edges), g.files)


def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph(spark, sf_dir).edges


def file_deps_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.file_deps(Graph(spark, sf_dir).edges)


def tests_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return graph.tests_for(g.edges, g.files.where("published").select(F.col("file").alias("target")))


def repo_map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    own = g.files.agg(F.count("*").alias("n_files"), F.count_if("is_test").alias("n_tests"), F.count_distinct("package").alias("n_packages"))
    return own.crossJoin(lens.symbols(spark, sf_dir).agg(F.count("*").alias("n_symbols")))  # one row each


def repo_map_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_directories(Graph(spark, sf_dir).files)


def package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and covered files per package, those without any among them."""
    g = Graph(spark, sf_dir)
    tested = graph.covered_files(g.edges).withColumn("tested", F.lit(True))
    return g.files.join(tested, "file", "left").groupBy("package").agg(F.count("*").alias("n_files"), F.count_if("tested").alias("n_covered"))


def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_symbol(lens.symbols(spark, sf_dir), SYMBOL)


def published_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that some published file depends on, and whether by an exact path."""
    g = Graph(spark, sf_dir)
    return fixpoint.reached_from(g.deps(), g.files.where("published and not is_test").select(F.col("file").alias("id")))


def published_entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the published files of the query set reach each file."""
    g = Graph(spark, sf_dir)
    entries = lens.query_set(g.files.where("published and not is_test"))
    deps = g.deps().select(F.col("dst").alias("src"), F.col("src").alias("dst"), "exact")
    return graph.entry_counts(fixpoint.reach(deps, fixpoint.direct(deps, entries)))


def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return graph.roles(graph.file_deps(g.edges), g.files)


def component_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    return graph.component_rollup(graph.file_deps(g.edges), g.files)


def forbidden_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package dependencies from published packages to those that aren't."""
    g = Graph(spark, sf_dir)
    package = g.files.groupBy("package").agg(F.max("published").alias("published"))
    rollup = graph.component_rollup(graph.file_deps(g.edges), g.files)
    return rollup.join(package.where("published").select(F.col("package").alias("from_package")), "from_package", "left_semi").join(
        package.where("not published").select(F.col("package").alias("to_package")), "to_package", "left_semi")


def freshness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of today against those of an older state: changed, added and deleted."""
    return graph.freshness(*lens.states(spark, sf_dir))


def dependencies_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file of the query set uses itself."""
    g = Graph(spark, sf_dir)
    return graph.file_deps(g.edges).join(lens.query_set(g.files), F.col("src") == F.col("target"), "left_semi").select(F.col("src").alias("target"), F.col("dst").alias("id"), "exact")


def dependents_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on the target only through other files."""
    g = Graph(spark, sf_dir)
    deps = g.deps()
    return graph.indirect(fixpoint.dependents(deps, g.target()), deps).select("id", "exact")


def importers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an edge of any kind, tests too, into each file of the query set."""
    g = Graph(spark, sf_dir)
    return graph.importers(g.edges, lens.query_set(g.files))


def impact_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages that each target's dependents are in, without its own."""
    g = Graph(spark, sf_dir)
    return graph.spread(_reach_asked(g)[0], g.files)


def synthetic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a made graph with as many nodes as there are parts, mostly towards few of them."""
    return graph.synthetic(spark, lens.table(spark, sf_dir, "part").count(), 3)


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each file is used, changed (ordered) and left untested, against all others."""
    g = Graph(spark, sf_dir)
    churn = lens.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").alias("n"))
    return graph.hotspots(graph.file_deps(g.edges), g.files, churn, graph.covered_files(g.edges))


QUERIES = {
    f.__name__: f
    for f in (
        hotspots, dependencies_direct, dependents_indirect, importers_of, impact_spread, synthetic_graph,
        dependents_direct, dependents_transitive, dependents_depth2, dependents_cyclic, dependencies_transitive, impact_summary,
        blast_score, impact_uncovered, impact_packages, evidence_top3, hubs_topk, edge_merge, file_deps_projection, tests_for,
        repo_map_counts, repo_map_directories, package_counts, find_symbol, published_closure, published_entry_counts, file_roles, component_rollup,
        forbidden_dependencies, freshness_counts,
    )
}

SUMMARY_SQL = """
  summary AS (
    SELECT r.target, count(d.src) AS n_direct, count(*) AS n_transitive, count_if(r.exact) AS n_exact, count(c.file) AS n_covered,
           count(*) - count(c.file) AS n_uncovered, count(DISTINCT f.package) AS n_packages
    FROM reach r JOIN files f ON f.file = r.id LEFT JOIN covered c ON c.file = r.id LEFT JOIN deps d ON d.src = r.id AND d.dst = r.target GROUP BY r.target)"""

ROLLUP_SQL = """
  rollup AS (SELECT s.package AS from_package, t.package AS to_package, count(*) AS n_edges, count_if(exact) AS n_exact
             FROM deps JOIN files s ON s.file = src JOIN files t ON t.file = dst WHERE s.package <> t.package GROUP BY ALL)"""

CYCLIC = """
  deps AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, bool_or(a.l_returnflag <> 'N') AS exact
           FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
           WHERE a.l_partkey <> b.l_partkey GROUP BY ALL)"""

ORACLES = {
    "hotspots": with_sql(EDGES_SQL) + """,
      used AS (SELECT dst AS file, count(*) AS fan_in FROM deps GROUP BY dst), churn AS (SELECT l_partkey AS file, count(*) AS n FROM lineitem GROUP BY 1),
      ranked AS (SELECT f.file, percent_rank() OVER (ORDER BY coalesce(fan_in, 0)) AS used, percent_rank() OVER (ORDER BY coalesce(n, 0)) AS changed
                 FROM files f LEFT JOIN used u ON u.file = f.file LEFT JOIN churn c ON c.file = f.file)
      SELECT r.file, CASE WHEN c.file IS NULL THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * used * changed AS score FROM ranked r LEFT JOIN covered c ON c.file = r.file""",
    "dependencies_direct": with_sql(EDGES_SQL) + f" SELECT src AS target, dst AS id, exact FROM deps WHERE src % {lens.QUERY_STEP} = 0",
    "dependents_indirect": with_sql(EDGES_SQL, reach_sql(ONE)) + f" SELECT id, exact FROM reach WHERE id NOT IN (SELECT src FROM deps WHERE dst = {TARGET})",
    "importers_of": with_sql(EDGES_SQL) + f" SELECT DISTINCT dst AS target, src AS importer FROM edges WHERE dst % {lens.QUERY_STEP} = 0",
    "impact_spread": with_sql(EDGES_SQL, reach_sql(ASKED)) + """
      SELECT r.target, list_sort(list(DISTINCT f.package)) AS packages FROM reach r JOIN files f ON f.file = r.id JOIN files o ON o.file = r.target WHERE f.package <> o.package GROUP BY r.target""",
    "synthetic_graph": """WITH n AS (SELECT count(*) AS n FROM part), x AS (SELECT i AS src, k, ((i * 3 + k) * 1103515245 + 12345) % 2147483648 AS r, n FROM n, range(0, (SELECT n FROM n)) AS a(i), range(0, 3) AS b(k))
      SELECT DISTINCT src, (r // 65536) % CASE WHEN r % 10 < 7 THEN greatest(n // 50, 1) ELSE n END AS dst FROM x WHERE src <> (r // 65536) % CASE WHEN r % 10 < 7 THEN greatest(n // 50, 1) ELSE n END""",
    "dependents_direct": with_sql(EDGES_SQL) + f" SELECT src AS id, exact FROM deps WHERE dst = {TARGET}",
    "dependents_transitive": with_sql(EDGES_SQL, reach_sql(ONE)) + " SELECT id, exact FROM reach",
    "dependents_depth2": with_sql(EDGES_SQL, f" one AS ({ONE})") + f"""
      SELECT id, bool_or(exact) AS exact FROM (SELECT id, exact FROM one UNION ALL
        SELECT d.src, o.exact AND d.exact FROM one o JOIN deps d ON d.dst = o.id WHERE d.src <> {TARGET}) GROUP BY id""",
    "dependents_cyclic": with_sql(CYCLIC, reach_sql(ONE)) + " SELECT id, exact FROM reach",
    "dependencies_transitive": with_sql(EDGES_SQL, reach_sql(f"SELECT src AS target, dst AS id, exact FROM deps WHERE src % {lens.QUERY_STEP} = 0", "r.id = d.src", "d.dst")) + " SELECT * FROM reach",
    "impact_summary": with_sql(EDGES_SQL, reach_sql(ASKED), SUMMARY_SQL) + " SELECT * FROM summary",
    "blast_score": with_sql(EDGES_SQL, reach_sql(ASKED), SUMMARY_SQL)
    + " SELECT target, CAST(least(100, 2 * n_exact + (n_transitive - n_exact) + n_uncovered + 5 * n_packages) AS BIGINT) AS score FROM summary",
    "impact_uncovered": with_sql(EDGES_SQL, reach_sql(ONE)) + " SELECT id, exact FROM reach WHERE id NOT IN (SELECT file FROM covered)",
    "impact_packages": with_sql(EDGES_SQL, reach_sql(ONE)) + " SELECT package, count(*) AS n_files FROM reach JOIN files ON file = id GROUP BY package",
    "evidence_top3": with_sql(EDGES_SQL) + f"""
      SELECT src, kind, exact, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY kind) AS rank FROM edges WHERE dst = {TARGET} AND kind <> 'tests') WHERE rank <= 3""",
    "hubs_topk": with_sql(EDGES_SQL) + " SELECT file, count(*) AS n_dependents, path FROM deps JOIN files ON file = dst GROUP BY file, path ORDER BY n_dependents DESC, path LIMIT 10",
    "edge_merge": with_sql(EDGES_SQL) + " SELECT * FROM edges",
    "file_deps_projection": with_sql(EDGES_SQL) + " SELECT * FROM deps",
    "tests_for": with_sql(EDGES_SQL) + " SELECT DISTINCT dst AS target, src AS test FROM edges WHERE kind = 'tests' AND dst IN (SELECT file FROM files WHERE published)",
    "repo_map_counts": with_sql(EDGES_SQL) + """
      SELECT count(*) AS n_files, count_if(is_test) AS n_tests, count(DISTINCT package) AS n_packages,
             (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS n_symbols FROM files""",
    "repo_map_directories": "SELECT p_type AS directory, count(*) AS n_files FROM part GROUP BY p_type ORDER BY n_files DESC, directory LIMIT 30",
    "package_counts": with_sql(EDGES_SQL) + " SELECT package, count(*) AS n_files, count(c.file) AS n_covered FROM files f LEFT JOIN covered c ON c.file = f.file GROUP BY package",
    "find_symbol": f"""
      SELECT DISTINCT l_partkey AS file, CASE WHEN l_suppkey % 2 = 0 THEN 'Class' || (l_suppkey % 7) || '.' ELSE '' END || 'fn' || l_suppkey AS name
      FROM lineitem WHERE 'fn' || l_suppkey = '{SYMBOL}'""",
    "published_closure": with_sql(EDGES_SQL) + """,
      seen AS (SELECT d.dst AS id, d.exact FROM deps d JOIN files ON file = d.src WHERE published AND NOT is_test
               UNION SELECT d.dst, s.exact AND d.exact FROM seen s JOIN deps d ON d.src = s.id)
      SELECT id, bool_or(exact) AS exact FROM seen GROUP BY id""",
    "published_entry_counts": with_sql(EDGES_SQL, reach_sql(f"SELECT src AS target, dst AS id, exact FROM deps JOIN files ON file = src WHERE published AND NOT is_test AND src % {lens.QUERY_STEP} = 0", "r.id = d.src", "d.dst"))
    + " SELECT id, count(*) AS n_entries FROM reach GROUP BY id",
    "file_roles": with_sql(EDGES_SQL) + """
      SELECT file, fan_in, fan_out, CASE WHEN fan_in >= 50 THEN 'hub' WHEN fan_in >= 10 THEN 'core' WHEN fan_in = 0 THEN 'leaf' ELSE 'inner' END AS role
      FROM (SELECT f.file, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM files f
            LEFT JOIN (SELECT dst, count(*) AS n FROM deps GROUP BY dst) i ON i.dst = f.file LEFT JOIN (SELECT src, count(*) AS n FROM deps GROUP BY src) o ON o.src = f.file)""",
    "component_rollup": with_sql(EDGES_SQL, ROLLUP_SQL) + " SELECT * FROM rollup",
    "forbidden_dependencies": with_sql(EDGES_SQL, ROLLUP_SQL) + """
      SELECT * FROM rollup WHERE from_package IN (SELECT package FROM files WHERE published) AND to_package IN (SELECT package FROM files WHERE NOT published)""",
    "freshness_counts": """
      SELECT count_if(old <> new) AS n_changed, count_if(old IS NULL) AS n_added, count_if(new IS NULL) AS n_deleted
      FROM (SELECT l_partkey AS k, max(l_quantity) AS old FROM lineitem WHERE l_shipdate < DATE '1995-04-01' GROUP BY k)
      FULL JOIN (SELECT l_partkey AS k, max(l_quantity) AS new FROM lineitem WHERE l_shipdate >= DATE '2001-09-01' GROUP BY k) USING (k)""",
}
