"""Queries over the property graph: edges(src, dst, kind, exact, ...) and files(file, path, package, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.fixpoint import Reach
from weftline.operators.ranking import percent_ranks
from weftline.session import materialize
from weftline.sources.lens import DEPENDENCY_KINDS


def merge_edges(raw: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind): distinct sorted lines, exact if any occurrence is; self edges are dropped."""
    return raw.where("src <> dst").groupBy("src", "dst", "kind").agg(F.max("exact").alias("exact"), F.array_sort(F.collect_set("line")).alias("lines"))


def file_deps(edges: DataFrame) -> DataFrame:
    """src, dst, exact: the file-level projection of the dependency kinds."""
    return edges.where(F.col("kind").isin(*DEPENDENCY_KINDS)).groupBy("src", "dst").agg(F.max("exact").alias("exact"))


def covered_files(edges: DataFrame) -> DataFrame:
    """file: files that some test has an edge into."""
    return edges.where("kind = 'tests'").select(F.col("dst").alias("file")).distinct()


def tests_for(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, test: test files with an edge into each of ``targets(target)``."""
    tests = edges.where("kind = 'tests'").select(F.col("dst").alias("target"), F.col("src").alias("test"))
    return tests.join(targets, "target", "left_semi").distinct()


def hubs(deps: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """The files with the most direct dependents; ties by path."""
    counts = deps.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("n_dependents"))
    return counts.join(files.select("file", "path"), "file").orderBy(F.desc("n_dependents"), "path").limit(limit)


def evidence(edges: DataFrame, target: Column, limit: int = 3) -> DataFrame:
    """src, kind, exact, rank: the first edges by which each dependent file uses a target."""
    order = Window.partitionBy("src", "dst").orderBy("kind")
    own = edges.where((F.col("dst") == target) & F.col("kind").isin(*DEPENDENCY_KINDS))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("src", "kind", "exact", "rank")


def impact_summary(reach: Reach, direct: DataFrame, files: DataFrame, covered: DataFrame) -> DataFrame:
    """Per target: direct and transitive dependents, the exact, covered and uncovered ones, and packages touched.

    What is known of a dependent is joined to its bits; pairs are made and summed within a task and never shuffled.
    """
    where = files.select(F.col("file").alias("id"), "package")
    tested = covered.select(F.col("file").alias("id"), F.lit(True).alias("tested"))
    known = reach._replace(bits=reach.bits.join(where, "id").join(tested, "id", "left")).gathered()
    by_package = known.pairs("package", "tested").groupBy("target", "package").agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact"), F.count_if("tested").alias("n_covered"))
    rows = by_package.groupBy("target").agg(F.sum("n").alias("n_transitive"), F.sum("n_exact").alias("n_exact"), F.sum("n_covered").alias("n_covered"), F.count("package").alias("n_packages"))
    own = direct.where("id <> target").join(where, "id", "left_semi").groupBy("target").agg(F.count("*").alias("n_direct"))
    return rows.join(own, "target", "left").select(
        "target", F.coalesce("n_direct", F.lit(0).cast("long")).alias("n_direct"), "n_transitive", "n_exact", "n_covered", (F.col("n_transitive") - F.col("n_covered")).alias("n_uncovered"), "n_packages")


def blast_score(summary: DataFrame) -> DataFrame:
    """target, score: 0 to 100; dependents weigh 2 if exact and 1 if heuristic, uncovered ones 1 more, packages 5."""
    weight = 2 * F.col("n_exact") + (F.col("n_transitive") - F.col("n_exact")) + F.col("n_uncovered") + 5 * F.col("n_packages")
    return summary.select("target", F.least(F.lit(100), weight).cast("long").alias("score"))


def roles(deps: DataFrame, files: DataFrame) -> DataFrame:
    """file, fan_in, fan_out and role: leaf without dependents, core with ten or more, hub from fifty on."""
    fan_in = deps.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("fan_in"))
    fan_out = deps.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("fan_out"))
    rows = files.select("file").join(fan_in, "file", "left").join(fan_out, "file", "left").fillna(0)
    role = F.when(F.col("fan_in") >= 50, "hub").when(F.col("fan_in") >= 10, "core").when(F.col("fan_in") == 0, "leaf").otherwise("inner")
    return rows.select("file", "fan_in", "fan_out", role.alias("role"))


def component_rollup(deps: DataFrame, files: DataFrame) -> DataFrame:
    """from_package, to_package, n_edges, n_exact: dependencies between different packages."""
    own = files.select(F.col("file").alias("src"), F.col("package").alias("from_package"))
    other = files.select(F.col("file").alias("dst"), F.col("package").alias("to_package"))
    rows = deps.join(own, "src").join(other, "dst").where("from_package <> to_package")
    return rows.groupBy("from_package", "to_package").agg(F.count("*").alias("n_edges"), F.count_if("exact").alias("n_exact"))


def violations(rollup: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Rows of a rollup that ``forbidden(from_package, to_package)`` names."""
    return rollup.join(forbidden, ["from_package", "to_package"], "left_semi")


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of a name, or methods of it, by case."""
    return symbols.where((F.col("name") == name) | F.endswith("name", F.lit(f".{name}")))


def top_directories(files: DataFrame, limit: int = 30) -> DataFrame:
    """directory, n_files: files below each top-level directory ("." for files at the root), most first."""
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".")
    return files.groupBy(top.alias("directory")).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "directory").limit(limit)


def freshness(stored: DataFrame, current: DataFrame) -> DataFrame:
    """n_changed, n_added, n_deleted of ``current(path, content_hash)`` against what is stored."""
    both = stored.select("path", F.col("content_hash").alias("old")).join(current.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    return both.agg(F.count_if(F.expr("old <> new")).alias("n_changed"), F.count_if(F.expr("old is null")).alias("n_added"), F.count_if(F.expr("new is null")).alias("n_deleted"))


def indirect(reach: DataFrame, deps: DataFrame) -> DataFrame:
    """Of ``reach(target, id, exact)`` what has no dependency on the target itself."""
    return reach.join(deps.select(F.col("dst").alias("target"), F.col("src").alias("id")), ["target", "id"], "left_anti")


def importers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, importer: files with an edge of any kind into each of ``targets(target)``, other than itself."""
    return edges.select(F.col("dst").alias("target"), F.col("src").alias("importer")).where("target <> importer").join(targets, "target", "left_semi").distinct()


def spread(reach: Reach, files: DataFrame) -> DataFrame:
    """target, packages: the other packages that a reach touches, sorted; targets without any are left out."""
    of = lambda key, name: files.select(F.col("file").alias(key), F.col("package").alias(name))
    touched = reach._replace(bits=reach.bits.join(of("id", "package"), "id")).gathered().pairs("package").select("target", "package").distinct()
    return touched.join(of("target", "own"), "target").where("package <> own").groupBy("target").agg(F.array_sort(F.collect_set("package")).alias("packages"))


def entry_counts(reach: Reach) -> DataFrame:
    """id, n_entries: of how many targets each id is in the reach, counted by bits."""
    return reach.bits.groupBy("id").agg(F.sum(F.bit_count("any")).cast("long").alias("n_entries"))


def synthetic(spark: SparkSession, n: int, degree: int) -> DataFrame:
    """src, dst of a made graph: seven in ten edges lead to the first fiftieth of the nodes, by integer arithmetic alone."""
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(degree - 1))).alias("k"))
    r = ((F.col("src") * degree + F.col("k")) * 1103515245 + 12345) % 2147483648
    few = F.when(r % 10 < 7, F.lit(max(1, n // 50))).otherwise(n)
    return rows.select("src", (F.floor(r / 65536) % few).cast("long").alias("dst")).where("src <> dst").distinct()


def hotspots(deps: DataFrame, files: DataFrame, churn: DataFrame, covered: DataFrame) -> DataFrame:
    """file, score of each of ``files(file)``: its percent rank by dependents, times that by ``churn(file, n)``, twice as
    much for a file that no test is for; what is often used, often changed and not tested comes first."""
    used = deps.groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("fan_in"))
    rows = files.select("file").join(used, "file", "left").join(churn, "file", "left").na.fill(0, ["fan_in", "n"])
    rows = materialize(rows, "hotspots")
    by_use, by_change = percent_ranks(rows, "file", "fan_in").withColumnRenamed("rank", "used"), percent_ranks(rows, "file", "n").withColumnRenamed("rank", "changed")
    tested = covered.select("file", F.lit(1.0).alias("weight"))
    return rows.select("file").join(by_use, "file").join(by_change, "file").join(tested, "file", "left").select("file", (F.coalesce("weight", F.lit(2.0)) * F.col("used") * F.col("changed")).alias("score"))
