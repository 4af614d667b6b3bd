"""Lenses: the business tables re-read as a code graph, an event log, experiment runs and linked pages.

A file is a part, its package the brand, its directory the type; parts that appear in one order depend on each other;
an event is a tool call. Every lens is a plain projection or join, so that SQL on another engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge kinds that make one file depend on another.
DEPENDENCY_KINDS = ("imports", "calls", "references", "inherits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, path, package, directory, is_test, published, size, content_hash."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("file"),
        F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_brand").alias("package"),
        F.col("p_type").alias("directory"),
        (F.col("p_size") % 10 == 0).alias("is_test"),
        (F.substring("p_brand", -1, 1).cast("int") % 2 == 0).alias("published"),
        F.col("p_size").cast("long").alias("size"),
        F.substring(F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256), 1, 20).alias("content_hash"),
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, exact, line: one row per occurrence, duplicates included. Edges of test files are of kind tests."""
    line = table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", F.col("l_partkey").alias("src"), (F.col("l_returnflag") != "N").alias("exact"), F.col("l_linenumber").alias("line"))
    b = line.select("l_orderkey", F.col("l_partkey").alias("dst"))
    kind = F.element_at(F.array(*map(F.lit, DEPENDENCY_KINDS)), F.col("line") % 4 + 1)
    pairs = a.join(b, "l_orderkey").where("src > dst")
    tests = files(spark, sf_dir).select(F.col("file").alias("src"), "is_test")
    pairs = pairs.join(tests, "src")
    return pairs.select("src", "dst", F.when(F.col("is_test"), "tests").otherwise(kind).alias("kind"), "exact", "line")


def cyclic_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, exact: parts of consecutive lines of an order; a graph with large cycles."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"), (F.col("l_returnflag") != "N").alias("exact"))
    b = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").groupBy("src", "dst").agg(F.max("exact").alias("exact"))


#: Queries that answer many targets at once take every file whose id is divisible by this, against all edges.
QUERY_STEP = 50


def query_set(files: DataFrame) -> DataFrame:
    """target: the files that the queries on many targets ask about."""
    return files.where(F.col("file") % QUERY_STEP == 0).select(F.col("file").alias("target"))


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """path, content_hash of the files at two times: those ordered up to a date, and those ordered since, whose contents
    are the largest quantity by then."""
    line = table(spark, sf_dir, "lineitem")
    state = lambda when: line.where(when).groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.max("l_quantity").cast("string").alias("content_hash"))
    return state("l_shipdate < date'1995-04-01'"), state("l_shipdate >= date'2001-09-01'")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, name: a symbol for each supplier that a part was bought from, methods with a dotted name."""
    line = table(spark, sf_dir, "lineitem")
    owner = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Class"), F.col("l_suppkey") % 7, F.lit("."))).otherwise(F.lit(""))
    return line.select(F.col("l_partkey").alias("file"), F.concat(owner, F.lit("fn"), F.col("l_suppkey")).alias("name")).distinct()


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: seq, ts, session, tool_use, tool, phase (start or end), ms, path, added."""
    e = table(spark, sf_dir, "events")
    use = F.floor(F.col("event_id") / 2)
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        (use % 150).alias("session"),
        use.alias("tool_use"),
        F.col("event_type").alias("tool"),
        F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"),
        F.round("value").cast("long").alias("ms"),
        (F.col("user_id") % 40).alias("path"),
        F.floor("value").cast("long").alias("added"),
        (F.col("event_id") % 7).alias("removed"),
    )


#: Kinds of events of the session log, by event_id.
KINDS = ("session_start", "prompt", "tool_call_start", "tool_call_end", "compaction", "turn_end", "session_end")
OUTCOMES = ("ok", "failed", "unknown", "denied")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session log: every event of the table as one of seven kinds, in the session of its user."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    said = lambda prefix, mod: F.concat(F.lit(prefix), (n % mod).cast("string"))
    return e.select(
        n.alias("seq"), "ts", F.col("user_id").alias("session"), pick(KINDS, n % 7).alias("type"), F.when(n % 4 != 0, said("d", 3)).alias("cwd"), F.col("event_type").alias("source"),
        F.when(n % 3 != 0, said("m", 5)).alias("model"), F.when(n % 2 == 0, said("h", 11)).alias("git_head"), said("r", 4).alias("reason"),
        F.floor(n / 7 % 4).cast("long").alias("tool_use"), F.col("event_type").alias("tool"), F.when(n % 7 == 2, said("a", 13)).alias("args"),
        pick(OUTCOMES, F.floor(n / 7) % 4).alias("outcome"), F.round("value").cast("long").alias("ms"),
    )


def hook_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.col("event_type").alias("hook"), (F.col("value") - 3).alias("ms"), (n % 2 == 0).alias("sync"), F.when(n % 3 == 0, n % 5).alias("context_chars"), (n % 29 == 0).alias("failed"))


#: Folders and names that paths are made of, each with what it makes of the path: ignored, a test, the language.
FOLDERS = (("src", False, False), ("node_modules/a", True, False), ("a/tests", False, True), ("x/__pycache__", True, False), ("__tests__/deep", False, True), ("target", False, False), (".mypy_cache", True, False), ("testing", False, False))
NAMES = (("m.ts", False, "typescript"), ("m.test.tsx", True, "tsx"), ("test_m.py", True, "python"), ("m_test.py", True, "python"), ("m.spec.md", False, None), ("test_.py", False, "python"), ("m.pyi", False, None), ("m.mjs", False, "javascript"), ("dist", False, None))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: a folder by the size of each part, a name by its key."""
    part = table(spark, sf_dir, "part")
    pick = lambda rows, at: F.element_at(F.array(*(F.lit(r[0]) for r in rows)), (at % len(rows) + 1).cast("int"))
    return part.select(F.concat_ws("/", F.col("p_partkey").cast("string"), pick(FOLDERS, F.col("p_size")), pick(NAMES, F.col("p_partkey"))).alias("path"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment rows: run, task, condition (baseline or treatment), trial, status, metric."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run"),
        F.col("event_type").alias("task"),
        F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("treatment").alias("condition"),
        F.floor(F.col("event_id") / 2).alias("trial"),
        F.when(F.col("event_id") % 29 == 0, "error").otherwise("ok").alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("metric"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, specifier: the href of each anchor of each page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("specifier"))
