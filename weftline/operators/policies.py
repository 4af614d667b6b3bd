"""Policies over paths and dependencies: which rule decides about a file, and which edges break an architecture rule.

Path patterns are cut at their first wildcard, and the folders before it join them with the paths: a path meets the
patterns of its own folders only, so there is never a product of rules and files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.repository import ancestors

# fixed values: what a matched rule does, from the weakest to the strongest
ACTIONS = ("record_only", "tell_agent", "ask_human", "block")
#: What an edge that isn't exact may lead to at most.
MOST_INFERRED = "ask_human"


def strength(action: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ACTIONS)), action)


def stem(pattern: Column) -> Column:
    """The whole folders of a pattern before its first wildcard."""
    return F.regexp_replace(F.regexp_extract(pattern, r"^[^*?\[]*", 0), "/?[^/]*$", "")


def as_expression(pattern: Column) -> Column:
    """A path pattern as a regular expression: ``**`` any folders, ``*`` and ``?`` within one name, ``[...]`` a set."""
    plain = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    marked = F.replace(F.replace(F.replace(plain, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02")), F.lit("*"), F.lit("[^/]*"))
    marked = F.replace(F.replace(marked, F.lit("?"), F.lit("[^/]")), F.lit("[!"), F.lit("[^"))
    return F.concat(F.lit("^"), F.replace(F.replace(marked, F.lit("\x01"), F.lit("(?:[^/]+/)*")), F.lit("\x02"), F.lit(".*")), F.lit("$"))


def matching(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``paths(path, ...)`` with each of ``rules(rule, pattern, ...)`` that its path matches."""
    prepared = rules.withColumns({"__folder": stem(F.col("pattern")), "__expression": as_expression(F.col("pattern"))})
    above = paths.select("*", F.explode(F.transform(ancestors(F.col("path")), lambda a: a["folder"])).alias("__folder"))
    return above.join(prepared, "__folder").where(F.expr("path rlike __expression")).drop("__folder", "__expression", "pattern")


def decide(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, on_match (of the strongest rule that matches) and matched (all of these, by name) of each matched path."""
    rows = matching(paths.select("path").distinct(), rules.select("rule", "pattern", "on_match"))
    found = rows.groupBy("path").agg(F.max(strength(F.col("on_match"))).alias("s"), F.array_sort(F.collect_set("rule")).alias("matched"))
    return found.select("path", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("s").cast("int")).alias("on_match"), "matched")


def violations(deps: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, src, dst, on_match of the dependencies that break a rule.

    ``rules(rule, kind, from_pattern, to_pattern, on_match)`` are of these kinds: ``forbid`` (no edge from the one to the
    other), ``allow_only`` (edges of the one lead to the other or stay inside), ``entrypoint_only`` (from outside the one
    only what the other names may be used). ``deps(src, dst, exact)`` are paths; where an edge isn't exact, a rule that
    blocks asks only. Both ends meet the patterns by their folders, and an edge the rules of its ends.
    """
    paths = files.select("path").distinct()
    own = lambda name: matching(paths, rules.select("rule", F.col(name).alias("pattern")))
    first = own("from_pattern").select("rule", F.col("path").alias("src"))
    second = own("to_pattern").select("rule", F.col("path").alias("dst"), F.lit(True).alias("named"))
    inside = first.select("rule", F.col("src").alias("dst"), F.lit(True).alias("inside"))
    by_kind = lambda kind: rules.where(F.col("kind") == kind).select("rule", "on_match")
    edges = deps.select("src", "dst", "exact")
    leaving = edges.join(first, "src").join(second, ["rule", "dst"], "left").join(inside, ["rule", "dst"], "left")
    forbidden = leaving.where("named").join(by_kind("forbid"), "rule")
    strayed = leaving.where("named is null and inside is null").join(by_kind("allow_only"), "rule")
    entering = edges.join(inside.drop("inside"), "dst").join(first.withColumn("from_inside", F.lit(True)), ["rule", "src"], "left").where("from_inside is null")
    broken = entering.join(second, ["rule", "dst"], "left").where("named is null").join(by_kind("entrypoint_only"), "rule")
    columns = ["rule", "src", "dst", "exact", "on_match"]
    every = forbidden.select(columns).unionAll(strayed.select(columns)).unionAll(broken.select(columns))
    capped = F.when(~F.coalesce("exact", F.lit(False)) & (strength(F.col("on_match")) > ACTIONS.index(MOST_INFERRED) + 1), MOST_INFERRED).otherwise(F.col("on_match"))
    return every.select("rule", "src", "dst", capped.alias("on_match"))


def forbidden_externals(uses: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, path, external of the ``uses(path, external)`` that a rule of ``rules(rule, pattern, external)`` forbids there."""
    named = uses.join(rules.select("external").distinct(), "external", "left_semi").withColumnRenamed("external", "__used")
    return matching(named, rules.select("rule", "pattern", "external")).where("__used = external").select("rule", "path", "external")
