"""Logs as tables: agent transcripts, failure logs and hashes of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import running_sum
from weftline.session import discard, materialize

USAGE = "struct<input_tokens: long, output_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long>"
LINE = (
    "type string, subtype string, is_error boolean, total_cost_usd double, num_turns int, model string,"
    f" usage {USAGE}, modelUsage map<string, struct<inputTokens: long, outputTokens: long, cacheCreationInputTokens: long, cacheReadInputTokens: long>>,"
    f" message struct<id: string, usage: {USAGE}, content: array<struct<type: string, name: string, input: string>>>"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """run (the file's name), at and line of every line of text files, which are read in splits as they come.

    A line is numbered from its file's beginning: within its split by the order of reading, and by the lines of the
    splits before it, which are counted per split. So no file is a row or a task of its own, however long it is.
    """
    own = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), own.alias("run"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    rows = materialize(rows, "lines")
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # a split holds tens of megabytes, so there are few of them
    return rows.join(splits, ["file", "start"]).select("run", (F.col("before") + F.col("id") - F.col("first")).alias("at"), "line")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """run (the file's name), at, and the parsed event of each line that is JSON with a type, of files of JSON lines."""
    return numbered_lines(spark, path).select("run", "at", F.from_json("line", LINE).alias("e")).where("e.type is not null")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """run, at and line of what isn't empty and is no event, to be looked at instead of lost."""
    rows = numbered_lines(spark, path).where("trim(line) <> ''")
    return rows.select("run", "at", "line", F.from_json("line", LINE).alias("e")).where("e.type is null").drop("e")


def transcript_summary(events: DataFrame) -> DataFrame:
    """run, finished, end_reason, api_error, tokens, cost_usd, turns, model of each transcript.

    Tokens are those of all models in the result, else of its usage; without a result, the last usage of each message.
    """
    total = lambda u: sum((F.coalesce(u[k], F.lit(0)) for k in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")), F.lit(0))
    models = F.map_values("e.modelUsage")
    of_models = F.aggregate(models, F.lit(0).cast("long"), lambda n, m: n + sum((F.coalesce(m[k], F.lit(0)) for k in ("inputTokens", "outputTokens", "cacheCreationInputTokens", "cacheReadInputTokens")), F.lit(0)))
    of_result = F.when(F.size(models) > 0, of_models).otherwise(total(F.col("e.usage")))
    is_result = F.col("e.type") == "result"
    last = lambda value: F.max_by(F.when(is_result, value), F.when(is_result, F.col("at")))
    whole = events.groupBy("run").agg(
        F.max(is_result).alias("finished"),
        last(F.col("e.subtype")).alias("end_reason"),
        F.coalesce(last(F.col("e.is_error") & (F.col("e.subtype") != "error_max_turns")), F.lit(False)).alias("api_error"),
        last(of_result).alias("of_result"),
        last(F.col("e.total_cost_usd")).alias("cost_usd"),
        last(F.col("e.num_turns")).alias("turns"),
        F.max_by(F.when(F.col("e.subtype") == "init", F.col("e.model")), F.when(F.col("e.subtype") == "init", F.col("at"))).alias("model"),
    )
    messages = events.where("e.type = 'assistant' and e.message.id is not null and e.message.usage is not null").groupBy("run", F.col("e.message.id").alias("id")).agg(F.max_by(F.col("e.message.usage"), "at").alias("usage"))
    sums = messages.groupBy("run").agg(F.sum(total(F.col("usage"))).alias("of_messages"))
    return whole.join(sums, "run", "left").withColumn("tokens", F.coalesce("of_result", "of_messages")).drop("of_result", "of_messages")


def transcript_tools(events: DataFrame) -> DataFrame:
    """run, tool, calls."""
    blocks = events.where("e.type = 'assistant'").select("run", F.explode("e.message.content").alias("b"))
    return blocks.where("b.type = 'tool_use' and b.name is not null").groupBy("run", F.col("b.name").alias("tool")).agg(F.count("*").alias("calls"))


def touched(events: DataFrame, forbidden: list[str]) -> DataFrame:
    """run, reason: tool calls whose input names something forbidden."""
    blocks = events.where("e.type = 'assistant'").select("run", F.explode("e.message.content").alias("b")).where("b.type = 'tool_use'")
    hits = blocks.select("run", "b.name", F.explode(F.filter(F.array(*map(F.lit, forbidden)), lambda f: F.contains(F.col("b.input"), f))).alias("what"))
    return hits.select("run", F.concat(F.lit("tool call "), "name", F.lit(" touched "), "what").alias("reason")).distinct()


def failures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """session, n_failures of tab-separated failure logs (time, component, session, message)."""
    rows = spark.read.option("sep", "\t").schema("at string, component string, session string, message string").csv(paths)
    return rows.where("session is not null").groupBy("session").agg(F.count("*").alias("n_failures"))


#: Of so many rows about one ends a block of the hash tree, and so many are one block.
BLOCK = 256


def folder_hash(files: DataFrame, content: Column | None = None) -> DataFrame:
    """One row: a hash of all paths and contents of ``files(path, content)``, the same for any order and partitions.

    A tree of hashes: rows in the order of their paths are cut into blocks after those whose own hash says so, so the
    cuts depend on the rows alone; a block's hash is that of its rows', and blocks are rows of the next level, until
    ``BLOCK`` are left. A change moves the cuts near it only, and no row holds more than a block.
    """
    digest = F.sha2(F.concat(F.col("path"), F.lit("\0"), F.sha2((content if content is not None else F.col("content")).cast("binary"), 256)).cast("binary"), 256)
    rows = materialize(files.select("path", digest.alias("digest")), "hashes")
    while (n := rows.count()) > BLOCK:
        ends = (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % BLOCK == 0).cast("long")
        placed = running_sum(rows.withColumn("ends", ends), ["path", "digest"], "ends", "block")
        blocks = placed.groupBy("block").agg(F.min("path").alias("path"), _together().alias("digest"))
        was, rows = rows, materialize(blocks.select("path", "digest"), "hashes")
        discard(was)
        if rows.count() == n:
            break
    return rows.agg(_together().alias("hash"))


def _together() -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda r: r["digest"]), ""), 256)
