"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import shared_dir

#: White space of the word rule: space, and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: fixes folds by id alone."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text, null as no text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def window_hashes(found: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` words, in order; none if there are fewer words."""
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    starts = F.when(F.size(found) >= width, F.sequence(F.lit(1), F.size(found) - (width - 1)))
    each = lambda own: F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(own, i, F.lit(width))))
    return let(hashes, each)
