"""Tables in versioned Parquet folders: each write makes a new version, readers follow the last committed one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """A table below ``path``. A version counts once its row in the log of commits is written, so a failed or
    repeated write leaves the table as it was."""

    LOG = "version long, folder string"

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _log(self) -> DataFrame:
        jvm = self.spark._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        if not log.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(log):
            return self.spark.createDataFrame([], self.LOG)
        return self.spark.read.schema(self.LOG).parquet(f"{self.path}/_commits")

    def version(self) -> int:
        return self._log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last; none before the first write."""
        log = self._log() if version is None else self._log().where(F.col("version") <= version)
        last = log.agg(F.max_by("folder", "version")).first()[0]
        return self.spark.createDataFrame([], self.schema) if last is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{last}")

    def overwrite(self, rows: DataFrame) -> int:
        version, folder = self.version() + 1, f"v-{uuid.uuid4().hex}"
        columns = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*columns).write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(version, folder)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/_commits")
        return version

    def upsert(self, rows: DataFrame, order: str) -> int:
        """Insert rows or replace those with equal keys; of several new rows with one key the last by ``order`` wins."""
        columns = [f.split()[0] for f in self.schema.split(", ")]
        new = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
        return self.overwrite(self.read().join(new, self.keys, "left_anti").unionByName(new))

    def replace_where(self, paths: DataFrame, column: str, rows: DataFrame) -> int:
        """Replace all rows whose ``column`` is among ``paths``: what is gone from them is deleted."""
        return self.overwrite(self.read().join(paths.select(F.col(paths.columns[0]).alias(column)).distinct(), column, "left_anti").unionByName(rows))

    def delete(self, keys: DataFrame) -> int:
        return self.overwrite(self.read().join(keys, self.keys, "left_anti"))
