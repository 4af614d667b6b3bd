"""Session defaults, and the shared folder where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "weftline") -> SparkSession:
    """A local session with adaptive execution and UTC time; on a cluster pass your own instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master, whose executor is the driver, gets a temporary folder; any other is an error,
    as its executors couldn't read what the driver's machine holds.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {context.master} share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._weftline_path = path
    return again


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if ``materialize`` has written it, or else what that writes."""
    return df if getattr(df, "_weftline_path", None) else materialize(df, name)


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote for these tables, once nothing is computed from them any more."""
    for df in tables:
        if path := getattr(df, "_weftline_path", None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors collect their garbage: only then does a heap that earlier work let grow go back to the machine,
    where Python workers need the room. A task for each core, so every executor has some, if none is busy."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    folder = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(folder.rglob("*.py")):
            out.write(source, source.relative_to(folder.parent))
    context.addPyFile(str(archive))
    context._weftline_shipped = True
