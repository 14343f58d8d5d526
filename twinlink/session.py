"""Session set-up and the two ways a flow may cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "twinlink", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; every one of them can be overridden."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A skewed join is split even where that costs another shuffle further up.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, as named by the session.

    Only a local master may fall back to a temporary folder, since there every task runs on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="twinlink-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/twinlink/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the stage tables of this application, once no frame reads them any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and scan it back.

    Used where a second evaluation would be wrong or costly: behind judge and encoder calls, and before
    a step that reads the same rows twice. The table survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage.parquet")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
