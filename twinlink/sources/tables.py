"""The result log and the embedding tables: partitioned parquet with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.schema import EMBEDDINGS, RESULTS, TASK_EMBEDDINGS

RESULTS_BY = ["model", "run_id"]
EMBEDDINGS_BY = ["model", "dataset"]
TASK_EMBEDDINGS_BY = ["model"]


def _create(spark: SparkSession, path: str, schema: T.StructType, by: list[str], force: bool) -> None:
    empty = spark.createDataFrame([], schema)
    # A static overwrite drops what the path held; otherwise an existing table is left alone.
    mode = "overwrite" if force else "ignore"
    empty.write.option("partitionOverwriteMode", "static").mode(mode).partitionBy(*by).parquet(path)


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _append(rows: DataFrame, path: str, schema: T.StructType, by: list[str]) -> None:
    """Append rows in the table's types; a null in a required column fails the write."""

    def value(f: T.StructField):
        kind = f.dataType.simpleString()
        c = F.col(f.name).cast(kind)
        if f.nullable:
            return c.alias(f.name)
        return F.coalesce(c, F.raise_error(F.lit(f"{f.name} must not be null")).cast(kind)).alias(f.name)

    rows.select(*[value(f) for f in schema]).write.mode("append").partitionBy(*by).parquet(path)


def _drop(spark: SparkSession, path: str, schema: T.StructType, values: dict[str, str]) -> None:
    """Remove one partition: the folder in which its rows' files stand, as the scan names it. Without rows there is none."""
    rows = _scan(spark, path, schema)
    for column, value in values.items():
        rows = rows.where(F.col(column) == value)
    folders = rows.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct().collect()
    jvm = spark.sparkContext._jvm
    for row in folders:  # one, as the values name a partition
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row.folder))
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def results_table(spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    """Create the result log if it is absent (or anew, without any run, on ``force``) and scan it."""
    _create(spark, path, RESULTS, RESULTS_BY, force)
    return scan_results(spark, path)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, RESULTS)


def results_append(rows: DataFrame, path: str) -> None:
    _append(rows, path, RESULTS, RESULTS_BY)


def drop_run(spark: SparkSession, path: str, model: str, run_id: str) -> None:
    """Forget one run of one model; all others stay."""
    _drop(spark, path, RESULTS, {"model": model, "run_id": run_id})


def embeddings_table(spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    _create(spark, path, EMBEDDINGS, EMBEDDINGS_BY, force)
    return scan_embeddings(spark, path)


def scan_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, EMBEDDINGS)


def embeddings_append(rows: DataFrame, path: str) -> None:
    _append(rows, path, EMBEDDINGS, EMBEDDINGS_BY)


def task_embeddings_table(spark: SparkSession, path: str, force: bool = False) -> DataFrame:
    _create(spark, path, TASK_EMBEDDINGS, TASK_EMBEDDINGS_BY, force)
    return scan_task_embeddings(spark, path)


def scan_task_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, TASK_EMBEDDINGS)


def task_embeddings_append(rows: DataFrame, path: str) -> None:
    _append(rows, path, TASK_EMBEDDINGS, TASK_EMBEDDINGS_BY)


def embeddings_of(table: DataFrame, model: str, dataset: str, ids: DataFrame | None = None) -> DataFrame:
    """Vectors of one model and data set, of the wanted ids only; both filters prune partitions."""
    rows = table.filter((F.col("model") == model) & (F.col("dataset") == dataset))
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias("record_id")).distinct()
        rows = rows.join(wanted, "record_id", "left_semi")
    return rows.select("record_id", "embeddings")


def task_embeddings_of(table: DataFrame, model: str, d1_ids: DataFrame | None = None) -> DataFrame:
    rows = table.filter(F.col("model") == model)
    if d1_ids is not None:
        wanted = d1_ids.select(F.col(d1_ids.columns[0]).alias("d1_reference_id")).distinct()
        rows = rows.join(wanted, "d1_reference_id", "left_semi")
    return rows.select("d1_reference_id", "record_id", "is_d2", "embeddings")


def predictions_scan(log: DataFrame, model: str, prompt_type: str, run_id: str) -> DataFrame:
    """Asserted pairs of one run. Repeats stay, and the answer status does not matter."""
    rows = run_filter(log, model, prompt_type, run_id).filter(F.col("result").isNotNull())
    return rows.select("d1_id", F.col("result").alias("d2_id"))


def run_filter(log: DataFrame, model: str, prompt_type: str, run_id: str) -> DataFrame:
    return log.filter(
        (F.col("run_id") == run_id) & (F.col("model") == model) & (F.col("prompt_type") == prompt_type)
    )


def report_sink(report: DataFrame, path: str, sep: str = ",") -> None:
    """Replace the report at ``path``; every part file has the header."""
    report.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
