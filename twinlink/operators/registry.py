"""Lookups of models, prompt types and data-set files for tables that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.functions.prompts import mode_of
from twinlink.schema import CHAT_MODELS, DATASET_FILES, EMBEDDING_MODELS, PROMPTS_BY_MODE


def models(spark: SparkSession) -> DataFrame:
    """``(model_key, kind, name, family)``; fixed at a few dozen rows."""
    rows = [(k, "embedding", n, f) for k, n, f in EMBEDDING_MODELS] + [(k, "chat", n, None) for k, n in CHAT_MODELS]
    return spark.createDataFrame(rows, "model_key string, kind string, name string, family string")


def _checked(found: Column, value: Column, strict: bool, message: Column) -> Column:
    return F.when(found, value).otherwise(F.raise_error(message).cast("string") if strict else F.lit(None))


def model_registry(df: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """Add the published ``name`` and loader ``family`` of ``model_key``; an unknown key fails when ``strict``.

    An embedding model without a loader family is unknown too, since nothing could embed with it.
    """
    known = models(df.sparkSession).filter(F.col("kind") == kind).drop("kind")
    joined = df.join(F.broadcast(known), "model_key", "left")
    usable = F.col("name").isNotNull()
    if kind == "embedding" and strict:
        usable = usable & F.col("family").isNotNull()
    message = F.concat(F.lit("unsupported model: "), F.coalesce("model_key", F.lit("null")))
    return joined.withColumn("name", _checked(usable, F.col("name"), strict, message))


def check_prompt_mode(mode: str, prompt_type: str) -> None:
    if mode not in PROMPTS_BY_MODE:
        raise ValueError(f"unknown mode: {mode}")
    if mode_of(prompt_type) != mode:
        raise ValueError(f"{mode} accepts {', '.join(PROMPTS_BY_MODE[mode])}, not {prompt_type}")


def validate_prompt_mode(jobs: DataFrame) -> DataFrame:
    """The rows of a job table ``(mode, prompt_type, ...)`` whose prompt does not belong to the mode."""
    allowed = [(m, p) for m, prompts in PROMPTS_BY_MODE.items() for p in prompts]
    table = jobs.sparkSession.createDataFrame(allowed, "mode string, prompt_type string")
    return jobs.join(F.broadcast(table), ["mode", "prompt_type"], "left_anti")


def dataset_manifest(files: DataFrame, strict: bool = True) -> DataFrame:
    """Add the expected left, right and ground-truth file names of ``dataset``; an unknown one fails when strict."""
    rows = [(d, *[f + "clean.csv" for f in names]) for d, names in DATASET_FILES.items()]
    known = files.sparkSession.createDataFrame(rows, "dataset string, d1_file string, d2_file string, gt_file string")
    joined = files.join(F.broadcast(known), "dataset", "left")
    message = F.concat(F.lit("unknown data set: "), F.coalesce("dataset", F.lit("null")))
    return joined.withColumn("d1_file", _checked(F.col("d1_file").isNotNull(), F.col("d1_file"), strict, message))
