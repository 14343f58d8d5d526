"""Work that is still to do: what a log or an embedding table already holds is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.functions.prompts import mode_of, prompt_group
from twinlink.schema import MATCHING


def processed(log: DataFrame, prompt_type: str, run_id: str, model: str) -> DataFrame:
    """What a run has answered: ``(d1_id, d2_id)`` for matching prompts, ``d1_id`` for the others.

    Any variant of the prompt's family counts; the run id tells variants apart.
    """
    rows = log.filter(
        (F.col("run_id") == run_id) & (F.col("model") == model) & (F.col("prompt_group") == prompt_group(prompt_type))
    )
    if mode_of(prompt_type) == MATCHING:
        return rows.select("d1_id", F.get("d2_candidates_id", F.lit(0)).alias("d2_id")).distinct()
    return rows.select("d1_id").distinct()


def resume_results(todo: DataFrame, log: DataFrame, prompt_type: str, run_id: str, model: str) -> DataFrame:
    done = processed(log, prompt_type, run_id, model)
    return todo.join(done, done.columns, "left_anti")


def resume_embeddings(records: DataFrame, embeddings: DataFrame, model: str, dataset: str) -> DataFrame:
    """Records without a vector of this model and data set."""
    done = embeddings.filter((F.col("model") == model) & (F.col("dataset") == dataset)).select("record_id").distinct()
    return records.join(done, "record_id", "left_anti")


def resume_task_embeddings(pairs: DataFrame, task_embeddings: DataFrame, model: str) -> DataFrame:
    """Pairs whose d1 has not been embedded with its candidates yet."""
    done = task_embeddings.filter(F.col("model") == model).select(F.col("d1_reference_id").alias("d1_id")).distinct()
    return pairs.join(done, "d1_id", "left_anti")
