"""Quality of predicted pairs against the ground truth, for any number of runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.functions.times import minute_boundaries, seconds_between

RUN = ["model", "prompt_type", "run_id"]


def reverse_pairs(gt: DataFrame) -> DataFrame:
    return gt.select(F.col("d2_id").alias("d1_id"), F.col("d1_id").alias("d2_id"))


def gt_lookup(predicted: DataFrame, gt: DataFrame) -> DataFrame:
    """Predictions with the expected partner, null when the record has no ground truth."""
    return predicted.join(gt.select("d1_id", F.col("d2_id").alias("expected_d2_id")), "d1_id", "left")


def gt_unpredicted(predicted: DataFrame, gt: DataFrame) -> DataFrame:
    """Ground-truth records nobody predicted a partner for."""
    return gt.select("d1_id").join(predicted.select("d1_id").distinct(), "d1_id", "left_anti")


def pair_confusion(predicted: DataFrame, gt: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., tp, fp, fn)`` of predictions ``(by..., d1_id, d2_id)``.

    A prediction that equals the ground truth is a TP, another partner for a ground-truth record an FP, and a record
    without ground truth counts as nothing; repeated predictions count each time. FN are ground-truth records
    without any prediction. Repeats are added up before the first join, and both joins see one row per (d1, d2) or
    per d1, so a record with very many predictions makes no hot key.
    """
    by = by or []
    pairs = predicted.groupBy(*by, "d1_id", "d2_id").agg(F.count("*").alias("n"))
    correct = gt.select("d1_id", "d2_id", F.lit(True).alias("correct"))
    per_record = (
        pairs.join(correct, ["d1_id", "d2_id"], "left")
        .groupBy(*by, "d1_id")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("correct"), F.col("n")).otherwise(0)).alias("tp"))
    )
    total = gt.agg(F.count("*")).scalar()
    return (
        per_record.join(gt.select("d1_id", F.lit(1).alias("known")), "d1_id", "left")
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n") - F.col("tp"))), F.lit(0)).alias("fp"),
            F.count("known").alias("seen"),
        )
        .withColumn("fn", total - F.col("seen"))
        .drop("seen")
    )


def _percent(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0)) * 100


def pair_metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 in percent; a ratio over zero is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.withColumns(
        {
            "accuracy": _percent(tp, tp + fp + fn),
            "precision": _percent(tp, tp + fp),
            "recall": _percent(tp, tp + fn),
            "f1": _percent(2 * tp, 2 * tp + fp + fn),
        }
    )


def run_elapsed(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First and last answer of every run, and the hours between them counted in passed minute marks."""
    by = RUN if by is None else by
    return (
        log.groupBy(*by)
        .agg(F.min("inserted_at").alias("started_at"), F.max("inserted_at").alias("ended_at"))
        .withColumn("total_hours", minute_boundaries("started_at", "ended_at") / 60)
    )


def predictions(log: DataFrame) -> DataFrame:
    """The pairs a log asserts, whatever the answer status."""
    return log.filter(F.col("result").isNotNull()).select(*RUN, "d1_id", F.col("result").alias("d2_id"))


def evaluate_run(log: DataFrame, gt: DataFrame) -> DataFrame:
    """One report row per run: times and metrics. A run without predictions misses every ground-truth record."""
    confusion = pair_confusion(predictions(log), gt, RUN)
    total = gt.agg(F.count("*")).scalar()
    joined = run_elapsed(log).join(confusion, RUN, "left")
    filled = joined.withColumns(
        {
            "tp": F.coalesce("tp", F.lit(0)),
            "fp": F.coalesce("fp", F.lit(0)),
            "fn": F.coalesce(F.col("fn"), total),
        }
    )
    return pair_metrics(filled).drop("tp", "fp", "fn")


def blocking_report(pairs: DataFrame, gt: DataFrame, n_d1: Column, n_d2: Column) -> DataFrame:
    """Pair completeness, pair quality and reduction ratio of a candidate set.

    ``n_d1`` and ``n_d2`` are the record counts, as literals or scalar subqueries.
    """
    marked = pairs.join(gt.withColumn("true_pair", F.lit(1)), ["d1_id", "d2_id"], "left")
    counts = marked.agg(F.count("*").alias("pairs"), F.count("true_pair").alias("true_pairs"))
    total = gt.agg(F.count("*")).scalar()
    counts = counts.withColumns({"gt_pairs": total, "n_d1": n_d1, "n_d2": n_d2})
    space = F.col("n_d1").cast("double") * F.col("n_d2")
    return counts.select(
        "pairs",
        "true_pairs",
        F.try_divide("true_pairs", "gt_pairs").alias("pair_completeness"),
        F.try_divide("true_pairs", "pairs").alias("pair_quality"),
        (1 - F.try_divide("pairs", space)).alias("reduction_ratio"),
    )


def run_progress(pairs: DataFrame, log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many d1 records a run has answered, its pace and the time left at that pace."""
    by = RUN if by is None else by
    total = pairs.agg(F.count_distinct("d1_id")).scalar()
    done = log.groupBy(*by, "d1_id").agg(F.min("inserted_at").alias("lo"), F.max("inserted_at").alias("hi"))
    return (
        done.groupBy(*by)
        .agg(F.count("*").alias("processed"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("total", total)
        .withColumn("elapsed_seconds", seconds_between("lo", "hi"))
        .withColumn("seconds_per_record", F.col("elapsed_seconds") / F.col("processed"))
        .withColumn("remaining_seconds", (F.col("total") - F.col("processed")) * F.col("seconds_per_record"))
        .drop("lo", "hi", "total")
    )
