"""Top-k quality of ranked candidates against the ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlink.operators.rank import best_first


def topk_confusion(scored: DataFrame, gt: DataFrame, top_k: int = 5, by: list[str] | None = None) -> DataFrame:
    """``(by..., k, tp, fp)`` for k = 1..top_k over the d1 records that have a ground truth.

    A hit within the first k of n candidates counts one TP and min(k, n) - 1 FP; a miss counts k FP.
    Only the first ``top_k`` candidates leave a map task, and list lengths are plain counts. A ground truth that
    carries some of the ``by`` columns (a data set, say) is matched on them.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    by = by or []
    shared = _shared(gt, by)
    window = Window.partitionBy(*by, "d1_id").orderBy(*best_first())
    first = scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_k)
    hits = first.join(gt, [*shared, "d1_id", "d2_id"]).groupBy(*by, "d1_id").agg(F.min("rank").alias("hit"))
    lists = scored.groupBy(*by, "d1_id").agg(F.count("*").alias("n"))
    judged = lists.join(gt.select(*shared, "d1_id"), [*shared, "d1_id"], "left_semi").join(hits, [*by, "d1_id"], "left")
    k = F.explode(F.sequence(F.lit(1), F.lit(top_k)))
    hit = F.coalesce(F.col("hit") <= F.col("k"), F.lit(False))
    return (
        judged.withColumn("k", k)
        .groupBy(*by, "k")
        .agg(
            F.count_if(hit).alias("tp"),
            F.sum(F.when(hit, F.least("k", "n") - 1).otherwise(F.col("k"))).alias("fp"),
        )
    )


def _shared(gt: DataFrame, by: list[str]) -> list[str]:
    return [c for c in by if c in gt.columns]


def topk_report(scored: DataFrame, gt: DataFrame, top_k: int = 5, by: list[str] | None = None) -> DataFrame:
    """``(by..., k, recall, precision, f1)``; recall is over all ground-truth rows, a ratio over zero is null."""
    shared = _shared(gt, by or [])
    confusion = topk_confusion(scored, gt, top_k, by)
    if shared:
        confusion = confusion.join(gt.groupBy(*shared).agg(F.count("*").alias("total")), shared)
    else:
        confusion = confusion.withColumn("total", gt.agg(F.count("*")).scalar())
    recall = F.try_divide("tp", F.col("total"))
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    return (
        confusion.withColumns({"recall": recall, "precision": precision})
        .withColumn(
            "f1", F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision"))
        )
        .drop("tp", "fp", "total")
    )


def widen_report(report: DataFrame, by: list[str], top_k: int = 5) -> DataFrame:
    """One row per ``by`` with columns ``top_{k}_{recall,precision,f1}``."""
    wide = report.groupBy(*by).pivot("k", list(range(1, top_k + 1)))
    wide = wide.agg(*[F.first(m).alias(m) for m in ("recall", "precision", "f1")])
    names = {f"{k}_{m}": f"top_{k}_{m}" for k in range(1, top_k + 1) for m in ("recall", "precision", "f1")}
    return wide.withColumnsRenamed(names)


def unmatched_d1(pairs: DataFrame, gt: DataFrame) -> DataFrame:
    """d1 records that have candidates but no ground truth."""
    return pairs.select("d1_id").distinct().join(gt, "d1_id", "left_anti")
