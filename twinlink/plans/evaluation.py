"""Quality reports of judge runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.operators.metrics import evaluate_run
from twinlink.sources.tables import report_sink

# Column titles of the run report, in order.
REPORT_TITLES = {
    "model": "Model",
    "prompt_type": "Prompt Type",
    "run_id": "Run ID",
    "started_at": "Started At",
    "ended_at": "Ended At",
    "total_hours": "Total Hours",
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1": "F1",
}


def evaluation_report(log: DataFrame, gt: DataFrame) -> DataFrame:
    """All runs of a log, with the published column titles."""
    rows = evaluate_run(log, gt)
    return rows.select(*[F.col(c).alias(title) for c, title in REPORT_TITLES.items()])


def write_report(log: DataFrame, gt: DataFrame, path: str) -> None:
    report_sink(evaluation_report(log, gt), path)
