"""Run logs against a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.operators import metrics as M
from workload import fixtures as fx
from workload.fixtures import LOG_GT_SQL, LOG_SQL, tidy


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.predictions(fx.result_log(spark, sf_dir))


def gt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gt_lookup(_predicted(spark, sf_dir), fx.log_gt(spark, sf_dir))


def gt_unpredicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gt_unpredicted(_predicted(spark, sf_dir), fx.log_gt(spark, sf_dir))


def pair_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.pair_confusion(_predicted(spark, sf_dir), fx.log_gt(spark, sf_dir), M.RUN))


def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    confusion = M.pair_confusion(_predicted(spark, sf_dir), fx.log_gt(spark, sf_dir), M.RUN)
    return tidy(M.pair_metrics(confusion).drop("tp", "fp", "fn"))


def run_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.run_elapsed(fx.result_log(spark, sf_dir)))


def evaluate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.evaluate_run(fx.result_log(spark, sf_dir), fx.log_gt(spark, sf_dir)))


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = M.run_progress(fx.line_pairs(spark, sf_dir), fx.result_log(spark, sf_dir))
    times = [c for c in progress.columns if "seconds" in c]
    return tidy(progress.withColumns({c: F.round(c, 3) for c in times}))


JUDGED_SQL = f"""WITH {LOG_SQL}, {LOG_GT_SQL},
predicted AS (SELECT model, prompt_type, run_id, d1_id, result AS d2_id FROM log WHERE result IS NOT NULL),
judged AS (SELECT p.*, g.d2_id AS expected FROM predicted p LEFT JOIN log_gt g ON g.d1_id = p.d1_id),
confusion AS (
  SELECT model, prompt_type, run_id, count(*) FILTER (WHERE d2_id = expected) AS tp,
         count(*) FILTER (WHERE d2_id <> expected) AS fp,
         (SELECT count(*) FROM log_gt) - count(DISTINCT d1_id) FILTER (WHERE expected IS NOT NULL) AS fn
  FROM judged GROUP BY model, prompt_type, run_id),
metrics AS (
  SELECT model, prompt_type, run_id,
         round(coalesce(tp / nullif(tp + fp + fn, 0), 0) * 100, 6) AS accuracy,
         round(coalesce(tp / nullif(tp + fp, 0), 0) * 100, 6) AS precision,
         round(coalesce(tp / nullif(tp + fn, 0), 0) * 100, 6) AS recall,
         round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 100, 6) AS f1
  FROM confusion),
elapsed AS (
  SELECT model, prompt_type, run_id, min(inserted_at) AS started_at, max(inserted_at) AS ended_at,
         round(date_diff('minute', min(inserted_at), max(inserted_at)) / 60.0, 6) AS total_hours
  FROM log GROUP BY model, prompt_type, run_id)"""

PROGRESS_SQL = f"""WITH {LOG_SQL},
runs AS (
  SELECT model, prompt_type, run_id, count(DISTINCT d1_id) AS processed,
         date_diff('microseconds', min(inserted_at), max(inserted_at)) / 1e6 AS s
  FROM log GROUP BY model, prompt_type, run_id)
SELECT model, prompt_type, run_id, processed, round(s, 3) AS elapsed_seconds,
       round(s / processed, 3) AS seconds_per_record,
       round(((SELECT count(DISTINCT l_orderkey) FROM lineitem) - processed) * (s / processed), 3) AS remaining_seconds
FROM runs"""

QUERIES = {
    "gt_lookup": (
        gt_lookup,
        f"{JUDGED_SQL} SELECT model, prompt_type, run_id, d1_id, d2_id, expected AS expected_d2_id FROM judged",
    ),
    "gt_unpredicted": (
        gt_unpredicted,
        f"{JUDGED_SQL} SELECT d1_id FROM log_gt WHERE d1_id NOT IN (SELECT d1_id FROM predicted)",
    ),
    "pair_confusion": (pair_confusion, f"{JUDGED_SQL} SELECT * FROM confusion"),
    "pair_metrics": (pair_metrics, f"{JUDGED_SQL} SELECT * FROM metrics"),
    "run_elapsed": (run_elapsed, f"{JUDGED_SQL} SELECT * FROM elapsed"),
    "evaluate_run": (
        evaluate_run,
        f"{JUDGED_SQL} SELECT * FROM elapsed JOIN metrics USING (model, prompt_type, run_id)",
    ),
    "run_progress": (run_progress, PROGRESS_SQL),
}
