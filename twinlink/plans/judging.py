"""A judge run over the pairs that are not in the result log yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.operators.judge import Judge, Options, final_rows, run_mode
from twinlink.operators.pairs import attach_texts
from twinlink.operators.resume import resume_results
from twinlink.schema import FAILED, MATCHING
from twinlink.session import materialise
from twinlink.sources.tables import drop_run, results_append, results_table, scan_results

# Commits of one run at most; larger runs commit more pairs at a time.
MAX_COMMITS = 1000


class JudgeOutage(RuntimeError):
    """More requests failed than a run allows. What was answered is in the log; the next call asks the rest."""


def run_judge(
    mode: str,
    pairs: DataFrame,
    d1_records: DataFrame,
    d2_records: DataFrame,
    judge: Judge,
    prompt_type: str,
    options: Options,
    log_path: str,
    restart: bool = False,
) -> DataFrame:
    """Judge what is left of a run and append it; a second call finds nothing to do. Returns the log.

    The pairs are judged in portions of about ``options.commit_pairs``, each appended to the log before the next one is
    asked. A run that ends half-way keeps its portions, and the next call asks what the log does not hold. A portion
    holds whole lists, as one answer is about a list; matching answers are about pairs, so there any pair may be in
    any portion. A list or pair with a request that failed is not logged and therefore asked again; beyond
    ``options.failure_limit`` of them the run ends with ``JudgeOutage``.

    ``restart`` forgets this run first and leaves all others alone.
    """
    spark = pairs.sparkSession
    if restart:
        drop_run(spark, log_path, options.model, options.run_id)
    log = results_table(spark, log_path)
    todo = resume_results(pairs, log, prompt_type, options.run_id, options.model)
    key = ["d1_id", "d2_id"] if mode == MATCHING else ["d1_id"]
    commits = min(-(-todo.count() // options.commit_pairs), MAX_COMMITS)
    texts = attach_texts(todo, d1_records, d2_records)
    if commits > 1:
        texts = materialise(texts.withColumn("portion", F.pmod(F.xxhash64(*key), F.lit(commits)).cast("int")), ["portion"])
    failed = 0
    for n in range(commits):
        portion = texts.filter(F.col("portion") == n).drop("portion") if commits > 1 else texts
        # A table: the log and the count of failures must not ask twice.
        rows = materialise(run_mode(mode, portion, judge, prompt_type, options))
        results_append(final_rows(rows), log_path)
        failed += rows.filter(F.col("request_status") == FAILED).count()
        if failed > options.failure_limit:
            raise JudgeOutage(f"{failed} requests failed; run {options.run_id} of {options.model} is incomplete")
    return scan_results(spark, log_path)
