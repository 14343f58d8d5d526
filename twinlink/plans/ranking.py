"""All ranking experiments in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.functions.vectors import cosine_score, euclidean_score
from twinlink.operators.rank import present
from twinlink.operators.timing import active_time
from twinlink.operators.topk import topk_report, unmatched_d1, widen_report
from twinlink.schema import COSINE, EUCLIDEAN
from twinlink.session import materialise

EXPERIMENT = ["dataset", "model", "metric", "use_task"]


def grid_table(spark: SparkSession, jobs: list[tuple[str, str, str, bool]]) -> DataFrame:
    """The experiments to run as ``(dataset, model, metric, use_task)``."""
    return spark.createDataFrame(jobs, "dataset string, model string, metric string, use_task boolean")


def _scores(joined: DataFrame, metrics: list[str]) -> DataFrame:
    """Each pair is read once and scored by all metrics that are asked for."""
    of = {COSINE: cosine_score, EUCLIDEAN: euclidean_score}
    vectors = joined.withColumns({"_v1": present("_v1", "d1_id"), "_v2": present("_v2", "d2_id")})
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), of[m]("_v1", "_v2").alias("score")) for m in metrics])
    rows = vectors.select("dataset", "model", "use_task", "d1_id", "d2_id", "pos", F.explode(scores).alias("s"))
    return rows.select("dataset", "model", "use_task", "d1_id", "d2_id", "pos", "s.metric", "s.score")


def experiment_scores(
    pairs: DataFrame, embeddings: DataFrame, grid: DataFrame, task_embeddings: DataFrame | None = None
) -> DataFrame:
    """Scores of every experiment in ``grid``; ``pairs`` is ``(dataset, d1_id, d2_id, pos)``.

    ``embeddings`` is ``(source, side, record_id, embeddings, model)`` with the data set as ``source`` and d1 or d2
    as ``side``; ``task_embeddings`` is the task table with a ``source`` column.

    The grid, a few dozen rows, is read first: only its data sets, models and metrics are scanned, joined and scored. A
    listed pair without a vector in one of its experiments fails the query.
    """
    jobs = [tuple(r) for r in grid.select(*EXPERIMENT).distinct().collect()]
    unknown = sorted({m for _, _, m, _ in jobs} - {COSINE, EUCLIDEAN})
    if unknown:
        raise ValueError(f"unknown metric: {unknown[0]}")
    if any(task for *_, task in jobs) and task_embeddings is None:
        raise ValueError("the grid has experiments with task vectors, but there are none")
    plain = [_plain_scores(pairs, embeddings, *part) for part in _by_metrics(jobs, False)]
    task = [_task_scores(pairs, task_embeddings, *part) for part in _by_metrics(jobs, True)]
    out = None
    for part in plain + task:
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the grid is empty")
    return out


def _by_metrics(jobs: list[tuple], use_task: bool) -> list[tuple[list[tuple[str, str]], list[str]]]:
    """The (dataset, model) pairs of the grid that are to be scored by the same metrics."""
    asked: dict[tuple[str, str], set[str]] = {}
    for dataset, model, metric, task in jobs:
        if task == use_task:
            asked.setdefault((dataset, model), set()).add(metric)
    groups: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for key, metrics in sorted(asked.items()):
        groups.setdefault(tuple(sorted(metrics)), []).append(key)
    return [(keys, list(metrics)) for metrics, keys in groups.items()]


def _wanted(table: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """The rows of listed data sets and models; the filter prunes the partitions of a stored table."""
    datasets, models = sorted({d for d, _ in keys}), sorted({m for _, m in keys})
    return table.filter(F.col("source").isin(datasets) & F.col("model").isin(models)).withColumnRenamed("source", "dataset")


def _asked_pairs(pairs: DataFrame, keys: list[tuple[str, str]], use_task: bool) -> DataFrame:
    models = F.broadcast(pairs.sparkSession.createDataFrame(keys, "dataset string, model string"))
    return pairs.join(models, "dataset").withColumn("use_task", F.lit(use_task))


def _plain_scores(pairs: DataFrame, embeddings: DataFrame, keys: list[tuple[str, str]], metrics: list[str]) -> DataFrame:
    rows = _wanted(embeddings, keys)

    def side(name: str, vec: str) -> DataFrame:
        own = rows.filter(F.col("side") == name)
        return own.select("dataset", "model", F.col("record_id").alias(f"{name}_id"), F.col("embeddings").alias(vec))

    joined = _asked_pairs(pairs, keys, False).join(side("d1", "_v1"), ["dataset", "model", "d1_id"], "left")
    return _scores(joined.join(side("d2", "_v2"), ["dataset", "model", "d2_id"], "left"), metrics)


def _task_scores(pairs: DataFrame, task_embeddings: DataFrame, keys: list[tuple[str, str]], metrics: list[str]) -> DataFrame:
    rows = _wanted(task_embeddings, keys).withColumnRenamed("d1_reference_id", "d1_id")
    d1 = rows.filter(~F.col("is_d2")).select("dataset", "model", "d1_id", F.col("embeddings").alias("_v1"))
    d2 = rows.filter("is_d2").select("dataset", "model", "d1_id", F.col("record_id").alias("d2_id"), F.col("embeddings").alias("_v2"))
    joined = _asked_pairs(pairs, keys, True).join(d2, ["dataset", "model", "d1_id", "d2_id"], "left")
    return _scores(joined.join(d1, ["dataset", "model", "d1_id"], "left"), metrics)


def experiment_grid(scored: DataFrame, gt: DataFrame, top_k: int = 5) -> DataFrame:
    """One wide quality row per experiment; the scores are written once, as the report reads them twice."""
    return widen_report(topk_report(materialise(scored), gt, top_k, by=EXPERIMENT), EXPERIMENT, top_k)


def ranking_report(scored: DataFrame, gt: DataFrame, pairs: DataFrame, embeddings: DataFrame, top_k: int = 5) -> DataFrame:
    """The wide rows with unmatched d1 records and generation times."""
    unmatched = unmatched_d1(pairs, gt).agg(F.count("*")).scalar()
    times = active_time(embeddings).select("model", "generation_time")
    return experiment_grid(scored, gt, top_k).withColumn("d1_without_match", unmatched).join(times, "model", "left")
