"""Ranking each record's own candidates by vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlink.functions.vectors import score
from twinlink.session import materialise

# A key with more rows than this is ordered across tasks instead of inside one.
HOT_ROWS = 1_000_000
# Longest list put into one row.
LIST_ROWS = 1000


def rank_within(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sizes: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``rank``, the row number within ``keys`` by ``order`` (which must be total).

    Keys of ordinary size use a window. The rows of larger keys are range-partitioned by (keys, order), so that one
    key spreads over many tasks; each task numbers its slice and adds the sizes of the key's earlier slices.
    ``sizes`` is a cheaper frame with the same rows per key, if there is one, to count the keys on.
    """
    hot = (sizes if sizes is not None else df).groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = hot.filter(F.col("_n") > hot_rows).select(*keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    if hot.isEmpty():
        return df.withColumn("rank", F.row_number().over(window))

    hot = materialise(hot)
    cold = df.join(hot, keys, "left_anti").withColumn("rank", F.row_number().over(window))
    by = [F.col(c) for c in keys] + order
    slices = materialise(
        df.join(hot, keys, "left_semi")
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slices.groupBy(*keys, "_slice")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    rank = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")
    ranked = slices.join(starts, [*keys, "_slice"]).withColumn("rank", rank)
    return cold.unionByName(ranked.select(*cold.columns))


def score_candidates(
    pairs: DataFrame, d1_vectors: DataFrame, d2_vectors: DataFrame, metric: str, on: list[str] | None = None
) -> DataFrame:
    """Score every listed pair: ``(on..., d1_id, d2_id, pos, score)``.

    The vector frames are ``(on..., record_id, embeddings)``; only listed pairs are ever scored.
    """
    on = on or []
    d1 = d1_vectors.select(*on, F.col("record_id").alias("d1_id"), F.col("embeddings").alias("_v1"))
    d2 = d2_vectors.select(*on, F.col("record_id").alias("d2_id"), F.col("embeddings").alias("_v2"))
    # Distinct pairs meet their d1 vector first; AQE splits a d1 or d2 that is listed very often.
    joined = pairs.join(d1, "d1_id", "left").join(d2, [*on, "d2_id"], "left")
    joined = joined.withColumns({"_v1": present("_v1", "d1_id"), "_v2": present("_v2", "d2_id")})
    return joined.select(*on, "d1_id", "d2_id", "pos", score(metric, "_v1", "_v2").alias("score"))


def present(vector: str, side: str) -> Column:
    """The vector of a listed record; one that has none fails the query instead of leaving the list."""
    message = F.concat(F.lit(f"no vector for {side} "), F.col(side).cast("string"))
    return F.coalesce(F.col(vector), F.raise_error(message).cast("array<float>"))


def best_first() -> list[Column]:
    """Higher score first, then the earlier list position."""
    return [F.col("score").desc(), F.col("pos").asc()]


def candidate_rank(
    pairs: DataFrame,
    d1_vectors: DataFrame,
    d2_vectors: DataFrame,
    metric: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Candidates of every d1 record, best first: ``(d1_id, d2_id, pos, score, rank)``."""
    scored = score_candidates(pairs, d1_vectors, d2_vectors, metric)
    return rank_within(scored, ["d1_id"], best_first(), sizes=pairs, hot_rows=hot_rows)


def task_scores(pairs: DataFrame, task_vectors: DataFrame, metric: str) -> DataFrame:
    """Scores from vectors made in the context of one d1 record.

    A d2 record has one vector per d1 it was embedded with, so the d2 side is found by (d1 reference, d2 id).
    """
    d1 = task_vectors.filter(~F.col("is_d2")).select(F.col("d1_reference_id").alias("d1_id"), F.col("embeddings").alias("_v1"))
    d2 = task_vectors.filter("is_d2").select(
        F.col("d1_reference_id").alias("d1_id"), F.col("record_id").alias("d2_id"), F.col("embeddings").alias("_v2")
    )
    joined = pairs.join(d2, ["d1_id", "d2_id"], "left").join(d1, "d1_id", "left")
    joined = joined.withColumns({"_v1": present("_v1", "d1_id"), "_v2": present("_v2", "d2_id")})
    return joined.select("d1_id", "d2_id", "pos", score(metric, "_v1", "_v2").alias("score"))


def candidate_rank_task(
    pairs: DataFrame, task_vectors: DataFrame, metric: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    scored = task_scores(pairs, task_vectors, metric)
    return rank_within(scored, ["d1_id"], best_first(), sizes=pairs, hot_rows=hot_rows)


def top1_prediction(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best candidate per d1, by partial aggregation instead of a sort."""
    best = F.max_by("d2_id", F.struct(F.col("score"), -F.col("pos")))
    return scored.groupBy(*(by or []), "d1_id").agg(best.alias("predicted_d2_id"), F.max("score").alias("score"))


def order_candidates(ranked: DataFrame, keys: list[str] | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """Ranked rows as arrays, ``(keys..., part, sorted_d2_ids, scores)``.

    A list longer than ``list_rows`` continues in the next ``part``, so no row grows with the data.
    """
    keys = keys or ["d1_id"]
    rows = F.array_sort(F.collect_list(F.struct("rank", "d2_id", "score")))
    return (
        ranked.withColumn("part", F.floor((F.col("rank") - 1) / list_rows).cast("int"))
        .groupBy(*keys, "part")
        .agg(rows.alias("rows"))
        .select(*keys, "part", F.col("rows.d2_id").alias("sorted_d2_ids"), F.col("rows.score").alias("scores"))
    )
