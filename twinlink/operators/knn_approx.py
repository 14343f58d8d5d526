"""Approximate k-nearest-neighbour join by random projections; ``knn.knn_join`` is the exact one."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlink.functions.vectors import l2_normalize, squared_distance
from twinlink.operators.knn import knn_join, limit_copies
from twinlink.schema import COSINE, EUCLIDEAN
from twinlink.session import materialise

#: Rows of the index, and queries against them, that set the width of the buckets.
SAMPLE_ROWS, SAMPLE_QUERIES = 2000, 100
#: Bucket width in distances to a near neighbour, and the number of hash tables.
WIDTH, TABLES = 4.0, 8


def lsh_knn_join(
    query: DataFrame,
    index: DataFrame,
    k: int = 10,
    *,
    query_id: str,
    query_vec: str,
    index_id: str,
    index_vec: str,
    metric: str = EUCLIDEAN,
    tables: int = TABLES,
    bucket_length: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """Near ``index`` rows of every ``query`` row as ``(query_id, index_id, sq_dist, rank)``, up to ``k`` for each.

    Vectors whose projections fall into one bucket in any of ``tables`` tables are candidates; every candidate is
    measured, so a distance is exact, and only a neighbour that shares no bucket can be missing. A query with fewer
    than ``k`` candidates is answered by the exact join instead. For the cosine metric vectors have unit length.

    Without ``bucket_length`` the width is set by a sample: ``WIDTH`` times the median distance of ``SAMPLE_QUERIES``
    queries to the neighbour in ``SAMPLE_ROWS`` index rows that corresponds to their k-th in the whole index. All rows
    are hashed and all rows are found, however wide the buckets are.
    """
    q = _standard(query, query_id, query_vec, metric)
    x = materialise(limit_copies(_standard(index, index_id, index_vec, metric), "id", "vec", k))
    width = bucket_length or _bucket_length(q, x, k)
    lsh = BucketedRandomProjectionLSH(inputCol="point", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed)
    # Fitting draws the directions and looks at the length of one vector only; an empty index has none.
    if x.isEmpty():
        return _exact(q, x, k, query_id, index_id)
    model = lsh.fit(x.limit(1).select(_point().alias("point")))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        rows = model.transform(df.withColumn("point", _point()))
        return rows.select(F.col("id").alias(name), F.posexplode("hashes").alias("table", "bucket"))

    # Ids meet first; a pair that shares several buckets is measured once.
    met = hashed(q, "q_id").join(hashed(x, "x_id"), ["table", "bucket"]).select("q_id", "x_id").distinct()
    vectors = met.join(q.select(F.col("id").alias("q_id"), F.col("vec").alias("v1")), "q_id")
    vectors = vectors.join(x.select(F.col("id").alias("x_id"), F.col("vec").alias("v2")), "x_id")
    near = materialise(_ranked(vectors.select("q_id", "x_id", squared_distance("v1", "v2").alias("sq_dist")), k, query_id, index_id))
    enough = near.filter(F.col("rank") == k).select(F.col(query_id).alias("id"))
    rest = materialise(q.join(enough, "id", "left_anti"))
    if rest.isEmpty():
        return near
    near = near.join(rest.select(F.col("id").alias(query_id)), query_id, "left_anti")
    return near.unionByName(_exact(rest, x, k, query_id, index_id))


def lsh_reciprocal_knn(
    d1: DataFrame, d2: DataFrame, k: int = 10, *, d1_id: str = "d1_id", d1_vec: str = "vec", d2_id: str = "d2_id", d2_vec: str = "vec",
    metric: str = EUCLIDEAN, **options,
) -> DataFrame:
    """Pairs that ``lsh_knn_join`` finds in both directions, as ``(d1_id, d2_id, sq_dist)``."""
    there = lsh_knn_join(d1, d2, k, query_id=d1_id, query_vec=d1_vec, index_id=d2_id, index_vec=d2_vec, metric=metric, **options)
    back = lsh_knn_join(d2, d1, k, query_id=d2_id, query_vec=d2_vec, index_id=d1_id, index_vec=d1_vec, metric=metric, **options)
    return there.select(d1_id, d2_id, "sq_dist").join(back.select(d1_id, d2_id), [d1_id, d2_id])


def _exact(q: DataFrame, x: DataFrame, k: int, query_id: str, index_id: str) -> DataFrame:
    return knn_join(
        q.select(F.col("id").alias(query_id), "vec"), x.select(F.col("id").alias(index_id), "vec"), k,
        query_id=query_id, query_vec="vec", index_id=index_id, index_vec="vec",
    )


def _standard(df: DataFrame, id_col: str, vec_col: str, metric: str) -> DataFrame:
    if metric not in (COSINE, EUCLIDEAN):
        raise ValueError(f"unknown metric: {metric}")
    vec = l2_normalize(vec_col) if metric == COSINE else F.col(vec_col)
    return df.select(F.col(id_col).alias("id"), vec.cast("array<double>").alias("vec"))


def _point() -> Column:
    return array_to_vector(F.col("vec"))


def _ranked(scored: DataFrame, k: int, query_id: str, index_id: str) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy("sq_dist", "x_id")
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("q_id").alias(query_id), F.col("x_id").alias(index_id), "sq_dist", "rank")


def _bucket_length(q: DataFrame, x: DataFrame, k: int) -> float:
    """A width by a bounded sample; the k-th neighbour in the whole index is about the k/10-th in a tenth of it."""
    total = x.count()
    some = lambda df, n: df.orderBy(F.xxhash64("id"), "id").limit(n)
    sample = some(x, SAMPLE_ROWS)
    at = max(1, round(k * min(1.0, SAMPLE_ROWS / max(total, 1))))
    near = _exact(some(q, SAMPLE_QUERIES), sample, at, "q_id", "x_id")
    median = near.filter(F.col("rank") == at).agg(F.median(F.sqrt("sq_dist"))).first()[0]
    return WIDTH * median if median else 1.0
