"""Nearest-neighbour joins, reciprocal pairs and set operations on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.operators import knn
from twinlink.operators import metrics
from twinlink.operators import pairs as P
from workload import fixtures as fx
from workload.fixtures import NEAR_SQL, PAIRS_SQL, tidy


def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.knn_join(
        fx.d1_vectors(spark, sf_dir), fx.d2_vectors(spark, sf_dir), 10,
        query_id="d1_id", query_vec="vec", index_id="d2_id", index_vec="vec",
    )
    return tidy(found)


KNN_SQL = f"""WITH {NEAR_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY d1_id ORDER BY dist, d2_id) AS rank FROM near)
SELECT d1_id, d2_id, round(dist * dist, 6) AS sq_dist, rank FROM ranked WHERE rank <= 10"""


def reciprocal_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(knn.reciprocal_knn(fx.d1_vectors(spark, sf_dir), fx.d2_vectors(spark, sf_dir), 10))


RECIPROCAL_SQL = f"WITH {PAIRS_SQL} SELECT d1_id, d2_id, round(sq_dist, 6) AS sq_dist FROM pairs"


def pairs_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = fx.d1_vectors(spark, sf_dir), fx.d2_vectors(spark, sf_dir)
    there = knn.knn_join(a, b, 5, query_id="d1_id", query_vec="vec", index_id="d2_id", index_vec="vec")
    back = knn.knn_join(b, a, 5, query_id="d2_id", query_vec="vec", index_id="d1_id", index_vec="vec")
    return P.pairs_intersect(there, back)


INTERSECT_SQL = f"""WITH {NEAR_SQL}
SELECT d1_id, d2_id FROM near QUALIFY row_number() OVER (PARTITION BY d1_id ORDER BY dist, d2_id) <= 5
INTERSECT
SELECT d1_id, d2_id FROM near QUALIFY row_number() OVER (PARTITION BY d2_id ORDER BY dist, d1_id) <= 5"""


def id_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line pairs under internal ids, translated through the order and part tables."""
    lines = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d1_id"), F.col("l_partkey").alias("d2_id"))
    orders = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("internal_id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("source_id")
    )
    parts = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("internal_id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("source_id")
    )
    return P.id_translate(lines, orders, parts)


TRANSLATE_SQL = """SELECT 'o' || o_orderkey::VARCHAR AS d1_id, 'p' || p_partkey::VARCHAR AS d2_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


def group_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = P.with_position(fx.line_pairs(spark, sf_dir).withColumnRenamed("pos", "at"), ["at"])
    lists = P.group_candidates(placed.drop("at"))
    return lists.select("d1_id", F.col("part").cast("bigint").alias("part"), fx.ids("d2_ids").alias("d2_ids"))


GROUP_SQL = f"""WITH {fx.LINE_PAIRS_SQL}
SELECT d1_id::VARCHAR AS d1_id, 0::BIGINT AS part, string_agg(d2_id::VARCHAR, ',' ORDER BY pos) AS d2_ids
FROM line_pairs GROUP BY d1_id"""


def d2_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.d2_union_distinct(fx.line_pairs(spark, sf_dir))


def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.result_log(spark, sf_dir).select("model", "run_id", "d1_id").distinct()


def ids_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the ground truth without any confident answer."""
    sure = fx.result_log(spark, sf_dir).filter(F.col("result").isNotNull()).select("d1_id")
    return P.ids_except(fx.log_gt(spark, sf_dir).select("d1_id"), sure)


def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(P.candidate_stats(fx.line_pairs(spark, sf_dir)))


def reverse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reverse_pairs(fx.log_gt(spark, sf_dir))


def blocking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.pairs(spark, sf_dir)
    n_d1 = fx.d1_vectors(spark, sf_dir).agg(F.count("*")).scalar()
    n_d2 = fx.d2_vectors(spark, sf_dir).agg(F.count("*")).scalar()
    # The truth here is the nearest candidate in id order among all pairs of equal label, whether listed or not.
    label = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    d1 = label.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("d1_id"), "label")
    partner = label.filter("vec_id % 2 = 1").groupBy("label").agg(F.min("vec_id").alias("d2_id"))
    gt = d1.join(partner, "label").select("d1_id", "d2_id")
    return tidy(metrics.blocking_report(found.select("d1_id", "d2_id"), gt, n_d1, n_d2))


BLOCKING_REPORT_SQL = f"""WITH {PAIRS_SQL},
gt AS (
  SELECT a.vec_id AS d1_id, b.d2_id FROM embeddings a
  JOIN (SELECT label, min(vec_id) AS d2_id FROM embeddings WHERE vec_id % 2 = 1 GROUP BY label) b USING (label)
  WHERE a.vec_id % 2 = 0),
hits AS (SELECT count(*) AS n FROM pairs JOIN gt USING (d1_id, d2_id)),
sizes AS (SELECT (SELECT count(*) FROM pairs) AS p, (SELECT count(*) FROM gt) AS g, (SELECT count(*) FROM d1) AS n1,
          (SELECT count(*) FROM d2) AS n2)
SELECT p AS pairs, n AS true_pairs, round(n / g, 6) AS pair_completeness, round(n / p, 6) AS pair_quality,
       round(1 - p / (n1 * n2), 6) AS reduction_ratio FROM hits, sizes"""


QUERIES = {
    "knn_join": (knn_join, KNN_SQL),
    "reciprocal_knn": (reciprocal_knn, RECIPROCAL_SQL),
    "pairs_intersect": (pairs_intersect, INTERSECT_SQL),
    "id_translate": (id_translate, TRANSLATE_SQL),
    "group_candidates": (group_candidates, GROUP_SQL),
    "d2_union_distinct": (d2_union_distinct, "SELECT DISTINCT l_partkey::VARCHAR AS d2_id FROM lineitem"),
    "distinct_ids": (distinct_ids, f"WITH {fx.LOG_SQL} SELECT DISTINCT model, run_id, d1_id FROM log"),
    "ids_except": (
        ids_except,
        f"""WITH {fx.LOG_SQL}, {fx.LOG_GT_SQL}
SELECT d1_id FROM log_gt EXCEPT SELECT d1_id FROM log WHERE result IS NOT NULL""",
    ),
    "candidate_stats": (
        candidate_stats,
        f"""WITH {fx.LINE_PAIRS_SQL}, lists AS (SELECT d1_id, count(*) AS n FROM line_pairs GROUP BY d1_id)
SELECT (SELECT count(DISTINCT d2_id) FROM line_pairs) AS unique_d2_ids, max(n) AS max_neighbors FROM lists""",
    ),
    "reverse_pairs": (
        reverse_pairs,
        f"WITH {fx.LOG_GT_SQL} SELECT d2_id AS d1_id, d1_id AS d2_id FROM log_gt",
    ),
    "blocking_report": (blocking_report, BLOCKING_REPORT_SQL),
}
