"""What stands in for entity data on the test tables, once for Spark and once as SQL.

Vectors: the two halves of ``embeddings`` (even and odd ids) are the two record sets; all rows are used.
Pairs: reciprocal 10-nearest between them; a ground-truth pair is the first candidate with the same label.
Line pairs: every order with its parts, in line order. Log: every line item is one logged answer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.functions.text import serialize_record
from twinlink.operators.knn import reciprocal_knn
from twinlink.operators.pairs import with_position
from twinlink.schema import NO_RESPONSE, VALID
from twinlink.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint and doubles to six places, as in the SQL."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema])


def ids(c: str) -> Column:
    """A list of ids as one text."""
    return F.array_join(F.col(c).cast("array<string>"), ",")


# --- vectors -------------------------------------------------------------------------------------


def d1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0")
    return rows.select(F.col("vec_id").alias("d1_id"), F.col("embedding").alias("vec"))


def d2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 1")
    return rows.select(F.col("vec_id").alias("d2_id"), F.col("embedding").alias("vec"))


NEAR_SQL = """
d1 AS (SELECT vec_id AS d1_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0),
d2 AS (SELECT vec_id AS d2_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
near AS (SELECT d1_id, d2_id, list_distance(d1.v, d2.v) AS dist FROM d1, d2)"""

PAIRS_SQL = (
    NEAR_SQL
    + """,
both_ways AS (
  SELECT *, row_number() OVER (PARTITION BY d1_id ORDER BY dist, d2_id) AS r1,
         row_number() OVER (PARTITION BY d2_id ORDER BY dist, d1_id) AS r2
  FROM near),
pairs AS (
  SELECT d1_id, d2_id, dist * dist AS sq_dist, row_number() OVER (PARTITION BY d1_id ORDER BY d2_id) - 1 AS pos
  FROM both_ways WHERE r1 <= 10 AND r2 <= 10)"""
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(d1_id, d2_id, sq_dist, pos)``, positions by d2 id."""
    found = reciprocal_knn(d1_vectors(spark, sf_dir), d2_vectors(spark, sf_dir), 10)
    return materialise(with_position(materialise(found), ["d2_id"]))


def ranking_gt(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> DataFrame:
    """Per d1 its smallest candidate id with the same label."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    l1 = label.select(F.col("vec_id").alias("d1_id"), F.col("label").alias("l1"))
    l2 = label.select(F.col("vec_id").alias("d2_id"), F.col("label").alias("l2"))
    same = candidates.join(l1, "d1_id").join(l2, "d2_id").filter("l1 = l2")
    return same.groupBy("d1_id").agg(F.min("d2_id").alias("d2_id"))


GT_SQL = """
gt AS (
  SELECT d1_id, min(d2_id) AS d2_id FROM pairs
  JOIN embeddings e1 ON e1.vec_id = d1_id JOIN embeddings e2 ON e2.vec_id = d2_id
  WHERE e1.label = e2.label GROUP BY d1_id)"""

MODELS = ("base", "scaled")


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the embedding table: two models, the second with d2 vectors stretched by 1, 2 or 3, so that cosine and
    Euclidean order differ; created one second apart."""
    e = table(spark, sf_dir, "embeddings")
    stretched = F.transform(
        F.col("embedding"), lambda x: (x * F.when(F.col("vec_id") % 2 == 1, 1 + F.col("vec_id") % 3).otherwise(1)).cast("float")
    )
    vectors = F.array(
        F.struct(F.lit(MODELS[0]).alias("model"), F.col("embedding").alias("embeddings")),
        F.struct(F.lit(MODELS[1]).alias("model"), stretched.alias("embeddings")),
    )
    rows = e.select("vec_id", F.explode(vectors).alias("m"))
    return rows.select(
        F.col("vec_id").cast("string").alias("record_id"),
        F.when(F.col("vec_id") % 2 == 0, "d1").otherwise("d2").alias("dataset"),
        "m.embeddings",
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id")).alias("created_at"),
        "m.model",
    )


MODEL_VECTORS_SQL = """
vectors AS (
  SELECT vec_id, 'base' AS model, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL
  SELECT vec_id, 'scaled', CASE WHEN vec_id % 2 = 0 THEN embedding::DOUBLE[]
    ELSE list_transform(embedding, lambda x: (x * (1 + vec_id % 3))::FLOAT)::DOUBLE[] END FROM embeddings)"""

SCORES_SQL = """
scores AS (
  SELECT m1.model, d1_id, d2_id, pos, list_cosine_similarity(m1.v, m2.v) AS cosine,
         1 / (1 + list_distance(m1.v, m2.v) * list_distance(m1.v, m2.v)) AS euclidian
  FROM pairs JOIN vectors m1 ON m1.vec_id = d1_id JOIN vectors m2 ON m2.vec_id = d2_id AND m2.model = m1.model)"""


def task_rows(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> DataFrame:
    """Rows for the task-embedding table: a d2 vector in the context of d1 is a weighted sum of both."""
    e = table(spark, sf_dir, "embeddings")
    v1 = e.select(F.col("vec_id").alias("d1_id"), F.col("embedding").alias("v1"))
    v2 = e.select(F.col("vec_id").alias("d2_id"), F.col("embedding").alias("v2"))
    d1 = candidates.select("d1_id").distinct().join(v1, "d1_id")
    d1 = d1.select("d1_id", F.col("d1_id").alias("record_id"), F.lit(False).alias("is_d2"), F.col("v1").alias("embeddings"))
    weight = (F.col("d2_id") % 5 + 1) / 4.0
    both = candidates.select("d1_id", "d2_id").join(v1, "d1_id").join(v2, "d2_id")
    d2 = both.select(
        "d1_id",
        F.col("d2_id").alias("record_id"),
        F.lit(True).alias("is_d2"),
        F.zip_with("v1", "v2", lambda x, y: (y.cast("double") + x.cast("double") * weight).cast("float")).alias("embeddings"),
    )
    rows = d1.unionByName(d2)
    return rows.select(
        F.col("d1_id").cast("string").alias("d1_reference_id"),
        F.col("record_id").cast("string").alias("record_id"),
        "is_d2",
        "embeddings",
        F.timestamp_seconds(F.lit(1704067200) + F.col("d1_id")).alias("created_at"),
        F.lit("context").alias("model"),
    )


TASK_SCORES_SQL = """
context AS (
  SELECT d1_id, d2_id, pos, e1.embedding::DOUBLE[] AS v1,
         list_transform(list_zip(e1.embedding, e2.embedding), lambda p: (p[2]::DOUBLE + p[1]::DOUBLE * ((d2_id % 5 + 1) / 4.0)::DOUBLE)::FLOAT)::DOUBLE[] AS v2
  FROM pairs JOIN embeddings e1 ON e1.vec_id = d1_id JOIN embeddings e2 ON e2.vec_id = d2_id),
task_scores AS (
  SELECT d1_id, d2_id, pos, list_cosine_similarity(v1, v2) AS cosine,
         1 / (1 + list_distance(v1, v2) * list_distance(v1, v2)) AS euclidian FROM context)"""


# --- records and candidate lists -------------------------------------------------------------------


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = serialize_record(["o_orderstatus", "o_orderpriority", "o_custkey"])
    return o.select(F.col("o_orderkey").cast("string").alias("record_id"), text.alias("text"))


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an entity table; one brand is turned into missing values."""
    p = table(spark, sf_dir, "part")
    brand = F.nullif("p_brand", F.lit("Brand#13"))
    return p.select(F.col("p_partkey").alias("id"), "p_name", brand.alias("p_brand"), "p_type", "p_size")


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = serialize_record(["p_name", "p_brand", "p_type", "p_size"])
    return part_entities(spark, sf_dir).select(F.col("id").cast("string").alias("record_id"), text.alias("text"))


RECORDS_SQL = """
d1_records AS (
  SELECT o_orderkey::VARCHAR AS record_id, o_orderstatus || ' ' || o_orderpriority || ' ' || o_custkey::VARCHAR AS text
  FROM orders),
d2_records AS (
  SELECT p_partkey::VARCHAR AS record_id, p_name || ' ' || coalesce(nullif(p_brand, 'Brand#13'), 'nan') || ' ' || p_type
         || ' ' || p_size::VARCHAR AS text FROM part)"""


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(d1_id, pos, d2_id)``: an order and its distinct parts, in order of line number, then part."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("d1_id"),
        (F.col("line").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("pos"),
        F.col("l_partkey").cast("string").alias("d2_id"),
    )


LINE_PAIRS_SQL = """
line_pairs AS (
  SELECT l_orderkey AS d1_id, l_partkey AS d2_id, min(l_linenumber)::BIGINT * 1000000000 + l_partkey AS pos
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""


# --- the judge -------------------------------------------------------------------------------------


def formula_judge(questions: pd.DataFrame) -> list[str | None]:
    """A judge whose answers SQL can repeat, in the words a model might use."""
    out: list[str | None] = []
    if "a_id" in questions:
        d1, a, b = (questions[c].astype("int64").to_numpy() for c in ("d1_id", "a_id", "b_id"))
        prefers_a = (d1 * 7 + a * 13) % 101 > (d1 * 7 + b * 13) % 101
        out += ["The answer is: Record A." if first else "Record B" for first in prefers_a.tolist()]
    elif "d2_id" not in questions:
        for d1, n in zip(questions["d1_id"], questions["n_candidates"]):
            out.append("[99999]" if int(d1) % 11 == 0 else f"The answer is: [{(int(d1) * 5 + 3) % (n + 1)}]")
    else:
        for d1, d2 in zip(questions["d1_id"], questions["d2_id"]):
            s = int(d1) + int(d2)
            out.append(None if s % 7 == 0 else ("Yes.", "No, they differ", "It depends")[s % 3])
    return out


MATCH_SQL = """
answers AS (
  SELECT d1_id, d2_id, pos,
         CASE WHEN (d1_id + d2_id) % 7 = 0 THEN 'NO_RESPONSE' WHEN (d1_id + d2_id) % 3 = 2 THEN 'INVALID' ELSE 'VALID' END
           AS status,
         CASE WHEN (d1_id + d2_id) % 7 <> 0 AND (d1_id + d2_id) % 3 = 0 THEN d2_id END AS result
  FROM line_pairs)"""


# --- the result log --------------------------------------------------------------------------------


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one logged answer."""
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey").cast("string")
    sure = F.col("l_quantity") >= 10
    return li.select(
        F.col("l_orderkey").cast("string").alias("d1_id"),
        F.array(part).alias("d2_candidates_id"),
        F.when(sure, part).alias("result"),
        F.when(sure, VALID).otherwise(F.lit(NO_RESPONSE)).alias("request_status"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_partkey"))).alias("inserted_at"),
        F.when(F.col("l_discount") < 0.05, "MATCHING_PROMPT").otherwise(F.lit("MATCHING_PROMPT_ONLY")).alias("prompt_type"),
        F.lit("MATCHING_PROMPT").alias("prompt_group"),
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("run_id"),
    )


LOG_SQL = """
log AS (
  SELECT l_orderkey::VARCHAR AS d1_id, l_partkey::VARCHAR AS d2_id,
         CASE WHEN l_quantity >= 10 THEN l_partkey::VARCHAR END AS result,
         CASE WHEN l_quantity >= 10 THEN 'VALID' ELSE 'NO_RESPONSE' END AS request_status,
         l_shipdate + to_seconds(l_partkey) AS inserted_at,
         CASE WHEN l_discount < 0.05 THEN 'MATCHING_PROMPT' ELSE 'MATCHING_PROMPT_ONLY' END AS prompt_type,
         l_returnflag AS model, l_linestatus AS run_id
  FROM lineitem)"""


def log_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the part of its last line with status F; orders without such a line have no ground truth."""
    li = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'")
    last = F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey"))
    gt = li.groupBy("l_orderkey").agg(last.alias("d2"))
    # A ground truth is a table of its own, read several times by the metrics.
    return materialise(gt.select(F.col("l_orderkey").cast("string").alias("d1_id"), F.col("d2").cast("string").alias("d2_id")))


LOG_GT_SQL = """
log_gt AS (
  SELECT l_orderkey::VARCHAR AS d1_id, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey)::VARCHAR AS d2_id
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey)"""
