"""Similarity scores, candidate ranking, top-k quality, pooling and generation times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.functions.vectors import cosine_score as cosine
from twinlink.functions.vectors import euclidean_score as euclidean
from twinlink.functions.vectors import l2_normalize as normalize
from twinlink.operators import pairs as P
from twinlink.operators import pooling, rank, timing, topk
from twinlink.plans import ranking as plan
from twinlink.schema import COSINE, EUCLIDEAN
from twinlink.session import materialise
from workload import fixtures as fx
from workload.fixtures import GT_SQL, MODEL_VECTORS_SQL, PAIRS_SQL, SCORES_SQL, TASK_SCORES_SQL, tidy

SCALED = fx.MODELS[1]


def _vectors(spark: SparkSession, sf_dir: str, side: str, model: str = SCALED) -> DataFrame:
    rows = fx.embedding_rows(spark, sf_dir).filter((F.col("dataset") == side) & (F.col("model") == model))
    return rows.select(F.col("record_id").cast("bigint").alias("record_id"), "embeddings")


def _scored(spark: SparkSession, sf_dir: str, candidates: DataFrame, metric: str) -> DataFrame:
    return rank.score_candidates(
        candidates, _vectors(spark, sf_dir, "d1"), _vectors(spark, sf_dir, "d2"), metric
    )


def _score_rows(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """Both vectors of every candidate pair, scored."""
    d1 = _vectors(spark, sf_dir, "d1").toDF("d1_id", "v1")
    d2 = _vectors(spark, sf_dir, "d2").toDF("d2_id", "v2")
    both = fx.pairs(spark, sf_dir).join(d1, "d1_id").join(d2, "d2_id")
    return tidy(both.select("d1_id", "d2_id", score("v1", "v2").alias("score")))


def cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_rows(spark, sf_dir, cosine)


def euclidean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_rows(spark, sf_dir, euclidean)


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.embedding_rows(spark, sf_dir).filter(F.col("model") == SCALED)
    return tidy(rows.select(F.col("record_id"), F.posexplode(normalize("embeddings")).alias("dim", "x")))


BASE_SQL = f"WITH {PAIRS_SQL}, {MODEL_VECTORS_SQL}, {SCORES_SQL}"
SCALED_SQL = f"{BASE_SQL}, scaled AS (SELECT * FROM scores WHERE model = 'scaled')"

NORMALIZE_SQL = f"""WITH {MODEL_VECTORS_SQL},
one AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm, unnest(range(len(v))) AS dim
        FROM vectors WHERE model = 'scaled')
SELECT vec_id::VARCHAR AS record_id, dim, round(v[dim + 1] / norm, 6) AS x FROM one"""


def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of every candidate by both metrics."""
    found = fx.pairs(spark, sf_dir)
    d1, d2 = _vectors(spark, sf_dir, "d1"), _vectors(spark, sf_dir, "d2")
    ranked = [
        rank.candidate_rank(found, d1, d2, m).select(F.lit(m).alias("metric"), "d1_id", "d2_id", "score", "rank")
        for m in (COSINE, EUCLIDEAN)
    ]
    return tidy(ranked[0].unionByName(ranked[1]))


def _ranks_sql(source: str) -> str:
    parts = [
        f"""SELECT '{m}' AS metric, d1_id, d2_id, round({m}, 6) AS score,
            row_number() OVER (PARTITION BY d1_id ORDER BY {m} DESC, pos) AS rank FROM {source}"""
        for m in (COSINE, EUCLIDEAN)
    ]
    return " UNION ALL ".join(parts)


def candidate_rank_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.pairs(spark, sf_dir)
    task = materialise(fx.task_rows(spark, sf_dir, found))
    texts = found.select(F.col("d1_id").cast("string").alias("d1_id"), F.col("d2_id").cast("string").alias("d2_id"), "pos")
    ranked = [
        rank.candidate_rank_task(texts, task, m).select(
            F.lit(m).alias("metric"), F.col("d1_id").cast("bigint").alias("d1_id"),
            F.col("d2_id").cast("bigint").alias("d2_id"), "score", "rank",
        )
        for m in (COSINE, EUCLIDEAN)
    ]
    return tidy(ranked[0].unionByName(ranked[1]))


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.pairs(spark, sf_dir)
    ranked = rank.candidate_rank(found, _vectors(spark, sf_dir, "d1"), _vectors(spark, sf_dir, "d2"), EUCLIDEAN)
    lists = rank.order_candidates(ranked)
    return tidy(lists.select("d1_id", "part", fx.ids("sorted_d2_ids").alias("sorted_d2_ids"), F.size("scores").alias("n")))


def top1_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rank.top1_prediction(_scored(spark, sf_dir, fx.pairs(spark, sf_dir), EUCLIDEAN)))


def topk_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.pairs(spark, sf_dir)
    scored = materialise(_scored(spark, sf_dir, found, EUCLIDEAN))
    return tidy(topk.topk_confusion(scored, fx.ranking_gt(spark, sf_dir, found)))


CONFUSION_SQL = """
placed AS (SELECT *, row_number() OVER (PARTITION BY model, metric, d1_id ORDER BY score DESC, pos) AS rank FROM long_scores),
hits AS (
  SELECT model, metric, p.d1_id, count(*) AS n, min(CASE WHEN p.d2_id = gt.d2_id THEN rank END) AS hit
  FROM placed p JOIN gt ON p.d1_id = gt.d1_id GROUP BY model, metric, p.d1_id),
confusion AS (
  SELECT model, metric, k, count(*) FILTER (WHERE hit <= k) AS tp,
         sum(CASE WHEN hit <= k THEN least(k, n) - 1 ELSE k END)::BIGINT AS fp
  FROM hits, (SELECT unnest(range(1, 6)) AS k) GROUP BY model, metric, k),
report AS (
  SELECT model, metric, k, tp / (SELECT count(*) FROM gt) AS recall, tp / nullif(tp + fp, 0) AS precision FROM confusion),
quality AS (SELECT *, 2 * recall * precision / nullif(recall + precision, 0) AS f1 FROM report)"""
LONG_SQL = f"""{BASE_SQL}, {GT_SQL},
long_scores AS (
  SELECT model, 'cosine' AS metric, d1_id, d2_id, pos, cosine AS score FROM scores
  UNION ALL SELECT model, 'euclidian', d1_id, d2_id, pos, euclidian FROM scores),
{CONFUSION_SQL}"""


def topk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: blocking, ranking by cosine, and the quality of the first five places."""
    found = fx.pairs(spark, sf_dir)
    scored = materialise(_scored(spark, sf_dir, found, COSINE))
    return tidy(topk.topk_report(scored, fx.ranking_gt(spark, sf_dir, found)))


def unmatched_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.pairs(spark, sf_dir)
    return topk.unmatched_d1(found, fx.ranking_gt(spark, sf_dir, found))


def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models and a task model, each with both metrics, as one job with one wide row per experiment."""
    found = fx.pairs(spark, sf_dir)
    texts = found.select(
        F.lit("D2").alias("dataset"), F.col("d1_id").cast("string").alias("d1_id"), F.col("d2_id").cast("string").alias("d2_id"), "pos"
    )
    gt = materialise(
        fx.ranking_gt(spark, sf_dir, found).select(
            F.lit("D2").alias("dataset"), F.col("d1_id").cast("string").alias("d1_id"), F.col("d2_id").cast("string").alias("d2_id")
        )
    )
    jobs = [("D2", model, metric, False) for model in fx.MODELS for metric in (COSINE, EUCLIDEAN)]
    jobs += [("D2", "context", metric, True) for metric in (COSINE, EUCLIDEAN)]
    embeddings = fx.embedding_rows(spark, sf_dir).withColumnRenamed("dataset", "side").withColumn("source", F.lit("D2"))
    task = materialise(fx.task_rows(spark, sf_dir, found)).withColumn("source", F.lit("D2"))
    scored = plan.experiment_scores(texts, embeddings, plan.grid_table(spark, jobs), task)
    return tidy(plan.experiment_grid(scored, gt))


_WIDE = ", ".join(
    f"round(max({m}) FILTER (WHERE k = {k}), 6) AS top_{k}_{m}" for k in range(1, 6) for m in ("recall", "precision", "f1")
)
GRID_SQL = f"""{BASE_SQL}, {TASK_SCORES_SQL}, {GT_SQL},
long_scores AS (
  SELECT model, 'cosine' AS metric, d1_id, d2_id, pos, cosine AS score FROM scores
  UNION ALL SELECT model, 'euclidian', d1_id, d2_id, pos, euclidian FROM scores
  UNION ALL SELECT 'context', 'cosine', d1_id, d2_id, pos, cosine FROM task_scores
  UNION ALL SELECT 'context', 'euclidian', d1_id, d2_id, pos, euclidian FROM task_scores),
{CONFUSION_SQL}
SELECT 'D2' AS dataset, model, metric, model = 'context' AS use_task, {_WIDE} FROM quality GROUP BY model, metric"""


def id_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts named by line items against the customers' and suppliers' id ranges: both directions miss."""
    lines = fx.line_pairs(spark, sf_dir)
    d1 = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"))
    d2 = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"))
    return tidy(P.id_coverage_check(lines, d1, d2))


COVERAGE_SQL = """WITH want1 AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
want2 AS (SELECT DISTINCT l_partkey AS id FROM lineitem),
have1 AS (SELECT DISTINCT c_custkey AS id FROM customer), have2 AS (SELECT DISTINCT o_orderkey AS id FROM orders)
SELECT 'd1' AS side, (SELECT count(*) FROM want1 WHERE id NOT IN (SELECT id FROM have1)) AS missing,
       (SELECT count(*) FROM have1 WHERE id NOT IN (SELECT id FROM want1)) AS surplus
UNION ALL
SELECT 'd2', (SELECT count(*) FROM want2 WHERE id NOT IN (SELECT id FROM have2)),
       (SELECT count(*) FROM have2 WHERE id NOT IN (SELECT id FROM want2))"""


def vector_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(pooling.vector_dim(fx.embedding_rows(spark, sf_dir)))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors to a record, four records to a batch; odd batches are padded on the left, even ones on the right."""
    e = fx.table(spark, sf_dir, "embeddings")
    record = F.floor(F.col("vec_id") / 10).cast("bigint")
    rows = e.select(record.alias("record_id"), (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("vec"))
    batch = F.floor(F.col("record_id") / 4).cast("bigint")
    real = 3 + F.col("record_id") % 7
    mask = F.when(batch % 2 == 1, F.col("pos") >= 10 - real).otherwise(F.col("pos") < real)
    return rows.withColumns({"batch_id": batch, "mask": mask.cast("int")})


TOKENS_SQL = """tokens AS (
  SELECT *, CASE WHEN batch_id % 2 = 1 THEN pos >= 10 - real ELSE pos < real END::INT AS mask
  FROM (SELECT vec_id // 10 AS record_id, vec_id % 10 AS pos, vec_id // 40 AS batch_id, 3 + (vec_id // 10) % 7 AS real,
               embedding::DOUBLE[] AS vec FROM embeddings))"""


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.mean_pool(_tokens(spark, sf_dir))
    return tidy(pooled.select("record_id", F.posexplode("embeddings").alias("dim", "x")))


def last_token_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.last_token_pool(_tokens(spark, sf_dir))
    return tidy(pooled.select("record_id", F.posexplode("embeddings").alias("dim", "x")))


LAST_TOKEN_SQL = f"""WITH {TOKENS_SQL},
ends AS (SELECT batch_id, record_id, sum(mask) AS n, max(pos) AS last, arg_max(mask, pos) AS last_mask FROM tokens
         GROUP BY batch_id, record_id),
kind AS (SELECT batch_id, min(last_mask) = 1 AS left_padded FROM ends GROUP BY batch_id),
picked AS (
  SELECT t.record_id, t.vec FROM tokens t JOIN ends USING (record_id) JOIN kind ON kind.batch_id = t.batch_id
  WHERE t.pos = CASE WHEN left_padded THEN last ELSE n - 1 END)
SELECT record_id, dim, round(vec[dim + 1], 6) AS x FROM (SELECT *, unnest(range(len(vec))) AS dim FROM picked)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("ts").alias("created_at"))


DURATION_SQL = "CASE WHEN s < 3600 THEN printf('%.2f minutes', s / 60) ELSE printf('%.2f hours', s / 3600) END"


def embedding_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.embedding_span(_series(spark, sf_dir))


SPAN_SQL = f"""SELECT model, {DURATION_SQL} AS generation_time FROM (
  SELECT event_type AS model, date_diff('microseconds', min(ts), max(ts)) / 1e6 AS s FROM events GROUP BY event_type)"""


def active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(timing.active_time(_series(spark, sf_dir)))


ACTIVE_SQL = f"""WITH stamps AS (SELECT DISTINCT event_type AS model, ts FROM events),
gaps AS (
  SELECT model, row_number() OVER w - 1 AS i, date_diff('microseconds', lag(ts) OVER w, ts) / 1e6 AS gap
  FROM stamps WINDOW w AS (PARTITION BY model ORDER BY ts)),
products AS (
  SELECT model, CASE WHEN gap > 3600 THEN 0 ELSE gap END AS gap,
         sum(CASE WHEN gap > 3600 THEN ln(1 + 1 / i) ELSE 0 END) OVER (PARTITION BY model ORDER BY i) AS log_p
  FROM gaps WHERE i > 0),
totals AS (SELECT model, exp(max(log_p)) * sum(gap * exp(-log_p)) AS s FROM products GROUP BY model)
SELECT model, round(s, 6) AS active_seconds, {DURATION_SQL} AS generation_time FROM totals"""


QUERIES = {
    "candidate_rank": (candidate_rank, f"{SCALED_SQL} {_ranks_sql('scaled')}"),
    "candidate_rank_task": (candidate_rank_task, f"WITH {PAIRS_SQL}, {TASK_SCORES_SQL} {_ranks_sql('task_scores')}"),
    "cosine_score": (cosine_score, f"{SCALED_SQL} SELECT d1_id, d2_id, round(cosine, 6) AS score FROM scaled"),
    "euclidean_score": (euclidean_score, f"{SCALED_SQL} SELECT d1_id, d2_id, round(euclidian, 6) AS score FROM scaled"),
    "l2_normalize": (l2_normalize, NORMALIZE_SQL),
    "order_candidates": (
        order_candidates,
        f"""{SCALED_SQL} SELECT d1_id, 0::BIGINT AS part, string_agg(d2_id::VARCHAR, ',' ORDER BY euclidian DESC, pos)
AS sorted_d2_ids, count(*) AS n FROM scaled GROUP BY d1_id""",
    ),
    "top1_prediction": (
        top1_prediction,
        f"""{SCALED_SQL} SELECT d1_id, d2_id AS predicted_d2_id, round(euclidian, 6) AS score FROM scaled
QUALIFY row_number() OVER (PARTITION BY d1_id ORDER BY euclidian DESC, pos) = 1""",
    ),
    "topk_confusion": (
        topk_confusion,
        f"{LONG_SQL} SELECT k, tp, fp FROM confusion WHERE model = 'scaled' AND metric = 'euclidian'",
    ),
    "topk_report": (
        topk_report,
        f"""{LONG_SQL} SELECT k, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1
FROM quality WHERE model = 'scaled' AND metric = 'cosine'""",
    ),
    "unmatched_d1": (
        unmatched_d1,
        f"WITH {PAIRS_SQL}, {GT_SQL} SELECT DISTINCT d1_id FROM pairs WHERE d1_id NOT IN (SELECT d1_id FROM gt)",
    ),
    "experiment_grid": (experiment_grid, GRID_SQL),
    "id_coverage_check": (id_coverage_check, COVERAGE_SQL),
    "vector_dim": (
        vector_dim,
        f"WITH {MODEL_VECTORS_SQL} SELECT model, max(len(v)) AS dim FROM vectors GROUP BY model",
    ),
    "mean_pool": (
        mean_pool,
        f"""WITH {TOKENS_SQL}, cells AS (SELECT record_id, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM tokens)
SELECT record_id, dim, round(avg(x), 6) AS x FROM cells GROUP BY record_id, dim""",
    ),
    "last_token_pool": (last_token_pool, LAST_TOKEN_SQL),
    "embedding_span": (embedding_span, SPAN_SQL),
    "active_time": (active_time, ACTIVE_SQL),
}
