"""File scans and sinks, the result log and the embedding tables; every query writes below the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.plans.evaluation import write_report
from twinlink.session import scratch_path
from twinlink.sources import files as S
from twinlink.sources import tables as B
from workload import fixtures as fx
from workload.evaluation import JUDGED_SQL
from workload.fixtures import LINE_PAIRS_SQL, LOG_SQL, PAIRS_SQL, RECORDS_SQL, tidy

PART_COLUMNS = ["id", "p_name", "p_brand", "p_type", "p_size"]


def _write_csv(df: DataFrame, path: str, sep: str) -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def _part_file(spark: SparkSession, sf_dir: str, sep: str) -> str:
    path = scratch_path(spark, "D2/partclean.csv")
    _write_csv(fx.part_entities(spark, sf_dir), path, sep)
    return path


def scan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_entities(spark, _part_file(spark, sf_dir, "%"), PART_COLUMNS, sep="%")


def scan_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items as ground-truth rows in order of line, part and date; the last row of an order counts."""
    path = scratch_path(spark, "D2/gtclean.csv")
    rows = fx.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "D1", "l_partkey": "D2"})
    order = ["D1", "l_linenumber", "D2"]
    _write_csv(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("D1", "D2"), path, "|")
    return S.scan_ground_truth(spark, path, "|")


def _pairs_with_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.pairs(spark, sf_dir).select(
        F.col("d1_id").cast("string").alias("d1_id"), "pos", F.col("d2_id").cast("string").alias("d2_id")
    )


def sink_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists written as an object and read back, with lists of more than four in several entries."""
    path = scratch_path(spark, "pairs.json")
    S.sink_pairs(_pairs_with_positions(spark, sf_dir), path, list_rows=4)
    return S.scan_pairs_json(spark, path)


def scan_pairs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's parts, through a file."""
    from twinlink.operators.pairs import with_position

    lines = fx.line_pairs(spark, sf_dir).withColumnRenamed("pos", "at")
    path = scratch_path(spark, "pairs.json")
    S.sink_pairs(with_position(lines, ["at"]).drop("at"), path)
    return S.scan_pairs_json(spark, path)


def _write_part_records(spark: SparkSession, sf_dir: str, ids: DataFrame) -> str:
    parts = S.scan_entities(spark, _part_file(spark, sf_dir, "|"), PART_COLUMNS, with_position=True)
    path = scratch_path(spark, "d2_records.json")
    S.sink_records(parts, ids, path)
    return path


def sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the parts that any vector pair names, written and read back."""
    return S.scan_records_json(spark, _write_part_records(spark, sf_dir, _pairs_with_positions(spark, sf_dir).select("d2_id")))


def scan_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with their quotes and line breaks, through an object of texts."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    docs = docs.withColumn("row_pos", F.col("id"))
    path = scratch_path(spark, "records.json")
    S.sink_records(docs, docs.select("id"), path)
    return S.scan_records_json(spark, path).select("record_id", F.md5("text").alias("text_md5"))


def _logged(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "results")
    B.results_table(spark, path)
    B.results_append(fx.result_log(spark, sf_dir), path)
    return path


_LOG_COLUMNS = ["d1_id", "result", "request_status", "inserted_at", "prompt_type", "model", "run_id"]


def results_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log, through the table."""
    log = B.scan_results(spark, _logged(spark, sf_dir))
    return tidy(log.select(*_LOG_COLUMNS, fx.ids("d2_candidates_id").alias("d2_id")))


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creating an existing table keeps it; dropping a run keeps the other runs; force drops them all."""
    path = _logged(spark, sf_dir)

    def runs(state: str, log: DataFrame) -> DataFrame:
        return log.groupBy("model", "run_id").agg(F.count("*").alias("n")).withColumn("state", F.lit(state))

    from twinlink.session import materialise

    kept = materialise(runs("kept", B.results_table(spark, path)))
    B.drop_run(spark, path, "A", "F")
    dropped = materialise(runs("dropped", B.scan_results(spark, path)))
    forced = materialise(runs("forced", B.results_table(spark, path, force=True)))
    return kept.unionByName(dropped).unionByName(forced)


def predictions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.predictions_scan(B.scan_results(spark, _logged(spark, sf_dir)), "N", "MATCHING_PROMPT", "O")


def run_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.run_filter(B.scan_results(spark, _logged(spark, sf_dir)), "R", "MATCHING_PROMPT_ONLY", "F")
    return tidy(rows.select(*_LOG_COLUMNS))


def _embedded(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "embeddings")
    B.embeddings_table(spark, path)
    B.embeddings_append(fx.embedding_rows(spark, sf_dir), path)
    return path


def embeddings_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.scan_embeddings(spark, _embedded(spark, sf_dir))
    return tidy(rows.select("record_id", "dataset", "model", "created_at", F.posexplode("embeddings").alias("dim", "x")))


def embeddings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per model and data set after a second creation, which changes nothing."""
    table = B.embeddings_table(spark, _embedded(spark, sf_dir))
    return table.groupBy("model", "dataset").agg(F.count("*").alias("n"))


def embeddings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaled d2 vectors of the records that any pair names."""
    table = B.scan_embeddings(spark, _embedded(spark, sf_dir))
    wanted = _pairs_with_positions(spark, sf_dir).select("d2_id")
    rows = B.embeddings_of(table, "scaled", "d2", wanted)
    return tidy(rows.select("record_id", F.posexplode("embeddings").alias("dim", "x")))


def _task_embedded(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "task_embeddings")
    B.task_embeddings_table(spark, path)
    B.task_embeddings_append(fx.task_rows(spark, sf_dir, fx.pairs(spark, sf_dir)), path)
    return path


def _all_places(vector: str) -> Column:
    """A digest of all numbers of a vector, in millionths."""
    return F.md5(F.array_join(F.transform(vector, lambda x: F.floor(x.cast("double") * 1000000).cast("string")), ","))


_ALL_PLACES = "md5(array_to_string(list_transform(v, lambda x: floor(x * 1000000)::BIGINT), ','))"


def task_embeddings_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector by all its places."""
    rows = B.scan_task_embeddings(spark, _task_embedded(spark, sf_dir))
    places = [F.col("embeddings")[0].alias("first"), F.size("embeddings").alias("dim"), _all_places("embeddings").alias("places_md5")]
    return tidy(rows.select("d1_reference_id", "record_id", "is_d2", "model", "created_at", *places))


def task_embeddings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per d1 its own vector by all its places, the greatest of its candidates' digests, and how many candidates it has."""
    table = B.scan_task_embeddings(spark, _task_embedded(spark, sf_dir))
    d1 = fx.d1_vectors(spark, sf_dir).select(F.col("d1_id").cast("string").alias("d1_id"))
    rows = B.task_embeddings_of(table, "context", d1)
    own = F.max(F.when(~F.col("is_d2"), F.col("embeddings")[0]))
    digest = _all_places("embeddings")
    digests = [F.max(F.when(~F.col("is_d2"), digest)).alias("own_md5"), F.max(F.when(F.col("is_d2"), digest)).alias("last_md5")]
    return tidy(rows.groupBy("d1_reference_id").agg(own.alias("first"), *digests, F.count_if("is_d2").alias("candidates")))


def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run report as a delimited file, read back."""
    path = scratch_path(spark, "evaluation.csv")
    write_report(fx.result_log(spark, sf_dir), fx.log_gt(spark, sf_dir), path)
    rows = spark.read.option("header", True).csv(path)
    numbers = ["Total Hours", "Accuracy", "Precision", "Recall", "F1"]
    texts = [c for c in rows.columns if c not in numbers and not c.endswith("At")]
    return tidy(rows.select(*texts, *[F.col(c).cast("double").alias(c) for c in numbers]))


_TASK_SQL = f"""WITH {PAIRS_SQL}, rows AS (
  SELECT DISTINCT d1_id, d1_id AS record_id, false AS is_d2, embedding::DOUBLE[] AS v
  FROM pairs JOIN embeddings ON vec_id = d1_id
  UNION ALL
  SELECT d1_id, d2_id, true,
         list_transform(range(1, len(e2.embedding) + 1),
           lambda i: (e2.embedding[i]::DOUBLE + e1.embedding[i]::DOUBLE * ((d2_id % 5 + 1) / 4.0)::DOUBLE)::FLOAT::DOUBLE)
  FROM pairs JOIN embeddings e1 ON e1.vec_id = d1_id JOIN embeddings e2 ON e2.vec_id = d2_id)"""

_CELLS_SQL = f"WITH {PAIRS_SQL}, {fx.MODEL_VECTORS_SQL}, cells AS (SELECT *, unnest(range(len(v))) AS dim FROM vectors)"

QUERIES = {
    "scan_entities": (
        scan_entities,
        """SELECT p_partkey::VARCHAR AS id, p_name, nullif(p_brand, 'Brand#13') AS p_brand, p_type, p_size::VARCHAR AS p_size
FROM part""",
    ),
    "scan_ground_truth": (
        scan_ground_truth,
        """SELECT l_orderkey::VARCHAR AS d1_id, arg_max(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey)::VARCHAR AS d2_id
FROM lineitem GROUP BY l_orderkey""",
    ),
    "sink_pairs": (
        sink_pairs,
        f"WITH {PAIRS_SQL} SELECT d1_id::VARCHAR AS d1_id, pos, d2_id::VARCHAR AS d2_id FROM pairs",
    ),
    "scan_pairs_json": (
        scan_pairs_json,
        f"""WITH {LINE_PAIRS_SQL} SELECT d1_id::VARCHAR AS d1_id, d2_id::VARCHAR AS d2_id,
row_number() OVER (PARTITION BY d1_id ORDER BY pos) - 1 AS pos FROM line_pairs""",
    ),
    "sink_records": (
        sink_records,
        f"WITH {PAIRS_SQL}, {RECORDS_SQL} SELECT * FROM d2_records WHERE record_id IN (SELECT d2_id::VARCHAR FROM pairs)",
    ),
    "scan_records_json": (
        scan_records_json,
        "SELECT doc_id::VARCHAR AS record_id, md5(text) AS text_md5 FROM documents",
    ),
    "results_append": (
        results_append,
        f"WITH {LOG_SQL} SELECT {', '.join(_LOG_COLUMNS)}, d2_id FROM log",
    ),
    "results_table": (
        results_table,
        f"""WITH {LOG_SQL}, runs AS (SELECT model, run_id, count(*) AS n FROM log GROUP BY model, run_id)
SELECT *, 'kept' AS state FROM runs UNION ALL SELECT *, 'dropped' FROM runs WHERE NOT (model = 'A' AND run_id = 'F')""",
    ),
    "predictions_scan": (
        predictions_scan,
        f"""WITH {LOG_SQL} SELECT d1_id, result AS d2_id FROM log
WHERE result IS NOT NULL AND model = 'N' AND prompt_type = 'MATCHING_PROMPT' AND run_id = 'O'""",
    ),
    "run_filter": (
        run_filter,
        f"""WITH {LOG_SQL} SELECT {', '.join(_LOG_COLUMNS)} FROM log
WHERE model = 'R' AND prompt_type = 'MATCHING_PROMPT_ONLY' AND run_id = 'F'""",
    ),
    "embeddings_append": (
        embeddings_append,
        f"""{_CELLS_SQL} SELECT vec_id::VARCHAR AS record_id, CASE WHEN vec_id % 2 = 0 THEN 'd1' ELSE 'd2' END AS dataset, model,
TIMESTAMP '2024-01-01' + to_seconds(vec_id) AS created_at, dim, round(v[dim + 1], 6) AS x FROM cells""",
    ),
    "embeddings_table": (
        embeddings_table,
        f"""WITH {fx.MODEL_VECTORS_SQL}
SELECT model, CASE WHEN vec_id % 2 = 0 THEN 'd1' ELSE 'd2' END AS dataset, count(*) AS n FROM vectors GROUP BY ALL""",
    ),
    "embeddings_scan": (
        embeddings_scan,
        f"""{_CELLS_SQL} SELECT vec_id::VARCHAR AS record_id, dim, round(v[dim + 1], 6) AS x FROM cells
WHERE model = 'scaled' AND vec_id IN (SELECT d2_id FROM pairs)""",
    ),
    "task_embeddings_append": (
        task_embeddings_append,
        f"""{_TASK_SQL} SELECT d1_id::VARCHAR AS d1_reference_id, record_id::VARCHAR AS record_id, is_d2, 'context' AS model,
TIMESTAMP '2024-01-01' + to_seconds(d1_id) AS created_at, round(v[1], 6) AS first, len(v) AS dim,
{_ALL_PLACES} AS places_md5 FROM rows""",
    ),
    "task_embeddings_scan": (
        task_embeddings_scan,
        f"""{_TASK_SQL} SELECT d1_id::VARCHAR AS d1_reference_id, round(max(v[1]) FILTER (WHERE NOT is_d2), 6) AS first,
max({_ALL_PLACES}) FILTER (WHERE NOT is_d2) AS own_md5, max({_ALL_PLACES}) FILTER (WHERE is_d2) AS last_md5,
count(*) FILTER (WHERE is_d2) AS candidates FROM rows GROUP BY d1_id""",
    ),
    "report_sink": (
        report_sink,
        f"""{JUDGED_SQL} SELECT model AS "Model", prompt_type AS "Prompt Type", run_id AS "Run ID", total_hours AS "Total Hours",
accuracy AS "Accuracy", precision AS "Precision", recall AS "Recall", f1 AS "F1"
FROM elapsed JOIN metrics USING (model, prompt_type, run_id)""",
    ),
}
