"""Judge runs, comparison sorts and embedding generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.operators import embed as E
from twinlink.operators import judge as J
from twinlink.operators import resume
from twinlink.operators.judge import Options
from twinlink.schema import COMPARING, MATCHING, SELECTING
from twinlink.session import materialise
from workload import fixtures as fx
from workload.fixtures import LINE_PAIRS_SQL, MATCH_SQL, RECORDS_SQL, formula_judge, tidy
from workload.texts import attach_texts

OPTIONS = Options(model="formula", run_id="8192_max_run", max_tokens=8192, retry_wait=0.0)


def _log(rows: DataFrame) -> DataFrame:
    """Log rows without their clock time, lists as texts."""
    return rows.select(
        "d1_id", fx.ids("d2_candidates_id").alias("d2_candidates_id"), "result", "request_status", "prompt_type",
        "prompt_group", "model", "run_id",
    )


def _log_sql(prompt: str, group: str) -> str:
    return f"'{prompt}' AS prompt_type, '{group}' AS prompt_group, 'formula' AS model, '8192_max_run' AS run_id"


def judge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line pair asked with the plain matching prompt."""
    answers = J.match_answers(attach_texts(spark, sf_dir), formula_judge, "MATCHING_PROMPT", OPTIONS)
    return answers.select("d1_id", "d2_id", "status", "answer")


def judge_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that fails on any batch holding a key divisible by 997: such questions stay without a response, all
    others get theirs."""

    def shaky(questions):
        if any((int(a) + int(b)) % 997 == 0 for a, b in zip(questions["d1_id"], questions["d2_id"])):
            raise TimeoutError("no answer")
        return formula_judge(questions)

    questions = attach_texts(spark, sf_dir).select("d1_id", "d2_id", F.col("d1_text").alias("prompt"))
    return J.judge_retry(questions, shaky, OPTIONS).select("d1_id", "d2_id", "response")


def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(J.match_pairs(attach_texts(spark, sf_dir), formula_judge, "MATCHING_PROMPT_ONLY", OPTIONS))


def run_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(J.run_mode(MATCHING, attach_texts(spark, sf_dir), formula_judge, "MATCHING_PROMPT", OPTIONS))


def compare_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every candidate after the pairwise sort."""
    ordered = J.compare_sort(attach_texts(spark, sf_dir), formula_judge, "COMPARING_PROMPT", OPTIONS)
    return tidy(ordered.select("d1_id", "slot", "d2_id", "status"))


def compare_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(J.run_mode(COMPARING, attach_texts(spark, sf_dir), formula_judge, "COMPARING_PROMPT_ONLY", OPTIONS))


def select_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(J.run_mode(SELECTING, attach_texts(spark, sf_dir), formula_judge, "SELECTING_PROMPT", OPTIONS))


# The formula judge ranks by a number, so its bubble sort is a stable sort by that number.
_SLOT = "row_number() OVER (PARTITION BY d1_id ORDER BY (d1_id * 7 + d2_id * 13) % 101 DESC, pos)"
COMPARE_SQL = f"""WITH {LINE_PAIRS_SQL}, ordered AS (SELECT *, {_SLOT} - 1 AS slot FROM line_pairs)"""
SELECT_SQL = f"""WITH {LINE_PAIRS_SQL}, {MATCH_SQL},
ordered AS (SELECT *, {_SLOT} AS slot FROM answers WHERE result IS NOT NULL),
lists AS (SELECT d1_id, count(*) AS n, list(d2_id ORDER BY slot) AS ids FROM ordered GROUP BY d1_id),
picked AS (SELECT *, CASE WHEN d1_id % 11 = 0 THEN NULL ELSE (d1_id * 5 + 3) % (n + 1) END AS number FROM lists)
SELECT d.d1_id::VARCHAR AS d1_id, coalesce(array_to_string(ids, ','), '') AS d2_candidates_id,
       CASE WHEN number > 0 THEN ids[number]::VARCHAR END AS result,
       CASE WHEN ids IS NOT NULL AND number IS NULL THEN 'INVALID' ELSE 'VALID' END AS request_status,
       {_log_sql("SELECTING_PROMPT", "SELECTING_PROMPT")}
FROM (SELECT DISTINCT d1_id FROM line_pairs) d LEFT JOIN picked USING (d1_id)"""


def resume_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line pairs a given run has not answered yet."""
    log = fx.result_log(spark, sf_dir)
    return resume.resume_results(fx.line_pairs(spark, sf_dir), log, "MATCHING_PROMPT_ONLY", "F", "A")


def resume_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ids without a d1 vector of the base model."""
    records = fx.order_records(spark, sf_dir)
    return resume.resume_embeddings(records, fx.embedding_rows(spark, sf_dir), "base", "d1").select("record_id")


def _places(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The non-zero places of vectors."""
    cells = vectors.select(*keys, F.posexplode("embeddings").alias("place", "n")).filter("n > 0")
    return tidy(cells.select(*keys, "place", F.col("n").cast("bigint").alias("n")))


def embed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by the word-hash encoder."""
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text")
    return _places(E.embed_records(docs, "d1", "words", E.hashed_words), ["record_id", "dataset", "model"])


_WORDS = r"unnest(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_PLACE = "('0x' || substr(md5(word), 1, 6))::BIGINT % 32"
EMBED_SQL = f"""WITH words AS (SELECT doc_id, {_WORDS.format("text")} AS word FROM documents)
SELECT doc_id::VARCHAR AS record_id, 'd1' AS dataset, 'words' AS model, {_PLACE} AS place, count(*) AS n
FROM words GROUP BY ALL"""


def embed_with_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, behind the task text, with its parts."""
    rows = E.embed_with_task(
        fx.line_pairs(spark, sf_dir), fx.order_records(spark, sf_dir), fx.part_records(spark, sf_dir), "words", E.hashed_words
    )
    return _places(rows, ["d1_reference_id", "record_id", "is_d2", "model"])


TASK_SQL = f"""WITH {RECORDS_SQL}, {LINE_PAIRS_SQL},
texts AS (
  SELECT DISTINCT record_id AS d1_reference_id, record_id, false AS is_d2,
         'Instruct: {E.TASK}' || chr(10) || 'Query: ' || text AS text
  FROM line_pairs JOIN d1_records ON record_id = d1_id::VARCHAR
  UNION ALL
  SELECT d1_id::VARCHAR, record_id, true, text FROM line_pairs JOIN d2_records ON record_id = d2_id::VARCHAR),
words AS (SELECT d1_reference_id, record_id, is_d2, {_WORDS.format("text")} AS word FROM texts)
SELECT d1_reference_id, record_id, is_d2, 'words' AS model, {_PLACE} AS place, count(*) AS n FROM words GROUP BY ALL"""

# A sentence model that always gets a task prefix.
PREFIXED = "KiteFishAI/Nano-Em1-0.6B-v2.1"


def embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts by the encoder of the model's loader family, run once per task in Python."""

    def factory():
        def letters(texts):
            return [[t.lower().count(c) for c in "aeiou"] for t in texts]

        return letters

    rows = E.embed(
        fx.order_records(spark, sf_dir), fx.part_records(spark, sf_dir), fx.line_pairs(spark, sf_dir), PREFIXED,
        {"sentence": lambda texts: E.encode(texts, factory)},
    )
    return _places(rows, ["record_id", "dataset", "model"])


EMBED_BOTH_SQL = f"""WITH {RECORDS_SQL},
texts AS (SELECT record_id, 'd1' AS dataset, text FROM d1_records UNION ALL SELECT record_id, 'd2', text FROM d2_records),
prefixed AS (
  SELECT *, lower('Instruct: {E.FIXED_TASKS[PREFIXED]}' || chr(10) || 'Query: ' || text) AS t, unnest(range(5)) AS place FROM texts),
counted AS (SELECT *, len(t) - len(replace(t, 'aeiou'[place + 1], '')) AS n FROM prefixed)
SELECT record_id, dataset, '{PREFIXED}' AS model, place, n FROM counted WHERE n > 0"""

QUERIES = {
    "judge_batch": (
        judge_batch,
        f"""WITH {LINE_PAIRS_SQL}, {MATCH_SQL} SELECT d1_id::VARCHAR AS d1_id, d2_id::VARCHAR AS d2_id, status,
CASE WHEN status = 'VALID' THEN CASE WHEN result IS NULL THEN 'no' ELSE 'yes' END END AS answer FROM answers""",
    ),
    "judge_retry": (
        judge_retry,
        f"""WITH {LINE_PAIRS_SQL} SELECT d1_id::VARCHAR AS d1_id, d2_id::VARCHAR AS d2_id,
CASE WHEN (d1_id + d2_id) % 997 = 0 OR (d1_id + d2_id) % 7 = 0 THEN NULL
ELSE ['Yes.', 'No, they differ', 'It depends'][(d1_id + d2_id) % 3 + 1] END AS response FROM line_pairs""",
    ),
    "match_pairs": (
        match_pairs,
        f"""WITH {LINE_PAIRS_SQL}, {MATCH_SQL} SELECT d1_id::VARCHAR AS d1_id, d2_id::VARCHAR AS d2_candidates_id,
result::VARCHAR AS result, status AS request_status, {_log_sql("MATCHING_PROMPT_ONLY", "MATCHING_PROMPT")} FROM answers""",
    ),
    "run_mode": (
        run_mode,
        f"""WITH {LINE_PAIRS_SQL}, {MATCH_SQL} SELECT d1_id::VARCHAR AS d1_id, d2_id::VARCHAR AS d2_candidates_id,
result::VARCHAR AS result, status AS request_status, {_log_sql("MATCHING_PROMPT", "MATCHING_PROMPT")} FROM answers""",
    ),
    "compare_sort": (
        compare_sort,
        f"{COMPARE_SQL} SELECT d1_id::VARCHAR AS d1_id, slot, d2_id::VARCHAR AS d2_id, 'VALID' AS status FROM ordered",
    ),
    "compare_pick": (
        compare_pick,
        f"""{COMPARE_SQL} SELECT d1_id::VARCHAR AS d1_id, string_agg(d2_id::VARCHAR, ',' ORDER BY slot) AS d2_candidates_id,
arg_min(d2_id, slot)::VARCHAR AS result, 'VALID' AS request_status, {_log_sql("COMPARING_PROMPT_ONLY", "COMPARING_PROMPT")}
FROM ordered GROUP BY d1_id""",
    ),
    "select_cascade": (select_cascade, SELECT_SQL),
    "resume_results": (
        resume_results,
        f"""WITH {LINE_PAIRS_SQL} SELECT d1_id::VARCHAR AS d1_id, pos, d2_id::VARCHAR AS d2_id FROM line_pairs
WHERE (d1_id, d2_id) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F')""",
    ),
    "resume_embeddings": (
        resume_embeddings,
        """SELECT o_orderkey::VARCHAR AS record_id FROM orders
WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)""",
    ),
    "embed_records": (embed_records, EMBED_SQL),
    "embed_with_task": (embed_with_task, TASK_SQL),
    "embed": (embed, EMBED_BOTH_SQL),
}
