"""Record texts, prompts, answer parsing, token truncation, registries and run ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.functions import parse as A
from twinlink.functions import prompts as Q
from twinlink.functions import text as X
from twinlink.functions import times
from twinlink.operators import embed as E
from twinlink.operators import pairs as P
from twinlink.operators import registry as R
from twinlink.schema import DATASET_FILES, EMBEDDING_MODELS, PROMPTS_BY_MODE
from twinlink.sources import files as S
from workload import fixtures as fx
from workload.fixtures import LINE_PAIRS_SQL, RECORDS_SQL, tidy


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- records ---------------------------------------------------------------------------------------


def serialize_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.part_records(spark, sf_dir)


def records_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every order that names a customer's key as its part, by date, then line, part and price."""
    lines = fx.table(spark, sf_dir, "lineitem")
    at = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")
    entities = lines.select(F.col("l_orderkey").alias("id"), "l_partkey", "l_linenumber", at.alias("row_pos"))
    wanted = fx.table(spark, sf_dir, "customer").select("c_custkey")
    return tidy(P.records_of_interest(entities, wanted))


RECORDS_OF_INTEREST_SQL = """SELECT l_orderkey AS id, l_partkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT c_custkey FROM customer)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) = 1"""


def attribute_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attributes of the parts in order, as (id, position, name, value)."""
    parts = fx.part_entities(spark, sf_dir)
    names = S.attribute_columns(parts)
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    rows = parts.select("id", F.posexplode(cells).alias("at", "cell"))
    return tidy(rows.select("id", "at", "cell.name", "cell.value"))


ATTRIBUTES_SQL = " UNION ALL ".join(
    f"SELECT p_partkey AS id, {i}::BIGINT AS at, '{name}' AS name, {value} AS value FROM part"
    for i, (name, value) in enumerate(
        [("p_name", "p_name"), ("p_brand", "nullif(p_brand, 'Brand#13')"), ("p_type", "p_type"), ("p_size", "p_size::VARCHAR")]
    )
)


def attach_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.attach_texts(
        fx.line_pairs(spark, sf_dir), fx.order_records(spark, sf_dir), fx.part_records(spark, sf_dir)
    )


TEXT_PAIRS_SQL = f"""{RECORDS_SQL}, {LINE_PAIRS_SQL},
texts AS (
  SELECT p.d1_id, p.pos, p.d2_id, a.text AS d1_text, b.text AS d2_text FROM line_pairs p
  JOIN d1_records a ON a.record_id = p.d1_id::VARCHAR JOIN d2_records b ON b.record_id = p.d2_id::VARCHAR)"""


# --- prompts ---------------------------------------------------------------------------------------


def _filled(prompt_type: str, *values: str) -> str:
    """The SQL for a prompt with its record and candidates filled in."""
    out = _q(Q.TEMPLATES[prompt_type])
    for i, v in enumerate(values):
        out = f"replace({out}, '{{{i}}}', {v})"
    return out


def _prompts(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Both variants of a prompt over all line pairs; comparing sets a part against the one after it in the order."""
    rows = attach_texts(spark, sf_dir)
    candidates = F.array("d2_text") if mode == "MATCHING" else F.array("d2_text", F.reverse("d2_text"))
    build = Q.matching_prompt if mode == "MATCHING" else Q.comparing_prompt
    variants = [
        rows.select("d1_id", "d2_id", F.lit(p).alias("prompt_type"), build("d1_text", candidates, p).alias("prompt"))
        for p in PROMPTS_BY_MODE[mode]
    ]
    return variants[0].unionByName(variants[1])


def matching_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, "MATCHING")


def comparing_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, "COMPARING")


def _prompts_sql(mode: str, *values: str) -> str:
    parts = [
        f"""SELECT d1_id::VARCHAR AS d1_id, d2_id::VARCHAR AS d2_id, '{p}' AS prompt_type,
            {_filled(p, 'd1_text', *values)} AS prompt FROM texts"""
        for p in PROMPTS_BY_MODE[mode]
    ]
    return f"WITH {TEXT_PAIRS_SQL} " + " UNION ALL ".join(parts)


def selecting_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", "d2_text")))
    lists = attach_texts(spark, sf_dir).groupBy("d1_id", "d1_text").agg(rows.alias("rows"))
    return lists.select("d1_id", Q.selecting_prompt("d1_text", "rows.d2_text").alias("prompt"))


SELECTING_SQL = f"""WITH {TEXT_PAIRS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY d1_id ORDER BY pos) AS i FROM texts)
SELECT d1_id::VARCHAR AS d1_id, {_filled("SELECTING_PROMPT", "d1_text")}
       || string_agg('[' || i::VARCHAR || '] ' || d2_text || chr(10), '' ORDER BY i) || chr(10) || 'The answer is:' AS prompt
FROM numbered GROUP BY d1_id, d1_text"""


def instruct_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.instruct_prefix(E.TASK, "text")).alias("text_md5"))


# --- texts -----------------------------------------------------------------------------------------


def strip_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.strip_punctuation("text")).alias("words_md5"))


CLEAN_SQL = r"lower(array_to_string(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), ' '))"


def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.truncate_tokens("text", 420)).alias("text_md5"))


# Java's \s is the six ASCII blanks; they are written out since the other side leaves out the vertical tab.
_BLANK = r"[ \t\n\x0b\f\r]"
TRUNCATE_SQL = rf"""WITH pieces AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_BLANK}*[^ \t\n\x0b\f\r]+|{_BLANK}+$') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN len(t) > 220 THEN array_to_string(t[1:120], '') || array_to_string(t[-100:], '') ELSE text END)
       AS text_md5 FROM pieces"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns as raw answers: the whole text as a thought, or with a short answer before or behind it."""
    turns = fx.table(spark, sf_dir, "conversations")
    place = F.col("conv_id") + F.col("turn")
    say = F.element_at(F.array(*[F.lit(s) for s in OPENERS]), (place % len(OPENERS) + 1).cast("int"))
    thought = F.concat("text", F.lit("</think> "), say)
    framed = F.when(F.col("turn") % 2 == 0, F.concat(say, F.lit(" "), F.col("text"))).otherwise(F.concat("text", F.lit(" "), say))
    answer = F.when(F.col("role") == "assistant", thought).otherwise(framed)
    return turns.select("conv_id", "turn", answer.alias("response"), (F.col("conv_id") % 4 + 1).alias("n"))


OPENERS = [
    "Yes.",
    "no, they differ",
    "yesterday",
    "Record A",
    "The answer is: Record B",
    "I think Record A is more likely to refer to the same real-world entity.",
    "[2]",
    "0",
    "The answer is: [3]",
    "7 or so",
    "take number 1",
    "",
]
_LIST = "[" + ", ".join(_q(s) for s in OPENERS) + "]"
TURNS_SQL = f"""turns AS (
  SELECT conv_id, turn, conv_id % 4 + 1 AS n,
         CASE WHEN role = 'assistant' THEN text || '</think> ' || say WHEN turn % 2 = 0 THEN say || ' ' || text ELSE text || ' ' || say END AS response
  FROM (SELECT *, ({_LIST})[(conv_id + turn) % {len(OPENERS)} + 1] AS say FROM conversations)),
cleaned AS (
  SELECT *, {CLEAN_SQL.format("response")} AS t,
         CASE WHEN contains(response, '</think>') THEN {CLEAN_SQL.format("trim(string_split(lower(response), '</think>')[-1])")}
         END AS after
  FROM turns)"""


def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", A.strip_thinking("response").alias("text"))


THINKING_SQL = f"""WITH {TURNS_SQL} SELECT conv_id, turn, CASE WHEN contains(response, '</think>')
THEN trim(string_split(lower(response), '</think>')[-1]) END AS text FROM cleaned"""


def _parsed(spark: SparkSession, sf_dir: str, parser) -> DataFrame:
    """Every turn parsed as it is, and as the answer of a reasoning model."""
    turns = _turns(spark, sf_dir)
    both = [
        turns.select("conv_id", "turn", F.lit(r).alias("reasoning"), parser(r).alias("p")) for r in (False, True)
    ]
    rows = both[0].unionByName(both[1])
    return rows.select("conv_id", "turn", "reasoning", "p.status", F.col("p.answer").cast("string").alias("answer"))


def parse_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, lambda r: A.parse_matching("response", reasoning=r))


def parse_comparing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, lambda r: A.parse_comparing("response", reasoning=r))


def parse_selecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, lambda r: A.parse_selecting("response", "n", reasoning=r))


def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns are absent, invalid or valid as an answer to each kind of prompt."""
    turns = _turns(spark, sf_dir)
    kinds = [prompts[0] for prompts in PROMPTS_BY_MODE.values()]
    status = [F.struct(F.lit(k).alias("prompt_type"), A.response_status(k, "response", "n").alias("status")) for k in kinds]
    rows = turns.select(F.explode(F.array(*status)).alias("s")).select("s.*")
    return rows.groupBy("prompt_type", "status").agg(F.count("*").alias("n"))


_MATCH = "CASE WHEN {0} = 'no' OR starts_with({0}, 'no ') THEN 'no' WHEN {0} = 'yes' OR starts_with({0}, 'yes ') THEN 'yes' END"
_COMPARE = (
    "CASE WHEN contains({0}, 'record a is more likely to refer to the same real world entity') THEN 'record a'"
    " WHEN contains({0}, 'record b is more likely to refer to the same real world entity') THEN 'record b'"
    " WHEN {0} IN ('record a', 'record b') THEN {0}"
    " WHEN starts_with({0}, 'the answer is record a') THEN 'record a'"
    " WHEN starts_with({0}, 'the answer is record b') THEN 'record b' END"
)
_REST = "trim(string_split({0}, 'the answer is')[-1])"
_FIRST, _LAST = "string_split(" + _REST + ", ' ')[1]", "string_split(" + _REST + ", ' ')[-1]"
_NUMBER = "CASE WHEN regexp_full_match({0}, '[0-9]+') AND TRY_CAST({0} AS INT) <= n THEN TRY_CAST({0} AS INT)::VARCHAR END"


def _select(col: str, reasoning: bool) -> str:
    first, last = _FIRST.format(col), _LAST.format(col)
    word = last if reasoning else f"CASE WHEN regexp_full_match({first}, '[0-9]+') THEN {first} ELSE {last} END"
    return _NUMBER.format(f"({word})")


def _parsed_sql(plain: str, thoughtful: str) -> str:
    parts = [
        f"""SELECT conv_id, turn, {r} AS reasoning, CASE WHEN response IS NULL THEN 'NO_RESPONSE' WHEN answer IS NULL
            THEN 'INVALID' ELSE 'VALID' END AS status, answer FROM (SELECT *, {expr} AS answer FROM cleaned)"""
        for r, expr in (("false", plain), ("true", thoughtful))
    ]
    return f"WITH {TURNS_SQL} " + " UNION ALL ".join(parts)


def _status_sql() -> str:
    kinds = [("MATCHING_PROMPT", _MATCH.format("t")), ("COMPARING_PROMPT", _COMPARE.format("t")), ("SELECTING_PROMPT", _select("t", False))]
    parts = [f"SELECT '{k}' AS prompt_type, response, {e} AS answer FROM cleaned" for k, e in kinds]
    return f"""WITH {TURNS_SQL}, kinds AS ({" UNION ALL ".join(parts)})
SELECT prompt_type, CASE WHEN response IS NULL THEN 'NO_RESPONSE' WHEN answer IS NULL THEN 'INVALID' ELSE 'VALID' END AS status,
       count(*) AS n FROM kinds GROUP BY ALL"""


# --- times, ids, registries ------------------------------------------------------------------------


def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's total, rounded to whole seconds, as a duration."""
    orders = fx.table(spark, sf_dir, "orders")
    seconds = F.floor(F.col("o_totalprice") / 60)
    return orders.select("o_orderkey", times.format_duration(seconds).alias("duration"))


DURATION_SQL = """SELECT o_orderkey, CASE WHEN s < 3600 THEN printf('%.2f minutes', s / 60) ELSE printf('%.2f hours', s / 3600) END
AS duration FROM (SELECT o_orderkey, floor(o_totalprice / 60) AS s FROM orders)"""


def make_run_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ids of all log rows, and the prompt variant read back from them."""
    log = fx.result_log(spark, sf_dir)
    day = F.date_format("inserted_at", "yyyy-MM-dd")
    rows = log.select("d1_id", times.make_run_id(F.lit(8192), "prompt_type", "model", day).alias("run_id"))
    return rows.withColumn("prompt_type", times.prompt_of_run("run_id"))


MODEL_KEYS = [k for k, _, _ in EMBEDDING_MODELS] + ["NOT_A_MODEL"]


def _model_key() -> Column:
    keys = F.array(*[F.lit(k) for k in MODEL_KEYS])
    return F.element_at(keys, (F.col("user_id") % len(MODEL_KEYS) + 1).cast("int"))


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of embedding models, one of them unknown: uses per published name and loader family."""
    uses = fx.table(spark, sf_dir, "events").select(_model_key().alias("model_key"))
    counts = uses.groupBy("model_key").agg(F.count("*").alias("uses"))
    return R.model_registry(counts, "embedding", strict=False)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else _q(str(v)) for v in r) + ")" for r in rows)


REGISTRY_SQL = f"""WITH known(model_key, name, family) AS (VALUES {_values(EMBEDDING_MODELS)}),
uses AS (
  SELECT ([{", ".join(_q(k) for k in MODEL_KEYS)}])[user_id % {len(MODEL_KEYS)} + 1] AS model_key, count(*) AS uses
  FROM events GROUP BY 1)
SELECT model_key, uses, name, family FROM uses LEFT JOIN known USING (model_key)"""


def validate_prompt_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as jobs: those whose prompt does not belong to their mode."""
    modes, prompts = list(PROMPTS_BY_MODE), [p for v in PROMPTS_BY_MODE.values() for p in v]
    jobs = fx.table(spark, sf_dir, "lineitem").select(
        F.element_at(F.array(*[F.lit(m) for m in modes]), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("mode"),
        F.element_at(F.array(*[F.lit(p) for p in prompts]), (F.col("l_partkey") % 6 + 1).cast("int")).alias("prompt_type"),
        F.col("l_orderkey").alias("job_id"),
    )
    return R.validate_prompt_mode(jobs)


def _prompt_mode_sql() -> str:
    modes, prompts = list(PROMPTS_BY_MODE), [p for v in PROMPTS_BY_MODE.values() for p in v]
    allowed = [(m, p) for m, v in PROMPTS_BY_MODE.items() for p in v]
    return f"""WITH allowed(mode, prompt_type) AS (VALUES {_values(allowed)}),
jobs AS (SELECT ([{", ".join(map(_q, modes))}])[l_suppkey % 3 + 1] AS mode,
                ([{", ".join(map(_q, prompts))}])[l_partkey % 6 + 1] AS prompt_type, l_orderkey AS job_id FROM lineitem)
SELECT * FROM jobs WHERE (mode, prompt_type) NOT IN (SELECT (mode, prompt_type) FROM allowed)"""


def _paths() -> Column:
    return F.concat(F.lit("/data/Drive/D"), F.col("doc_id") % 11 + 1, F.lit("/"), F.col("source"), F.lit("clean.csv"))


PATH_SQL = "'/data/Drive/D' || (doc_id % 11 + 1)::VARCHAR || '/' || source || 'clean.csv'"


def dataset_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", _paths().alias("path"))
    return docs.withColumn("dataset", S.dataset_from_path("path"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per data set, with the files that set should have."""
    docs = fx.table(spark, sf_dir, "documents").select(S.dataset_from_path(_paths()).alias("dataset"))
    return R.dataset_manifest(docs.groupBy("dataset").agg(F.count("*").alias("documents")), strict=False)


MANIFEST_SQL = f"""WITH known(dataset, d1_file, d2_file, gt_file) AS (
  VALUES {_values([(d, *[f + "clean.csv" for f in v]) for d, v in DATASET_FILES.items()])}),
docs AS (SELECT 'D' || (doc_id % 11 + 1)::VARCHAR AS dataset, count(*) AS documents FROM documents GROUP BY 1)
SELECT dataset, documents, d1_file, d2_file, gt_file FROM docs LEFT JOIN known USING (dataset)"""

QUERIES = {
    "serialize_record": (serialize_record, f"WITH {RECORDS_SQL} SELECT * FROM d2_records"),
    "records_of_interest": (records_of_interest, RECORDS_OF_INTEREST_SQL),
    "attribute_columns": (attribute_columns, ATTRIBUTES_SQL),
    "attach_texts": (
        attach_texts,
        f"""WITH {TEXT_PAIRS_SQL} SELECT d1_id::VARCHAR AS d1_id, pos, d2_id::VARCHAR AS d2_id, d1_text, d2_text FROM texts""",
    ),
    "matching_prompt": (matching_prompt, _prompts_sql("MATCHING", "d2_text")),
    "comparing_prompt": (comparing_prompt, _prompts_sql("COMPARING", "d2_text", "reverse(d2_text)")),
    "selecting_prompt": (selecting_prompt, SELECTING_SQL),
    "instruct_prefix": (
        instruct_prefix,
        f"SELECT doc_id, md5('Instruct: ' || {_q(E.TASK)} || chr(10) || 'Query: ' || text) AS text_md5 FROM documents",
    ),
    "strip_punctuation": (
        strip_punctuation,
        f"SELECT doc_id, md5({CLEAN_SQL.format('text')}) AS words_md5 FROM documents",
    ),
    "truncate_tokens": (truncate_tokens, TRUNCATE_SQL),
    "strip_thinking": (strip_thinking, THINKING_SQL),
    "parse_matching": (parse_matching, _parsed_sql(_MATCH.format("t"), _MATCH.format("after"))),
    "parse_comparing": (parse_comparing, _parsed_sql(_COMPARE.format("t"), _COMPARE.format("after"))),
    "parse_selecting": (parse_selecting, _parsed_sql(_select("t", False), _select("after", True))),
    "response_status": (response_status, _status_sql()),
    "format_duration": (format_duration, DURATION_SQL),
    "make_run_id": (
        make_run_id,
        f"""WITH {fx.LOG_SQL} SELECT d1_id, '8192_max_' || prompt_type || '_' || model || '_' || strftime(inserted_at, '%Y-%m-%d')
AS run_id, prompt_type FROM log""",
    ),
    "model_registry": (model_registry, REGISTRY_SQL),
    "validate_prompt_mode": (validate_prompt_mode, _prompt_mode_sql()),
    "dataset_from_path": (
        dataset_from_path,
        f"SELECT doc_id, {PATH_SQL} AS path, 'D' || (doc_id % 11 + 1)::VARCHAR AS dataset FROM documents",
    ),
    "dataset_manifest": (dataset_manifest, MANIFEST_SQL),
}
