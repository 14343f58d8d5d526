"""A corpus pipeline of five stages, each one operator on all rows that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.llm import decontaminate, line_dedup, sentencepiece_codec, simhash, toxicity
from twinlink.llm.queries import held_out, pieces_file, table
from twinlink.session import materialise


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones scores below one half."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda i: held_out(i, 0))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier in the corpus up to two edits."""
    out = line_dedup.drop_repeated_lines(docs, edits=2, min_chars=20)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return simhash.keep_first(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, with their other columns but the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "ids", "round_trip"))
    return sentencepiece_codec.encode_texts(docs, sentencepiece_codec.load_vocabulary(pieces_file()), keep=others)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("sentencepiece", encode),
]

#: The scores of the first stage and the pieces of the last have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
