"""Token counts for every context limit from one exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlink.llm.sentencepiece_codec import Vocabulary
from twinlink.session import materialise

#: Lengths in a range of the histogram; suffix sums run over ranges first and inside each range then.
RANGE = 1024


def encoded_lengths(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``n_tokens``, the number of pieces of the whole text, of every row; null and empty texts have 0."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            sizes = [len(encoder.encode(text.as_py() or "")) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(sizes, dtype=np.int64))], ["id", "n_tokens"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row per length that occurs, with the answers for a context limit of that length.

    ``n_docs``; ``docs_at_least`` and ``tokens_at_least``, the suffix sums over this and longer lengths;
    ``total_tokens`` and ``total_docs`` of all; ``truncated_tokens``, the sum of lengths cut at the limit; ``quantile``,
    the share of documents no longer. Null lengths are left out; without rows there are none.
    """
    counts = lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens"))
    # A table, read twice below: lengths may come from an encoder that should run once.
    counts = materialise(counts.agg(F.count("*").alias("n_docs"))).withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    tokens = F.col("n_tokens") * F.col("n_docs")
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    # One row per range that occurs: a table as long as the longest text divided by RANGE.
    over = Window.orderBy(F.col("range").desc())
    longer = over.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("tokens_beyond"),
        F.sum("docs").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_docs"),
        F.sum("tokens").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total_tokens"),
    )
    inside = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(ranges, "range").select(
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.col("docs_beyond") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_beyond") + F.sum(tokens).over(inside)).alias("tokens_at_least"),
    )
    return out.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens of all documents cut at any ``limit``, from the row of the next longer length."""
    row = histogram.where(F.col("n_tokens") >= limit).orderBy("n_tokens").limit(1).collect()
    if row:
        return row[0]["total_tokens"] - row[0]["tokens_at_least"] + limit * row[0]["docs_at_least"]
    return histogram.agg(F.max("total_tokens")).first()[0] or 0


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length such that at least ``share`` of the documents are no longer; null without documents."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]
