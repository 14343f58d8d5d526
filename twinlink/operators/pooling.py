"""One vector per record from its token vectors ``(batch_id, record_id, pos, mask, vec)``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(tokens: DataFrame) -> DataFrame:
    """Mean over all token vectors, padding included.

    A vector-valued partial aggregate: each task sends one sum for a record, so the tokens of a long one are summed in
    many tasks and no row is made for a single component. Null vectors are left out.
    """
    vectors = tokens.filter(F.col("vec").isNotNull()).select("record_id", array_to_vector(F.col("vec").cast("array<double>")).alias("vec"))
    means = vectors.groupBy("record_id").agg(Summarizer.mean(F.col("vec")).alias("mean"))
    return means.select("record_id", vector_to_array("mean").alias("embeddings"))


def last_token_pool(tokens: DataFrame) -> DataFrame:
    """Vector of the last real token.

    In a batch whose sequences all end in a real token that is the final position; otherwise it is the position
    given by the number of real tokens.
    """
    ends = tokens.groupBy("batch_id", "record_id").agg(
        F.sum("mask").alias("real"), F.max("pos").alias("end"), F.max_by("mask", "pos").alias("end_mask")
    )
    left = ends.groupBy("batch_id").agg((F.min("end_mask") == 1).alias("left_padded"))
    at = F.when(F.col("left_padded"), F.col("end")).otherwise(F.col("real") - 1)
    wanted = ends.join(left, "batch_id").select("batch_id", "record_id", at.cast("long").alias("pos"))
    keyed = tokens.withColumn("pos", F.col("pos").cast("long"))
    return keyed.join(wanted, ["batch_id", "record_id", "pos"]).select("record_id", F.col("vec").alias("embeddings"))


def vector_dim(embeddings: DataFrame, by: str = "model") -> DataFrame:
    """Vector length per model; differing lengths fail the query."""
    lo, hi = F.min(F.size("embeddings")), F.max(F.size("embeddings"))
    message = F.concat(F.lit("vectors of unequal length for "), F.col(by))
    rows = embeddings.groupBy(by).agg(lo.alias("lo"), hi.alias("hi"))
    return rows.select(by, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(message).cast("int")).alias("dim"))
