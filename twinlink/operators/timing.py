"""Generation time of embeddings from their creation stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlink.functions.times import format_duration, seconds_between


def embedding_span(embeddings: DataFrame, by: str = "model", at: str = "created_at") -> DataFrame:
    """Last minus first creation stamp, as text."""
    span = seconds_between(F.min(at), F.max(at))
    return embeddings.groupBy(by).agg(span.alias("seconds")).select(by, format_duration("seconds").alias("generation_time"))


def active_time(
    embeddings: DataFrame, by: str = "model", at: str = "created_at", threshold: int = 3600
) -> DataFrame:
    """Seconds of activity per ``by``: the gaps between distinct stamps, where the i-th gap, if it exceeds
    ``threshold``, is replaced by the time so far divided by i.

    A long gap thus multiplies the time so far by (1 + 1/i). With P the running product of these factors the total is
    P_end * sum(gap / P) over the short gaps. Stamps are first folded into time slots of ``threshold`` seconds: no
    two stamps of a slot are further apart than that, so all its gaps are short and add up to last - first. What the
    window orders is one row per non-empty slot, which grows with the calendar and not with the data.
    """
    stamps = embeddings.select(by, F.col(at).alias("at")).distinct()
    kind = embeddings.schema[at].dataType.typeName()
    slot = F.floor(seconds_between(F.expr(f"{kind} '1970-01-01 00:00:00'"), "at") / threshold)
    slots = (
        stamps.groupBy(by, slot.alias("slot"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    )
    order = Window.partitionBy(by).orderBy("slot")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = seconds_between(F.lag("last").over(order), F.col("first"))
    return (
        slots.withColumns({"gap": gap, "i": F.sum("n").over(before)})
        .withColumn("long", F.coalesce(F.col("gap") > threshold, F.lit(False)))
        .withColumns(
            {
                "log_p": F.sum(F.when(F.col("long"), F.log1p(1 / F.col("i"))).otherwise(0.0)).over(so_far),
                "seconds": seconds_between("first", "last")
                + F.when(F.col("long"), 0.0).otherwise(F.coalesce("gap", F.lit(0.0))),
            }
        )
        .groupBy(by)
        .agg((F.exp(F.max("log_p")) * F.sum(F.col("seconds") * F.exp(-F.col("log_p")))).alias("active_seconds"))
        .withColumn("generation_time", format_duration("active_seconds"))
    )
