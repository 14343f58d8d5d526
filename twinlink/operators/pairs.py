"""Candidate pairs: grouping, set operations, id translation and the records they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.operators.rank import HOT_ROWS, LIST_ROWS, rank_within


def with_position(pairs: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the list position of every candidate, from 0, by ``order`` within its d1."""
    ranked = rank_within(pairs, ["d1_id"], [F.col(c) for c in order], hot_rows=hot_rows)
    return ranked.withColumn("pos", (F.col("rank") - 1).cast("long")).drop("rank")


def group_candidates(pairs: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(d1_id, part, d2_ids)`` in list order from pairs whose ``pos`` counts from 0.

    A list longer than ``list_rows`` continues in the next ``part``.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "d2_id")))
    return (
        pairs.withColumn("part", F.floor(F.col("pos") / list_rows).cast("int"))
        .groupBy("d1_id", "part")
        .agg(rows.alias("rows"))
        .select("d1_id", "part", F.col("rows.d2_id").alias("d2_ids"))
    )


def ungroup_candidates(lists: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """The inverse of ``group_candidates``."""
    at = lists.select("d1_id", "part", F.posexplode("d2_ids").alias("at", "d2_id"))
    return at.select("d1_id", (F.col("part") * F.lit(list_rows).cast("long") + F.col("at")).alias("pos"), "d2_id")


def d2_union_distinct(pairs: DataFrame) -> DataFrame:
    """Every d2 record named by any candidate list."""
    return pairs.select("d2_id").distinct()


def pairs_intersect(there: DataFrame, back: DataFrame) -> DataFrame:
    """Pairs listed in both directions; ``back`` holds (d2_id, d1_id) lists."""
    return there.select("d1_id", "d2_id").intersect(back.select("d1_id", "d2_id"))


def ids_except(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.distinct().join(right.distinct(), left.columns, "left_anti")


def candidate_stats(pairs: DataFrame) -> DataFrame:
    """Number of distinct d2 records and the length of the longest list."""
    lists = pairs.groupBy("d1_id").agg(F.count("*").alias("n"))
    longest = lists.agg(F.max("n")).scalar()
    return d2_union_distinct(pairs).agg(F.count("*").alias("unique_d2_ids")).withColumn("max_neighbors", longest)


def id_translate(pairs: DataFrame, d1_map: DataFrame, d2_map: DataFrame) -> DataFrame:
    """Pairs of block-internal ids to source ids; the maps are ``(internal_id, source_id)``."""
    d1 = d1_map.select(F.col("internal_id").alias("d1_id"), F.col("source_id").alias("d1_source"))
    d2 = d2_map.select(F.col("internal_id").alias("d2_id"), F.col("source_id").alias("d2_source"))
    joined = pairs.join(d1, "d1_id").join(d2, "d2_id")
    return joined.drop("d1_id", "d2_id").withColumnsRenamed({"d1_source": "d1_id", "d2_source": "d2_id"})


def _missing(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    known = records.select(F.col("record_id").alias(key))
    return ids.select(key).distinct().join(known, key, "left_anti")


def missing_records(pairs: DataFrame, d1_records: DataFrame, d2_records: DataFrame) -> DataFrame:
    """Ids named by pairs that have no record, as ``(side, record_id)``."""
    d1 = _missing(pairs, d1_records, "d1_id").select(F.lit("d1").alias("side"), F.col("d1_id").alias("record_id"))
    d2 = _missing(pairs, d2_records, "d2_id").select(F.lit("d2").alias("side"), F.col("d2_id").alias("record_id"))
    return d1.unionByName(d2)


def attach_texts(pairs: DataFrame, d1_records: DataFrame, d2_records: DataFrame) -> DataFrame:
    """Both record texts next to every pair; a pair whose record is missing fails the query."""
    d1 = d1_records.select(F.col("record_id").alias("d1_id"), F.col("text").alias("d1_text"))
    d2 = d2_records.select(F.col("record_id").alias("d2_id"), F.col("text").alias("d2_text"))
    joined = pairs.join(d1, "d1_id", "left").join(d2, "d2_id", "left")

    def present(text: str, key: str):
        message = F.concat(F.lit(f"no record for {key} "), F.col(key).cast("string"))
        return F.coalesce(F.col(text), F.raise_error(message).cast("string"))

    return joined.withColumns({"d1_text": present("d1_text", "d1_id"), "d2_text": present("d2_text", "d2_id")})


def records_of_interest(records: DataFrame, ids: DataFrame, id_col: str = "id", at: str = "row_pos") -> DataFrame:
    """The first row, by ``at``, of every wanted id; ids without a row are simply absent."""
    wanted = records.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    others = [c for c in records.columns if c not in (id_col, at)]
    first = F.min_by(F.struct(*others), at)
    return wanted.groupBy(id_col).agg(first.alias("row")).select(id_col, "row.*")


def id_coverage_check(pairs: DataFrame, d1_ids: DataFrame, d2_ids: DataFrame) -> DataFrame:
    """``(side, missing, surplus)``: wanted ids that were not fetched, and fetched ids nobody wanted."""

    def one(side: str, fetched: DataFrame) -> DataFrame:
        want = pairs.select(F.col(f"{side}_id").alias("record_id")).distinct().withColumn("want", F.lit(1))
        have = fetched.select("record_id").distinct().withColumn("have", F.lit(1))
        both = want.join(have, "record_id", "full")
        return both.agg(
            F.lit(side).alias("side"),
            F.count_if(F.col("have").isNull()).alias("missing"),
            F.count_if(F.col("want").isNull()).alias("surplus"),
        )

    return one("d1", d1_ids).unionByName(one("d2", d2_ids))
