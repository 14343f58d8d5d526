"""Two record tables to candidate pairs and the texts of the records they name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.functions.text import serialize_record
from twinlink.operators.knn import reciprocal_knn
from twinlink.operators.knn_approx import lsh_reciprocal_knn
from twinlink.operators.pairs import with_position
from twinlink.schema import EUCLIDEAN
from twinlink.session import materialise
from twinlink.sources.files import attribute_columns, sink_pairs, sink_records


@dataclass(frozen=True)
class Blocks:
    """Where a blocking run left its results."""

    pairs: DataFrame
    pairs_path: str
    d1_records_path: str
    d2_records_path: str


def candidate_pairs(
    d1: DataFrame,
    d2: DataFrame,
    to_vectors: Callable[[DataFrame], DataFrame],
    k: int = 10,
    metric: str = EUCLIDEAN,
    approximate: bool = False,
) -> DataFrame:
    """``(d1_id, pos, d2_id)`` of records that are among each other's ``k`` nearest by their vectors.

    The join is exact unless ``approximate``, which may miss neighbours that share no hash bucket.

    The entity tables carry unique ids in their first column. Vectors are written once, since the join reads them
    more than once; a list is ordered by distance, then by id.
    """

    def vectors(entities: DataFrame) -> DataFrame:
        text = serialize_record(attribute_columns(entities))
        texts = entities.select(F.col(entities.columns[0]).alias("record_id"), text.alias("text"))
        return materialise(to_vectors(texts))

    found = (lsh_reciprocal_knn if approximate else reciprocal_knn)(
        vectors(d1).withColumnRenamed("record_id", "d1_id"),
        vectors(d2).withColumnRenamed("record_id", "d2_id"),
        k,
        d1_vec="embeddings",
        d2_vec="embeddings",
        metric=metric,
    )
    return with_position(materialise(found), ["sq_dist", "d2_id"]).select("d1_id", "pos", "d2_id")


def run_blocking(
    d1: DataFrame,
    d2: DataFrame,
    to_vectors: Callable[[DataFrame], DataFrame],
    folder: str,
    k: int = 10,
    metric: str = EUCLIDEAN,
    approximate: bool = False,
) -> Blocks:
    """Find the pairs and write pairs and record texts below ``folder``; the tables carry their row positions."""
    pairs = materialise(candidate_pairs(d1, d2, to_vectors, k, metric, approximate))
    out = Blocks(pairs, f"{folder}/pairs.json", f"{folder}/d1_records.json", f"{folder}/d2_records.json")
    sink_pairs(pairs, out.pairs_path)
    sink_records(d1, pairs.select("d1_id"), out.d1_records_path)
    sink_records(d2, pairs.select("d2_id"), out.d2_records_path)
    return out
