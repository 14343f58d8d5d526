"""Vector arithmetic on ``array<float>`` columns.

Pair scores run as Arrow functions: a batch of vectors arrives as one contiguous buffer, so the sums are numpy
reductions without a Python object per row. The small helpers that feed further SQL stay JVM-side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.schema import COSINE, EUCLIDEAN


def as_matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix; a null or ragged row is an error."""
    if vectors.null_count:
        raise ValueError("null vector")
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    if n and (lengths != lengths[0]).any():
        raise ValueError("vectors of unequal length")
    return flat.astype(np.float64).reshape(n, -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0.0, 1.0, norm)


def _matrices(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, y = as_matrix(a), as_matrix(b)
    if x.shape != y.shape:
        raise ValueError("vectors of unequal length")
    return x, y


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = _matrices(a, b)
    return pa.array((unit_rows(x) * unit_rows(y)).sum(axis=1))


@F.arrow_udf(T.DoubleType())
def _squared_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = _matrices(a, b)
    diff = x - y
    return pa.array((diff * diff).sum(axis=1))


def cosine_score(a: Column | str, b: Column | str) -> Column:
    """Inner product of the unit vectors; 0 when either vector is zero."""
    return _cosine(a, b)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return _squared_distance(a, b)


def euclidean_score(a: Column | str, b: Column | str) -> Column:
    """``1 / (1 + squared distance)``: larger is closer."""
    return F.lit(1.0) / (F.lit(1.0) + _squared_distance(a, b))


def score(metric: str, a: Column | str, b: Column | str) -> Column:
    if metric == COSINE:
        return cosine_score(a, b)
    if metric == EUCLIDEAN:
        return euclidean_score(a, b)
    raise ValueError(f"unknown metric: {metric}")


def l2_normalize(v: Column | str) -> Column:
    """Vector divided by its length, in double precision; a zero vector stays zero."""
    v = F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0.0, v).otherwise(F.transform(v, lambda x: x / norm))
