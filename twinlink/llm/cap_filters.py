"""Near-duplicate vectors by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.llm.components import connected_components
from twinlink.session import materialise

#: Filters of a vector, on average over random ones and at least. At cosine 0.95 two vectors share about half of them.
LISTS = 64
SEED = 20231


def _code(dim: int, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and for each of the two halves of a vector ``size`` random directions.

    A filter direction is a pair of them, so ``size`` squared directions are made of 2 * ``size`` short ones.
    """
    rng = np.random.default_rng([SEED, dim, size])
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    half = dim - dim // 2
    parts = [rng.standard_normal((size, w)) for w in (half, dim - half)]
    scaled = [p / np.linalg.norm(p, axis=1, keepdims=True) * math.sqrt(p.shape[1] / dim) if p.shape[1] else p for p in parts]
    return rotation, scaled


def _threshold(dim: int, size: int, lists: int) -> float:
    """The height of the caps at which random unit vectors have ``lists`` filters on average."""
    rng = np.random.default_rng([SEED, dim])
    vectors = rng.standard_normal((64, dim))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rotation, (first, second) = _code(dim, size)
    half = first.shape[1]
    turned = vectors @ rotation
    left, right = -np.sort(-(turned[:, :half] @ first.T)), -np.sort(-(turned[:, half:] @ second.T))
    top = min(size, 512)
    sums = (left[:, :top, None] + right[:, None, :top]).reshape(-1)
    rank = min(64 * lists, len(sums)) - 1
    return float(-np.partition(-sums, rank)[rank])


def decode(vectors: np.ndarray, code: tuple[np.ndarray, list[np.ndarray]], height: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All (vector, filter) pairs with the vector in the filter's cap: of each half only the directions that the best
    one of the other half can complete are combined. A vector in fewer than ``least`` caps gets that many best filters."""
    rotation, (first, second) = code
    half, size = first.shape[1], len(first)
    turned = vectors @ rotation
    left, right = turned[:, :half] @ first.T, turned[:, half:] @ second.T
    owners, filters = [], []
    for k in range(len(vectors)):
        a = np.flatnonzero(left[k] >= height - right[k].max())
        b = np.flatnonzero(right[k] >= height - left[k].max())
        x, y = np.nonzero(left[k][a][:, None] + right[k][b][None, :] >= height)
        own = a[x].astype(np.int64) * size + b[y]
        if len(own) < least:
            own = _best_filters(left[k], right[k], least)
        filters.append(own)
        owners.append(np.full(len(own), k))
    if not owners:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(owners), np.concatenate(filters)


def _best_filters(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """The ``least`` filters with the largest sums; equal sums go by the place of the directions."""
    a, b = (np.argsort(-side, kind="stable")[:least] for side in (left, right))
    # Before the sum of the i-th and the j-th direction, counted from one, stand i * j - 1 others at least.
    x, y = np.nonzero(np.arange(1, len(a) + 1)[:, None] * np.arange(1, len(b) + 1)[None, :] <= least)
    order = np.argsort(-(left[a[x]] + right[b[y]]), kind="stable")[:least]
    return a[x[order]].astype(np.int64) * len(left) + b[y[order]]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = 0.95, lists: int = LISTS
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links`` (other rows linked directly), ``component_id`` (smallest
    id reachable over links, itself included) and ``kept`` (whether that is its own).

    Rows are linked if a common filter finds them and their cosine in double precision is at least ``min_cosine``; equal
    vectors always are. Null vectors, zero ones and those with a null, infinite or NaN component link with nothing, and
    neither do vectors of different lengths. A null id is never the smallest; alone it is its own component and kept.

    Equal vectors are one row before anything is joined. The number of directions grows with the square root of the
    number of vectors, so a filter holds a few vectors at every size, and the height of the caps with it, so that a
    vector keeps about ``lists`` filters; one in fewer caps is put into its ``lists`` best filters. A pair is missed
    only if it shares none of them.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = source.withColumn("vec", F.when(fine, F.col("vec"))).select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    valid = rows.where("vec is not null")
    classes = valid.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("vec").alias("vec"))
    classes = materialise(classes.withColumn("class", F.xxhash64("h1", "h2")))
    listed = materialise(_filters(classes, lists))
    a = listed.select("dim", "filter", F.col("class").alias("a"))
    b = listed.select("dim", "filter", F.col("class").alias("b"))
    pairs = a.join(b, ["dim", "filter"]).where("a < b").select("a", "b").distinct()
    ends = classes.select("class", "vec")
    met = pairs.join(ends.select(F.col("class").alias("a"), F.col("vec").alias("x")), "a")
    met = met.join(ends.select(F.col("class").alias("b"), F.col("vec").alias("y")), "b").select("a", "b", "x", "y")
    links = materialise(met.mapInArrow(_verifier(min_cosine), "a long, b long"))
    around = links.select(F.col("a").alias("class"), F.col("b").alias("other")).union(links.select("b", "a"))
    sizes = classes.select(F.col("class").alias("other"), F.col("copies").alias("more"))
    linked = around.join(sizes, "other").groupBy("class").agg(F.sum("more").alias("more"))
    roots = connected_components(links, "a", "b").withColumnRenamed("node", "class")
    grouped = classes.join(linked, "class", "left").join(roots, "class", "left").select(
        "h1", "h2", "first", F.coalesce("root", "class").alias("root"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")
    )
    grouped = materialise(grouped)
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    answer = grouped.join(least, "root").select("h1", "h2", "n_links", "component")
    keyed = rows.select("id", F.when(F.col("vec").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("vec").isNotNull(), F.col("h2")).alias("h2"))
    out = keyed.join(answer, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"),
    )


def _filters(classes: DataFrame, lists: int) -> DataFrame:
    """``dim``, ``filter`` and ``class`` for every cap that holds a vector."""
    shapes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    codes = {dim: 1 << max(6, math.ceil(math.log2(16 * n) / 2)) for dim, n in shapes.items()}
    heights = {dim: _threshold(dim, size, lists) for dim, size in codes.items()}
    source = classes.select("class", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            names = batch.column("class").to_numpy(zero_copy_only=False)
            rows = batch.column("vec").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                by_dim.setdefault(len(v), []).append(i)
            for dim, places in by_dim.items():
                if dim not in made:
                    made[dim] = _code(dim, codes[dim])
                for start in range(0, len(places), 256):
                    own = places[start : start + 256]
                    unit = _units([rows[i] for i in own])
                    owner, filters = decode(unit, made[dim], heights[dim], lists)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(owner), dim, dtype=np.int32)), pa.array(filters), pa.array(names[np.asarray(own)][owner])],
                        ["dim", "filter", "class"],
                    )

    return source.mapInArrow(run, "dim int, filter long, class long")


def _units(rows: list[list[float]] | np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square over- or underflows."""
    out = np.array(rows, dtype=np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _verifier(min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x, y = (part.column(c) for c in "xy")
                if len(x) == 0:
                    continue
                sizes = np.diff(x.offsets.to_numpy())
                good = np.zeros(part.num_rows, dtype=bool)
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    u, v = (_units(np.asarray(c.take(pa.array(rows)).flatten()).reshape(-1, dim)) for c in (x, y))
                    good[rows] = (u * v).sum(axis=1) >= min_cosine
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good)) for c in "ab"], ["a", "b"])

    return run
