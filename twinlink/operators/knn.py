"""Exact k-nearest-neighbour join of two vector tables.

The distance matrix is covered by blocks. Both tables are hashed into blocks of bounded size, every block is packed
into one row (ids plus one flat float array), and one row pair at a time is scored by matrix products inside an
Arrow batch. Only the ``k`` best per query leave a block pair; ``row_number() <= k`` then merges them, with the
window's group limit applied before the shuffle as well.

Three properties matter at scale:

* hashing splits every group of rows, so a dense region or a group of copies never lands in one task;
* of identical index vectors only the ``k`` smallest ids can be among anyone's ``k`` nearest (ties go to the smaller
  id), so copies beyond that are removed before the join without changing its result;
* above a few blocks the index is cut into cells around pivot vectors. A first round visits each query's home cells
  and gives an upper bound on its k-th distance; the triangle inequality then rules out every cell that cannot hold a
  nearer vector, and the second round visits all the others. No neighbour is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.functions.vectors import as_matrix, l2_normalize
from twinlink.schema import COSINE, EUCLIDEAN
from twinlink.session import materialise

BLOCK_BYTES = 2 << 20
MAX_BLOCK_ROWS = 2048
MAX_PIVOTS = 512
# Between cells, a query block is as long as so many index blocks.
QUERY_BLOCKS = 4
# A block is copied once per group of the other side's blocks that it meets. The number of groups stays the same until a
# group holds as many index blocks, or query blocks as long as these, as may meet under one shuffle key.
GROUPS = 6
KEY_FANOUT = 64
# Allowance for rounding in the bounds on cells, relative to the length of the vectors.
SLACK = 1e-6
# Bytes of one temporary array of doubles; a few of them are held at once.
WORK_BYTES = 4 << 20


@dataclass(frozen=True)
class _Layout:
    rows: int
    dim: int
    block_rows: int

    @property
    def blocks(self) -> int:
        return max(1, -(-self.rows // self.block_rows))


def limit_copies(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """Of identical vectors keep the ``k`` smallest ids."""
    w = Window.partitionBy(F.xxhash64(vec_col), F.col(vec_col)).orderBy(id_col)
    return df.withColumn("_copy", F.row_number().over(w)).filter(F.col("_copy") <= k).drop("_copy")


def _measure(df: DataFrame, vec_col: str, block_rows: int | None) -> _Layout:
    """Row count and vector length; vectors of different length are an error."""
    row = df.agg(
        F.count("*").alias("n"), F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi")
    ).first()
    if row.n and row.lo != row.hi:
        raise ValueError(f"vectors of unequal length: {row.lo} to {row.hi}")
    dim = max(1, row.hi or 1)
    return _Layout(row.n, dim, block_rows or max(1, min(MAX_BLOCK_ROWS, BLOCK_BYTES // (4 * dim))))


def _standardise(df: DataFrame, id_col: str, vec_col: str, metric: str) -> DataFrame:
    vec = F.col(vec_col)
    if metric == COSINE:
        vec = l2_normalize(vec)
    elif metric != EUCLIDEAN:
        raise ValueError(f"unknown metric: {metric}")
    return df.select(F.col(id_col).alias("id"), vec.alias("vec"))


@F.arrow_udf(T.BinaryType())
def _as_bytes(vecs: pa.Array) -> pa.Array:
    # Floats stay floats on their way; whatever is computed with them is computed in doubles.
    return pa.array([v.values.to_numpy(zero_copy_only=False).tobytes() for v in vecs], type=pa.binary())


def _as_rows(vecs: pa.Scalar, n: int, dim: int) -> np.ndarray:
    """A copy: a view would keep the whole Arrow batch in memory."""
    buffer = vecs.as_buffer()
    kind = np.float32 if buffer.size == 4 * n * dim else np.float64
    return np.frombuffer(buffer, dtype=kind).reshape(n, dim).astype(np.float64)


def _pack(df: DataFrame, layout: _Layout, cell_blocks: DataFrame | None = None) -> DataFrame:
    """One row per block: its cell and number, its ids in order, and their vectors as one run of bytes."""
    if cell_blocks is None:
        df = df.withColumns({"cell": F.lit(0), "blocks": F.lit(layout.blocks)})
    else:
        # A row per cell, of a size Catalyst does not know; it would rather send the vectors around.
        df = df.join(F.broadcast(cell_blocks), "cell")
    rows = F.array_sort(F.collect_list(F.struct("id", "vec")))
    return (
        df.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .groupBy("cell", "block")
        .agg(rows.alias("rows"))
        .select("cell", "block", F.col("rows.id").alias("ids"), _as_bytes(F.flatten("rows.vec")).alias("vecs"))
    )


def _screen(q: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray) -> tuple:
    """Row and column of every pair that may be among the ``k`` nearest of its row and within the row's ``limit``.

    In single precision, by |x|^2 - 2xy, which orders a row as the distance does. The k-th smallest of the minima of
    column groups bounds the k-th smallest value from above at a fraction of the cost of selecting it; the allowance
    covers the rounding of a product of that length.
    """
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    value = q.astype(np.float32) @ x.astype(np.float32).T
    value *= np.float32(-2.0)
    value += x2.astype(np.float32)[None, :]
    groups = np.arange(0, x.shape[0], max(1, x.shape[0] // max(64, 4 * k)))
    minima = np.minimum.reduceat(value, groups, axis=1)
    if minima.shape[1] < k:
        minima = value
    bound = np.minimum(np.partition(minima, k - 1, axis=1)[:, k - 1], limit - q2)
    scale = np.sqrt(q2 * x2.max()) + q2 + x2.max() + np.finfo(np.float32).tiny
    allowance = 4.0 * (q.shape[1] + 8) * np.finfo(np.float32).eps * scale
    return np.divmod(np.flatnonzero(value <= (bound + allowance).astype(np.float32)[:, None]), x.shape[0])


class _Nearest:
    """The ``k`` nearest so far for the rows of one query block."""

    def __init__(self, ids: pa.Array, q: np.ndarray, k: int, limit: np.ndarray | None = None):
        # A query block stays while batches come and go; a slice of its ids would keep the first of them.
        self.ids, self.q, self.k = ids.take(pa.array(np.arange(len(ids)))), q, k
        self.limit = np.full(len(q), np.inf) if limit is None else limit
        self.rows, self.dist, self.found = np.zeros(0, dtype=np.int64), np.zeros(0), None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take in a block of the index.

        What passes the screen is measured by differences in double precision, so that the distance of a pair does
        not depend on the block it met in. Equal distances go to the smaller id.
        """
        parts = []
        for at in range(0, len(self.q), MAX_BLOCK_ROWS):
            part = slice(at, at + MAX_BLOCK_ROWS)
            rows, cols = _screen(self.q[part], x, min(self.k, len(x)), self.limit[part])
            parts.append((rows + at, cols))
        rows, cols = (np.concatenate(column) for column in zip(*parts))
        exact = np.empty(len(rows))
        step = max(1, WORK_BYTES // (8 * x.shape[1]))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            diff = self.q[rows[part]] - x[cols[part]]
            exact[part] = (diff * diff).sum(axis=1)
        found = ids[cols] if self.found is None else np.concatenate([self.found, ids[cols]])
        rows, dist = np.concatenate([self.rows, rows]), np.concatenate([self.dist, exact])
        order = np.lexsort((found, dist, rows))
        rows, dist, found = rows[order], dist[order], found[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        self.rows, self.dist, self.found = rows[keep], dist[keep], found[keep]
        last = place == self.k - 1
        self.limit[rows[last]] = dist[last]


def _comparable(ids: pa.Array) -> np.ndarray:
    """Ids as a numpy array that sorts as Spark does."""
    if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type):
        return np.array(ids.to_pylist(), dtype=str)
    return ids.to_numpy(zero_copy_only=False)


def _score_blocks(pairs: DataFrame, k: int, dim: int, both: bool = False) -> DataFrame:
    """Rows ``(side, q_cell, q_block, q_id, x_id, sq_dist)``.

    Side 0 holds query -> index; with ``both``, side 1 holds index -> query from the same product. Where query blocks
    bring ``q_limits``, the distance per query beyond which no neighbour matters, what lies farther away is left out.
    """
    id_type = pairs.schema["q_ids"].dataType.elementType

    def emit(side: int, q_key: tuple, near: _Nearest) -> pa.RecordBatch:
        n = len(near.rows)
        q_ids, x_ids = near.ids.take(pa.array(near.rows)), pa.array(near.found).cast(near.ids.type)
        marks = [pa.array(np.full(n, m, dtype=np.int32)) for m in (side, *q_key)]
        names = ["side", "q_cell", "q_block", "q_id", "x_id", "sq_dist"]
        return pa.RecordBatch.from_arrays([*marks, q_ids, x_ids, pa.array(near.dist)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of one query block follow each other, so that their best are merged before they leave.
        at, near = None, None
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                q_key = (cols["q_cell"][i].as_py(), cols["q_block"][i].as_py())
                q_ids, x_ids = cols["q_ids"][i].values, cols["x_ids"][i].values
                x = _as_rows(cols["x_vecs"][i], len(x_ids), dim)
                if q_key != at:
                    if near is not None:
                        yield emit(0, at, near)
                    limit = np.array(cols["q_limits"][i].values, dtype=np.float64) if "q_limits" in cols else None
                    at, near = q_key, _Nearest(q_ids, _as_rows(cols["q_vecs"][i], len(q_ids), dim), k, limit)
                near.add(_comparable(x_ids), x)
                if both:
                    back = _Nearest(x_ids, x, k)
                    back.add(_comparable(q_ids), near.q)
                    yield emit(1, q_key, back)
        if near is not None:
            yield emit(0, at, near)

    schema = T.StructType(
        [
            T.StructField("side", T.IntegerType()),
            T.StructField("q_cell", T.IntegerType()),
            T.StructField("q_block", T.IntegerType()),
            T.StructField("q_id", id_type),
            T.StructField("x_id", id_type),
            T.StructField("sq_dist", T.DoubleType()),
        ]
    )
    return pairs.mapInArrow(run, schema)


def _by_cell(values: dict[int, object], cell: str, kind: str) -> Column:
    """A value per cell as a constant; other cells have none."""
    listed = [values.get(c) for c in range(max(values, default=0) + 1)]
    return F.get(F.from_json(F.lit(json.dumps(listed)), f"array<{kind}>"), F.col(cell))


def _group(sizes: dict[int, int], cell: str, block: str, fanout: int) -> Column:
    """The group of a block, as a part of all blocks in order of cell and number; ``sizes`` has the blocks per cell."""
    cells, total = sorted(sizes), sum(sizes.values())
    starts = dict(zip(cells, accumulate((sizes[c] for c in cells), initial=0)))
    groups = min(total, max(GROUPS, -(-total // fanout)))
    place = _by_cell(starts, cell, "int") + F.col(block)
    return F.floor(place * F.lit(groups) / F.lit(max(1, total))).cast("int")


def _meet(queries: DataFrame, index: DataFrame, targets: DataFrame) -> DataFrame:
    """Block pairs to score, one per row; ``targets`` lists ``(q_cell, q_block, x_cell, x_blocks)``.

    A task holds the index blocks of a key and takes the query blocks one by one. Blocks are shuffled and never broadcast:
    a table of vectors does not belong on the driver, however well its files are compressed.
    """
    q, x = _copies(queries, index, targets)
    pairs = q.hint("merge").join(x, ["q_group", "x_group"]).filter(F.array_contains("x_cells", F.col("x_cell")))
    return pairs.drop("q_group", "x_group", "x_cells")


def _copies(queries: DataFrame, index: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' blocks, one row per group of the other side that a block has to meet.

    The blocks of a side are dealt into groups, and two groups share one key. So a block is copied once per group and not
    once per block: at most ``GROUPS`` times, as long as ``KEY_FANOUT`` allows. The driver gets a row per cell.
    """
    q_sizes = dict(targets.groupBy("q_cell").agg(F.max("q_block") + 1).collect())
    q_group = _group(q_sizes, "q_cell", "q_block", max(1, KEY_FANOUT // QUERY_BLOCKS))
    asked = targets.groupBy("x_cell").agg(F.max("x_blocks").alias("n"), F.collect_set(q_group).alias("groups")).collect()
    x_group = _group({r.x_cell: r.n for r in asked}, "x_cell", "x_block", KEY_FANOUT)
    q_groups = _by_cell({r.x_cell: r.groups for r in asked}, "x_cell", "array<int>")

    x = _prefix(index, "x").withColumns({"x_group": x_group, "q_group": F.explode(q_groups)})
    met = targets.withColumn("x_block", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))).withColumn("x_group", x_group)
    met = met.groupBy("q_cell", "q_block", "x_group").agg(F.collect_set("x_cell").alias("x_cells"))
    q = _prefix(queries, "q").hint("merge").join(met, ["q_cell", "q_block"]).withColumn("q_group", q_group)
    return q, x


def _prefix(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns])


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("side", "q_id").orderBy("sq_dist", "x_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The nearest pivot of every vector and the distance to it."""

    @F.arrow_udf("struct<cell:int,dist:double>")
    def nearest(vec: pa.Array) -> pa.Array:
        rows, step = as_matrix(vec), max(1, WORK_BYTES // (32 * len(pivots)))
        cell, dist = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows))
        for at in range(0, len(rows), step):
            gaps = _distances(rows[at : at + step], pivots)
            cell[at : at + step], dist[at : at + step] = gaps.argmin(axis=1), gaps.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], names=["cell", "dist"])

    return df.withColumn("near", nearest("vec")).select("id", "vec", "near.cell", "near.dist")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.zeros((0, len(b)))
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _pivoted(
    queries: DataFrame, index: DataFrame, q_layout: _Layout, x_layout: _Layout, k: int, n_pivots: int
) -> DataFrame:
    """Two rounds over the cells; only tables of at most ``MAX_PIVOTS`` rows are held on the driver.

    Both tables are read several times: what it takes to prepare them should have been written before.
    """
    spark = queries.sparkSession
    q_layout = replace(q_layout, block_rows=q_layout.block_rows * QUERY_BLOCKS)
    chosen = index.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("vec").collect()
    pivots = np.array([r.vec for r in chosen], dtype=np.float64)

    q_cells, x_cells = _assign(queries, pivots), _assign(index, pivots)
    sizes = {r.cell: r for r in x_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    q_sizes = {r.cell: r.n for r in q_cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def blocks_of(n: int, layout: _Layout) -> int:
        return -(-n // layout.block_rows)

    x_count = [(c, blocks_of(r.n, x_layout)) for c, r in sizes.items()]
    q_count = [(c, blocks_of(n, q_layout)) for c, n in q_sizes.items()]
    x_blocks = materialise(_pack(x_cells, x_layout, spark.createDataFrame(x_count, "cell int, blocks int")))
    q_blocks = materialise(_pack(q_cells, q_layout, spark.createDataFrame(q_count, "cell int, blocks int")))

    # Home cells: the nearest cells that together hold k vectors.
    between = _distances(pivots, pivots)
    home: dict[int, list[int]] = {}
    for c in q_sizes:
        held = 0
        home[c] = []
        for j in between[c].argsort(kind="stable").tolist():
            if j in sizes and held < k:
                home[c].append(j)
                held += sizes[j].n
    blocks = dict(x_count)
    home_rows = [(c, j, blocks[j]) for c, cells in home.items() for j in cells]
    home_df = spark.createDataFrame(home_rows, "q_cell int, x_cell int, x_blocks int")

    keys = q_blocks.select(F.col("cell").alias("q_cell"), F.col("block").alias("q_block"))
    first = _score_blocks(_meet(q_blocks, x_blocks, keys.join(F.broadcast(home_df), "q_cell")), k, x_layout.dim)
    first = materialise(_best(first, k).drop("rank"))

    # Per query the k-th distance so far; a cell that lies farther away cannot matter.
    kth = first.groupBy("q_cell", "q_block", "q_id").agg(F.max("sq_dist").alias("kth"))
    bounds = kth.groupBy("q_cell", "q_block").agg(
        F.array_sort(F.collect_list(F.struct("q_id", "kth"))).alias("rows")
    )
    cells = np.array(sorted(sizes))
    radius = np.array([sizes[c].r for c in cells])
    centres = pivots[cells]
    largest = np.sqrt((pivots * pivots).sum(axis=1).max())

    @F.arrow_udf("array<int>")
    def remaining(q_cell: pa.Array, vecs: pa.Array, reach: pa.Array) -> pa.Array:
        out = []
        for c, v, b in zip(q_cell.to_pylist(), vecs, reach):
            b = np.sqrt(np.asarray(b.values, dtype=np.float64))
            q = _as_rows(v, len(b), centres.shape[1])
            gaps, own = _distances(q, centres), _distances(q, pivots[c : c + 1])
            # A member of a cell is nearer to that cell's pivot than to this one, hence beyond the plane between them.
            # Pivots that nearly coincide give no usable plane.
            size = np.sqrt((q * q).sum(axis=1).max()) + largest
            apart = between[c, cells]
            plane = (gaps**2 - own**2) / np.where(apart > 1e-3 * size, 2.0 * apart, np.inf)
            nearest = np.maximum(gaps - radius, plane)
            needed = (nearest <= b[:, None] + SLACK * size).any(axis=0)
            out.append([int(j) for j in cells[needed] if j not in home[c]])
        return pa.array(out, type=pa.list_(pa.int32()))

    targets = (
        q_blocks.select(F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), "vecs")
        .hint("merge")
        .join(bounds, ["q_cell", "q_block"])
        .select("q_cell", "q_block", F.explode(remaining("q_cell", "vecs", "rows.kth")).alias("x_cell"))
        .join(F.broadcast(spark.createDataFrame(x_count, "x_cell int, x_blocks int")), "x_cell")
    )
    limits = bounds.select(F.col("q_cell").alias("cell"), F.col("q_block").alias("block"), F.col("rows.kth").alias("limits"))
    limited = q_blocks.hint("merge").join(limits, ["cell", "block"])
    second = _score_blocks(_meet(limited, x_blocks, materialise(targets)), k, x_layout.dim)
    return _best(first.unionByName(second), k)


def _pivot_count(layout: _Layout, pivots: int | None) -> int:
    """Cells of about eight blocks, at most ``MAX_PIVOTS`` of them; fewer than two cells mean the plain grid."""
    return min(MAX_PIVOTS, layout.blocks // 8 if pivots is None else pivots, layout.rows)


def knn_join(
    query: DataFrame,
    index: DataFrame,
    k: int = 10,
    *,
    query_id: str,
    query_vec: str,
    index_id: str,
    index_vec: str,
    metric: str = EUCLIDEAN,
    block_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """The ``k`` nearest ``index`` rows of every ``query`` row as ``(query_id, index_id, sq_dist, rank)``.

    Both sides hold unique ids of the same type. For the cosine metric the distance is taken between unit vectors,
    which orders pairs as the inner product does.
    """
    q_layout, x_layout = _measure(query, query_vec, block_rows), _measure(index, index_vec, block_rows)
    q = _standardise(query, query_id, query_vec, metric)
    x = limit_copies(_standardise(index, index_id, index_vec, metric), "id", "vec", k)
    n_pivots = _pivot_count(x_layout, pivots)
    if n_pivots >= 2:
        best = _pivoted(q, materialise(x), q_layout, x_layout, k, n_pivots)
    else:
        best = _best(_grid(q, x, q_layout, x_layout, k, both=False), k)
    return best.select(F.col("q_id").alias(query_id), F.col("x_id").alias(index_id), "sq_dist", "rank")


def _grid(q: DataFrame, x: DataFrame, q_layout: _Layout, x_layout: _Layout, k: int, both: bool) -> DataFrame:
    """Every query block against every index block of the only cell."""
    blocks = q.sparkSession.range(q_layout.blocks)
    targets = blocks.select(
        F.lit(0).alias("q_cell"),
        F.col("id").cast("int").alias("q_block"),
        F.lit(0).alias("x_cell"),
        F.lit(x_layout.blocks).alias("x_blocks"),
    )
    return _score_blocks(_meet(_pack(q, q_layout), _pack(x, x_layout), targets), k, x_layout.dim, both)


def reciprocal_knn(
    d1: DataFrame,
    d2: DataFrame,
    k: int = 10,
    *,
    d1_id: str = "d1_id",
    d1_vec: str = "vec",
    d2_id: str = "d2_id",
    d2_vec: str = "vec",
    metric: str = EUCLIDEAN,
    block_rows: int | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """Pairs that are among each other's ``k`` nearest, as ``(d1_id, d2_id, sq_dist)``.

    A record can only be on a partner's list when it is one of the ``k`` smallest ids of its vector, so both sides
    drop their surplus copies first. On the plain grid one product serves both directions.
    """
    a_layout, b_layout = _measure(d1, d1_vec, block_rows), _measure(d2, d2_vec, block_rows)
    a = limit_copies(_standardise(d1, d1_id, d1_vec, metric), "id", "vec", k)
    b = limit_copies(_standardise(d2, d2_id, d2_vec, metric), "id", "vec", k)
    a_pivots, b_pivots = _pivot_count(a_layout, pivots), _pivot_count(b_layout, pivots)
    if min(a_pivots, b_pivots) >= 2:
        a, b = materialise(a), materialise(b)
        there = _pivoted(a, b, a_layout, b_layout, k, b_pivots).select("q_id", "x_id", "sq_dist")
        back = _pivoted(b, a, b_layout, a_layout, k, a_pivots).select(
            F.col("x_id").alias("q_id"), F.col("q_id").alias("x_id"), "sq_dist"
        )
        listed = there.unionByName(back)
    else:
        best = _best(_grid(a, b, a_layout, b_layout, k, both=True), k)
        listed = best.select(
            F.when(F.col("side") == 0, F.col("q_id")).otherwise(F.col("x_id")).alias("q_id"),
            F.when(F.col("side") == 0, F.col("x_id")).otherwise(F.col("q_id")).alias("x_id"),
            "sq_dist",
        )
    return (
        listed.groupBy(F.col("q_id").alias(d1_id), F.col("x_id").alias(d2_id))
        .agg(F.count("*").alias("lists"), F.min("sq_dist").alias("sq_dist"))
        .filter(F.col("lists") == 2)
        .drop("lists")
    )
