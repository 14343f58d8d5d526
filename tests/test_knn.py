import numpy as np
import pyarrow as pa
import pytest

from twinlink.operators import knn
from twinlink.operators.knn import knn_join, limit_copies, reciprocal_knn
from twinlink.session import materialise

DIM = 6


def points(seed, n, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIM))
    if clusters:
        x = x * 0.05 + rng.normal(size=(clusters, DIM))[rng.integers(0, clusters, n)] * 5
    return np.round(x, 3).astype(np.float32)


def frame(spark, x, name, start=0, text=False):
    kind = "string" if text else "long"
    rows = [(str(i + start) if text else i + start, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} {kind}, vec array<float>")


def brute(a, b, k, text=False):
    """The k nearest by squared distance, then by id."""
    out = {}
    for i, v in enumerate(a.astype(np.float64)):
        d = ((v - b.astype(np.float64)) ** 2).sum(axis=1)
        order = sorted(range(len(b)), key=lambda j: (d[j], str(j) if text else j))
        out[i] = [j for j in order[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(int(r.q), []).append(int(r.x))
    return out


def join(spark, a, b, k, text=False, **how):
    return knn_join(
        frame(spark, a, "q", text=text), frame(spark, b, "x", text=text), k,
        query_id="q", query_vec="vec", index_id="x", index_vec="vec", **how,
    )


@pytest.mark.parametrize("how", [{}, {"block_rows": 7}, {"block_rows": 7, "pivots": 6}, {"block_rows": 50, "pivots": 3}])
@pytest.mark.parametrize("clusters", [0, 5])
def test_equals_brute_force(spark, how, clusters):
    a, b = points(1, 60, clusters), points(1, 90, clusters)[30:]
    assert found(join(spark, a, b, 4, **how)) == brute(a, b, 4)


@pytest.mark.parametrize("how", [{}, {"block_rows": 9, "pivots": 4}])
def test_a_third_of_copies(spark, how):
    a, b = points(3, 60), points(4, 90)
    a[:20] = a[0]
    b[::3] = a[0]
    assert found(join(spark, a, b, 5, **how)) == brute(a, b, 5)


def test_string_ids_break_ties_as_text(spark):
    a, b = points(5, 10), points(6, 30)
    b[:] = b[0]
    assert found(join(spark, a, b, 3, text=True)) == brute(a, b, 3, text=True)


def test_fewer_index_rows_than_k(spark):
    a, b = points(7, 5), points(8, 3)
    assert found(join(spark, a, b, 10)) == brute(a, b, 10)


def test_cosine_ignores_length(spark):
    a, b = points(9, 20), points(10, 40)
    scaled = b * np.linspace(0.5, 4, 40, dtype=np.float32)[:, None]
    assert found(join(spark, a, b, 3, metric="cosine")) == found(join(spark, a, scaled, 3, metric="cosine"))


def test_unequal_lengths_fail(spark):
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "x long, vec array<float>")
    with pytest.raises(ValueError, match="unequal length"):
        knn_join(frame(spark, points(1, 3), "q"), bad, 1, query_id="q", query_vec="vec", index_id="x", index_vec="vec")


def test_copies_beyond_k_are_dropped(spark):
    rows = [(i, [1.0, 2.0]) for i in range(9)] + [(9, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    assert sorted(r.id for r in limit_copies(df, "id", "vec", 3).collect()) == [0, 1, 2, 9]


@pytest.mark.parametrize("how", [{}, {"block_rows": 8, "pivots": 4}])
def test_reciprocal_pairs_are_symmetric_and_exact(spark, how):
    a, b = points(11, 50, 4), points(12, 70, 4)
    a[:15] = b[3]
    b[:25] = b[3]
    there, back = brute(a, b, 4), brute(b, a, 4)
    want = {(i, j) for i, js in there.items() for j in js if i in back[j]}
    d1, d2 = frame(spark, a, "d1_id"), frame(spark, b, "d2_id")
    got = {(r.d1_id, r.d2_id) for r in reciprocal_knn(d1, d2, 4, **how).collect()}
    swapped = reciprocal_knn(d2, d1, 4, d1_id="d2_id", d2_id="d1_id", **how)
    assert got == want
    assert {(r.d1_id, r.d2_id) for r in swapped.collect()} == want


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_vectors_are_never_sent_to_the_driver(spark):
    rows = [(i, i % 3, [float(i), 1.0]) for i in range(60)]
    vectors = materialise(spark.createDataFrame(rows, "id long, cell int, vec array<float>"))
    cells = spark.createDataFrame([(c, 2) for c in range(3)], "cell int, blocks int")
    packed = knn._pack(vectors, knn._Layout(60, 2, 10), cells)
    assert "BuildRight" in _plan(packed) and "BuildLeft" not in _plan(packed)
    blocks = materialise(packed)
    targets = blocks.selectExpr("cell AS q_cell", "block AS q_block", "cell AS x_cell", "2 AS x_blocks")
    assert "Broadcast" not in _plan(knn._meet(blocks, blocks, materialise(targets)))


def test_float_blocks_hold_four_bytes_a_number(spark):
    for kind, size in (("float", 4), ("double", 8)):
        vectors = spark.createDataFrame([(i, [i + 0.1, 2.0, 3.0]) for i in range(20)], f"id long, vec array<{kind}>")
        packed = knn._pack(vectors, knn._Layout(20, 3, 5)).collect()
        assert sum(len(r.vecs) for r in packed) == 20 * 3 * size


def test_a_query_block_keeps_no_batch_in_memory():
    ids = pa.array(np.arange(100_000))
    vecs = pa.array([np.arange(60.0).tobytes(), bytes(1 << 20)], pa.binary())
    near = knn._Nearest(ids[10:20], knn._as_rows(vecs[0], 10, DIM), 3)
    assert near.ids.to_pylist() == list(range(10, 20)) and near.q.ravel().tolist() == list(range(60))
    assert near.ids.get_total_buffer_size() < 1000 and near.q.flags.owndata


def test_index_blocks_are_copied_once_for_a_long_query_block(spark, monkeypatch):
    a, b, copies = points(7, 400), points(8, 300), []
    meet = knn._meet

    def spy(queries, index, targets):
        copies.append(targets.selectExpr("coalesce(sum(x_blocks), 0)").first()[0])
        return meet(queries, index, targets)

    monkeypatch.setattr(knn, "_meet", spy)
    assert found(join(spark, a, b, 4, block_rows=10, pivots=3)) == brute(a, b, 4)
    # 400 queries in blocks of 40, but for one that is not full in each of three cells; 300 vectors in blocks of 10.
    assert len(copies) == 2 and sum(copies) <= (400 // 40 + 3) * (300 // 10 + 3)
    long = points(9, knn.MAX_BLOCK_ROWS + 50)
    assert found(join(spark, long, b, 3, block_rows=len(long), pivots=2)) == brute(long, b, 3)


def test_copies_of_blocks_grow_with_the_blocks_only(spark):
    copies = {}
    for n in (16, 64):
        rows = [(0, b, [b], bytes(8)) for b in range(n)]
        blocks = materialise(spark.createDataFrame(rows, "cell int, block int, ids array<long>, vecs binary"))
        targets = spark.createDataFrame([(0, b, 0, n) for b in range(n)], "q_cell int, q_block int, x_cell int, x_blocks int")
        copies[n] = sum(side.count() for side in knn._copies(blocks, blocks, targets))
        met = [(r.q_block, r.x_block) for r in knn._meet(blocks, blocks, targets).collect()]
        assert sorted(met) == [(i, j) for i in range(n) for j in range(n)]
    assert copies[64] <= 4 * copies[16]


def test_groups_hold_no_more_blocks_than_may_share_a_key(spark):
    n = 10 * knn.KEY_FANOUT
    rows = spark.range(n).selectExpr("int(id % 5) AS cell", "int(id div 5) AS block")
    held = rows.withColumn("g", knn._group({c: n // 5 for c in range(5)}, "cell", "block", knn.KEY_FANOUT)).groupBy("g").count()
    assert sorted((r.g, r["count"]) for r in held.collect()) == [(g, knn.KEY_FANOUT) for g in range(10)]


def test_a_limit_keeps_all_that_is_as_near(spark):
    ids, q = pa.array([1, 2]), np.zeros((2, 2))
    x = np.array([[3.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 2.0]])
    near = knn._Nearest(ids, q, 3, np.array([4.0, 0.5]))
    near.add(np.arange(4), x)
    assert near.rows.tolist() == [0, 0, 0] and near.found.tolist() == [1, 2, 3] and near.dist.tolist() == [1.0, 4.0, 4.0]
