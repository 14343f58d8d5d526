"""Pooling, the built-in encoder, encoding of distinct texts, the pruned ranking grid, and the approximate kNN join."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_knn import brute, frame, points
from twinlink.operators import embed as E
from twinlink.operators.knn_approx import lsh_knn_join, lsh_reciprocal_knn
from twinlink.operators.pooling import mean_pool
from twinlink.plans import blocking, ranking
from twinlink.session import scratch_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mean_pool_sends_one_vector_for_a_task(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    rows = [(0 if i % 3 else i, i, v.tolist()) for i, v in enumerate(x)] + [(1000, 0, None), (0, 501, None)]
    tokens = spark.createDataFrame(rows, "record_id long, pos long, vec array<float>").repartition(4)
    pooled = mean_pool(tokens)
    got = {r.record_id: r.embeddings for r in pooled.collect()}
    for record in {r[0] for r in rows} - {1000}:
        own = np.array([v for r, _, v in rows if r == record and v is not None], dtype=np.float64)
        assert np.allclose(got[record], own.mean(axis=0))
    assert 1000 not in got
    shown = plan(pooled)
    assert "Generate" not in shown and shown.count("ObjectHashAggregate") + shown.count("SortAggregate") >= 2


def test_built_in_encoder_counts_words(spark):
    rng = random.Random(2)
    words = ["Word", "straße", "ÉCOLE", "x_1", "—", "数据", "  ", "a.b", "٣", "\n"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", ","]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "record_id int, text string, key string")
    out = E.hashed_words(df)
    got = {r.record_id: r.embeddings for r in out.collect()}
    for i, t in enumerate(texts):
        want = [0.0] * 32
        for word in re.findall(r"\w+", (t or "").lower()):
            want[int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % 32] += 1
        assert got[i] == want
    assert out.columns == ["record_id", "key", "embeddings", "created_at"]


def test_vectors_have_their_own_times(spark):
    import time

    def factory():
        def slow(texts):
            time.sleep(0.2)
            return [[1.0]] * len(texts)

        return slow

    df = spark.range(6).select(F.col("id").alias("record_id"), F.lit("t").alias("text")).coalesce(1)
    stamps = [r.created_at for r in E.embed_records(df, "d1", "m", lambda t: E.encode(t, factory, batch_rows=2)).collect()]
    assert len(set(stamps)) == 3


def test_equal_texts_are_encoded_once(spark, tmp_path):
    log = str(tmp_path / "encoded")

    def factory():
        def lengths(texts):
            with open(log, "a") as f:
                f.writelines(f"{t!r}\n" for t in texts)
            return [[float(len(t))] for t in texts]

        return lengths

    pairs = spark.createDataFrame([(f"a{i}", 0, f"b{j}") for i in range(6) for j in range(5)], "d1_id string, pos long, d2_id string")
    d1 = spark.createDataFrame([(f"a{i}", f"text {i % 3}") for i in range(7)], "record_id string, text string")
    d2 = spark.createDataFrame([(f"b{j}", f"text {'x' * (j % 2)}") for j in range(5)], "record_id string, text string")
    rows = E.embed_with_task(pairs, d1, d2, "m", lambda t: E.encode(t, factory)).collect()
    assert len(rows) == 6 + 30
    for r in rows:
        text = f"text {'x' * (int(r.record_id[1:]) % 2)}" if r.is_d2 else f"Instruct: {E.TASK}\nQuery: text {int(r.record_id[1:]) % 3}"
        assert r.embeddings == [float(len(text))]
    encoded = open(log).read().splitlines()
    assert len(encoded) == len(set(encoded)) == 5


def test_lists_are_joined_to_vectors_without_their_texts(spark):
    n = 40
    pairs = spark.createDataFrame([(f"a{i}", 0, f"b{j}") for i in range(n) for j in range(n)], "d1_id string, pos long, d2_id string")
    d1 = spark.createDataFrame([(f"a{i}", f"first {i}") for i in range(n)], "record_id string, text string")
    d2 = spark.createDataFrame([(f"b{j}", f"second {j % 7}") for j in range(n)], "record_id string, text string")
    assert E.task_texts(pairs, d1, d2).count() == 2 * n
    rows = E.embed_with_task(pairs, d1, d2, "m", E.hashed_words)
    assert rows.count() == n + n * n
    # Texts are grouped in hash tables; a sort of them would hold one row per list entry.
    assert "SortAggregate" not in plan(rows)


def grid_tables(spark):
    pairs = spark.createDataFrame([("D2", "1", "8", 0), ("D2", "1", "9", 1), ("D3", "1", "8", 0)], "dataset string, d1_id string, d2_id string, pos long")
    rows = [(s, side, r, [float(int(r)), float(k)], m) for s in ("D2", "D3") for k, m in enumerate(("m1", "m2", "m3")) for side, r in (("d1", "1"), ("d2", "8"), ("d2", "9"))]
    return pairs, spark.createDataFrame(rows, "source string, side string, record_id string, embeddings array<float>, model string")


def test_grid_reads_listed_models_only(spark):
    pairs, vectors = grid_tables(spark)
    path = scratch_path(spark, "vectors")
    vectors.write.partitionBy("model", "source").parquet(path)
    stored = spark.read.schema("side string, record_id string, embeddings array<float>, model string, source string").parquet(path)
    grid = ranking.grid_table(spark, [("D2", "m1", "cosine", False), ("D2", "m2", "cosine", False), ("D2", "m2", "euclidian", False)])
    scored = ranking.experiment_scores(pairs, stored, grid)
    assert scored.groupBy("dataset", "model", "metric").count().count() == 3 and scored.count() == 6
    shown = scored._jdf.queryExecution().toString()
    filters = [line for line in shown.splitlines() if "PartitionFilters" in line]
    assert filters and all(line.split("PartitionFilters: ")[1].startswith("[") for line in filters)
    listed = [line.split("PartitionFilters: ")[1].split("PushedFilters")[0] for line in filters]
    assert all("model#" in f and "source#" in f and "m3" not in f for f in listed)


def test_grid_fails_without_a_vector_or_a_known_metric(spark):
    pairs, vectors = grid_tables(spark)
    grid = ranking.grid_table(spark, [("D2", "m1", "cosine", False)])
    with pytest.raises(Exception, match="no vector for d2_id 9"):
        ranking.experiment_scores(pairs, vectors.filter("record_id <> '9'"), grid).collect()
    for bad in [("D2", "m1", "manhattan", False)], [("D2", "m1", "cosine", True)], []:
        with pytest.raises(ValueError):
            ranking.experiment_scores(pairs, vectors, ranking.grid_table(spark, bad) if bad else grid.filter("false"))


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_of_the_approximate_join(spark, clusters):
    a, b = points(1, 300, clusters), points(1, 1300, clusters)[300:]
    b[:50] = b[0]
    out = lsh_knn_join(frame(spark, a, "q"), frame(spark, b, "x"), 5, query_id="q", query_vec="vec", index_id="x", index_vec="vec")
    got = {}
    for r in out.collect():
        got.setdefault(r.q, {})[r.x] = (r.sq_dist, r.rank)
    want = brute(a, b, 5)
    hits = sum(len(set(want[i]) & set(got[i])) for i in want)
    assert hits >= 0.9 * 5 * len(a)
    assert all(len(v) == 5 and sorted(r for _, r in v.values()) == [1, 2, 3, 4, 5] for v in got.values()) and len(got) == len(a)
    for i, found in got.items():
        for j, (d, _) in found.items():
            assert d == pytest.approx(float(((a[i].astype(np.float64) - b[j].astype(np.float64)) ** 2).sum()))


def test_approximate_join_of_few_rows_is_exact(spark):
    a, b = points(3, 7), points(4, 4)
    args = dict(query_id="q", query_vec="vec", index_id="x", index_vec="vec")
    got = {}
    for r in lsh_knn_join(frame(spark, a, "q"), frame(spark, b, "x"), 6, metric="euclidian", bucket_length=1e-9, **args).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.x)
    assert got == brute(a, b, 6)
    assert lsh_knn_join(frame(spark, a, "q"), frame(spark, b, "x").limit(0), 6, **args).count() == 0
    assert lsh_reciprocal_knn(frame(spark, a, "d1_id"), frame(spark, b, "d2_id"), 2, metric="cosine").columns == ["d1_id", "d2_id", "sq_dist"]


def test_blocking_takes_the_approximate_join_on_request(spark):
    d1 = spark.createDataFrame([(str(i), f"word{i} other{i}") for i in range(30)], "id string, title string")
    exact = blocking.candidate_pairs(d1, d1, E.hashed_words, k=2)
    near = blocking.candidate_pairs(d1, d1, E.hashed_words, k=2, approximate=True)
    both = exact.select("d1_id", "d2_id").intersect(near.select("d1_id", "d2_id")).count()
    assert both >= 0.9 * exact.count()
