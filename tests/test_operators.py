import random

import pytest
from pyspark.sql import functions as F

from twinlink.operators import metrics, pairs, pooling, rank, resume, timing, topk
from twinlink.operators.registry import check_prompt_mode, dataset_manifest, model_registry


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def scored(spark, lists):
    out = [(d1, d2, pos, float(score)) for d1, cands in lists.items() for pos, (d2, score) in enumerate(cands)]
    return spark.createDataFrame(out, "d1_id string, d2_id string, pos long, score double")


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_rank_of_a_hot_key_equals_the_plain_rank(spark, hot_rows):
    rng = random.Random(5)
    data = [("hot" if i % 3 else f"k{i % 11}", i, rng.choice([0.1, 0.5, 0.5, 0.9])) for i in range(300)]
    df = spark.createDataFrame(data, "d1_id string, pos long, score double")
    got = rank.rank_within(df, ["d1_id"], rank.best_first(), hot_rows=hot_rows)
    want = []
    for key in {d[0] for d in data}:
        ordered = sorted((d for d in data if d[0] == key), key=lambda d: (-d[2], d[1]))
        want += [(*d, i + 1) for i, d in enumerate(ordered)]
    assert rows(got.select("d1_id", "pos", "score", "rank")) == sorted(want)


def test_long_lists_continue_in_parts(spark):
    df = spark.createDataFrame([("a", i, str(i)) for i in range(7)] + [("b", 0, "x")], "d1_id string, pos long, d2_id string")
    lists = pairs.group_candidates(df, list_rows=3)
    assert rows(lists) == [("a", 0, ["0", "1", "2"]), ("a", 1, ["3", "4", "5"]), ("a", 2, ["6"]), ("b", 0, ["x"])]
    assert rows(pairs.ungroup_candidates(lists, list_rows=3)) == rows(df)


def test_topk_counts(spark):
    lists = {
        "hit2": [("x", 0.9), ("good", 0.8), ("y", 0.1)],
        "short_hit": [("good", 0.9)],
        "short_miss": [("x", 0.9), ("y", 0.8)],
        "unknown": [("x", 0.9)],
    }
    gt = spark.createDataFrame([(d, "good") for d in ("hit2", "short_hit", "short_miss", "absent")], "d1_id string, d2_id string")
    df = scored(spark, lists)
    # k=1: short_hit hits; hit2 and short_miss miss. k=3: hit2 adds min(3,3)-1, short_hit 0, a miss always k.
    assert rows(topk.topk_confusion(df, gt, 3)) == [(1, 1, 2), (2, 2, 3), (3, 2, 5)]
    report = {r.k: r for r in topk.topk_report(df, gt, 3).collect()}
    assert report[2].recall == 2 / 4 and report[2].precision == 2 / 5
    assert rows(topk.unmatched_d1(df, gt)) == [("unknown",)]


def test_topk_of_several_data_sets(spark):
    df = scored(spark, {"a": [("good", 1.0), ("x", 0.5)]})
    df = df.withColumn("dataset", F.lit("D2")).unionByName(df.withColumn("dataset", F.lit("D3")))
    gt = spark.createDataFrame([("D2", "a", "good"), ("D3", "a", "x"), ("D3", "b", "y")], "dataset string, d1_id string, d2_id string")
    report = topk.topk_report(df, gt, 2, by=["dataset"])
    assert rows(report.select("dataset", "k", "recall")) == [("D2", 1, 1.0), ("D2", 2, 1.0), ("D3", 1, 0.0), ("D3", 2, 0.5)]
    wide = topk.widen_report(report, ["dataset"], 2).orderBy("dataset").collect()
    assert wide[0].top_1_f1 == 1.0 and wide[1].top_1_f1 is None


def test_equal_scores_go_by_position(spark):
    df = scored(spark, {"a": [("x", 0.5), ("y", 0.5), ("z", 0.7)]})
    assert rows(rank.top1_prediction(df)) == [("a", "z", 0.7)]
    ranked = rank.rank_within(df, ["d1_id"], rank.best_first())
    assert rank.order_candidates(ranked).first().sorted_d2_ids == ["z", "x", "y"]


GT = [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")]


def confusion(spark, predicted):
    gt = spark.createDataFrame(GT, "d1_id string, d2_id string")
    df = spark.createDataFrame(predicted, "d1_id string, d2_id string")
    return metrics.pair_metrics(metrics.pair_confusion(df, gt)).first()


def test_pair_confusion(spark):
    # A hit, a repeated hit, a wrong partner (FP, not FN), a record without ground truth (nothing); 3 and 4 are FN.
    got = confusion(spark, [("1", "a"), ("1", "a"), ("2", "x"), ("9", "z")])
    assert (got.tp, got.fp, got.fn) == (2, 1, 2)
    assert got.accuracy == 40.0 and got.recall == 50.0
    assert abs(got.precision - 200 / 3) < 1e-9 and abs(got.f1 - 400 / 7) < 1e-9


def test_no_predictions_are_all_zero(spark):
    got = confusion(spark, [])
    assert (got.tp, got.fp, got.fn) == (0, 0, 4)
    assert got.accuracy == got.precision == got.recall == got.f1 == 0.0


def test_published_identities_hold(spark):
    got = confusion(spark, [("1", "a"), ("2", "x"), ("3", "c"), ("3", "y")])
    p, r = got.precision / 100, got.recall / 100
    assert abs(got.f1 / 100 - 2 * p * r / (p + r)) < 1e-12
    assert abs(got.accuracy / 100 - 1 / (1 / p + 1 / r - 1)) < 1e-12


def active_loop(stamps, threshold=3600):
    """The definition: a gap over the threshold becomes the time so far divided by its number. Stamps are in micros."""
    stamps = sorted(set(stamps))
    total = 0.0
    for i in range(1, len(stamps)):
        gap = (stamps[i] - stamps[i - 1]) / 1e6
        total += total / i if gap > threshold else gap
    return total


SERIES = {
    "no gaps": [0, 10, 20, 3620],
    "long gap first": [0, 5000, 5010, 5020],
    "two long gaps": [0, 100, 200, 10000, 20000, 20005],
    "exactly the threshold": [0, 3600, 7200, 10801],
}


def random_series(rng):
    """Many gaps at, just below and just above the threshold, in micros."""
    gaps = [rng.choice([0, 1, 30, 900, 3599.999999, 3600, 3600.000001, 9000, 90000]) for _ in range(400)]
    stamps, t = [], 0
    for g in gaps:
        t += round(g * 1e6)
        stamps.append(t)
    return stamps


def test_active_time_equals_the_loop(spark):
    rng = random.Random(3)
    data = {k: [t * 1_000_000 for t in ts] for k, ts in SERIES.items()}
    data.update({f"random {i}": random_series(rng) for i in range(6)})
    df = spark.createDataFrame([(k, t) for k, ts in data.items() for t in ts], "model string, t long")
    df = df.select("model", F.timestamp_micros(F.col("t") + 1_700_000_000_000_000).alias("created_at"))
    got = {r.model: r.active_seconds for r in timing.active_time(df).collect()}
    for k, ts in data.items():
        assert got[k] == pytest.approx(active_loop(ts), rel=1e-9), k


def test_last_token_of_both_paddings(spark):
    left = [(0, r, p, int(p >= 4 - n), [float(10 * r + p)]) for r, n in ((0, 2), (1, 4)) for p in range(4)]
    right = [(1, r, p, int(p < n), [float(10 * r + p)]) for r, n in ((2, 2), (3, 4)) for p in range(4)]
    df = spark.createDataFrame(left + right, "batch_id long, record_id long, pos int, mask int, vec array<float>")
    assert rows(pooling.last_token_pool(df)) == [(0, [3.0]), (1, [13.0]), (2, [21.0]), (3, [33.0])]
    assert dict(rows(pooling.mean_pool(df)))[0] == [1.5]


def test_missing_records_fail_the_join(spark):
    p = spark.createDataFrame([("1", 0, "a"), ("2", 0, "b")], "d1_id string, pos long, d2_id string")
    d1 = spark.createDataFrame([("1", "one"), ("2", "two")], "record_id string, text string")
    d2 = spark.createDataFrame([("a", "A")], "record_id string, text string")
    assert rows(pairs.missing_records(p, d1, d2)) == [("d2", "b")]
    with pytest.raises(Exception, match="no record for d2_id b"):
        pairs.attach_texts(p, d1, d2).collect()


def test_resume_by_family(spark):
    todo = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "d1_id string, d2_id string")
    log = spark.createDataFrame(
        [("1", ["a"], "MATCHING_PROMPT", "r", "m"), ("2", ["c"], "MATCHING_PROMPT", "other", "m"), ("2", ["c", "d"], "SELECTING_PROMPT", "r", "m")],
        "d1_id string, d2_candidates_id array<string>, prompt_group string, run_id string, model string",
    )
    assert rows(resume.resume_results(todo, log, "MATCHING_PROMPT_ONLY", "r", "m")) == [("1", "b"), ("2", "c")]
    assert rows(resume.resume_results(todo, log, "SELECTING_PROMPT", "r", "m")) == [("1", "a"), ("1", "b")]


def test_unknown_names_fail(spark):
    df = spark.createDataFrame([("BGE_M3",), ("NOPE",)], "model_key string")
    assert model_registry(df, "embedding", strict=False).filter("name is null").count() == 1
    with pytest.raises(Exception, match="unsupported model: NOPE"):
        model_registry(df, "embedding").collect()
    with pytest.raises(Exception, match="unknown data set: D5"):
        dataset_manifest(spark.createDataFrame([("D5",)], "dataset string")).collect()
    check_prompt_mode("MATCHING", "MATCHING_PROMPT_ONLY")
    with pytest.raises(ValueError):
        check_prompt_mode("COMPARING", "MATCHING_PROMPT")


def test_a_candidate_without_a_vector_fails(spark):
    df = spark.createDataFrame([("a", "x", 0), ("a", "y", 1)], "d1_id string, d2_id string, pos long")
    one = spark.createDataFrame([("a", [1.0, 0.0])], "record_id string, embeddings array<float>")
    two = spark.createDataFrame([("x", [1.0, 0.0])], "record_id string, embeddings array<float>")
    with pytest.raises(Exception, match="no vector for d2_id y"):
        rank.candidate_rank(df, one, two, "cosine").collect()
