"""Judge runs that break off, judges out of reach, request options, and the cost of long lists."""

import random
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tests.test_judge import bubble, fickle, orders, pairs, pairwise
from twinlink.functions.parse import comparing_answer, parse_comparing
from twinlink.functions.prompts import build_prompt, fill_prompt
from twinlink.functions.text import truncate_text, truncate_tokens
from twinlink.operators import judge as J
from twinlink.operators.judge import Options, RequestFailed, ask_apart
from twinlink.plans.judging import JudgeOutage, run_judge
from twinlink.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules["tests.test_judge"])
OPTIONS = Options(retry_wait=0.0, attempts=1)


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_depend_on_the_length_of_the_lists(spark):
    counts = []
    for n in (2, 30):
        df = pairs(spark, {f"d{k}": [f"x{i}" for i in range(n)] for k in range(3)})
        counts.append(jobs_of(spark, f"sort{n}", lambda: J.compare_sort(df, pairwise(fickle), "COMPARING_PROMPT", OPTIONS).collect()))  # noqa: B023
    assert counts[0] == counts[1] <= 10


@pytest.mark.parametrize("batch_rows", [1, 7, 1024])
def test_lists_are_stepped_together_in_full_calls(spark, tmp_path, batch_rows):
    rng = random.Random(batch_rows)
    lists = {f"d{c}": [f"x{i}" for i in rng.sample(range(90), rng.randint(1, 12))] for c in range(40)}
    log = str(tmp_path / "calls")

    def judge(q: pd.DataFrame):
        with open(log, "a") as f:
            f.write(f"{len(q)}\n")
        return pairwise(fickle)(q)

    options = Options(retry_wait=0.0, batch_rows=batch_rows)
    df = pairs(spark, lists)
    assert orders(J.compare_sort(df, judge, "COMPARING_PROMPT", options)) == {d: bubble(d, ids, fickle)[0] for d, ids in lists.items()}
    calls = [int(x) for x in open(log)]
    asked = sum(len(bubble(d, ids, fickle)[1]) for d, ids in lists.items())
    assert sum(calls) == asked and max(calls) <= batch_rows
    if batch_rows == 1024:
        assert len(calls) <= 4 * 2 * 12


def tasks_that_ask(spark, tmp_path, monkeypatch, sort):
    """Tasks that put questions, and the result, when a task is to have about 20 of the questions."""
    monkeypatch.setattr(J, "TASK_QUESTIONS", 20)
    lists = {f"d{c}": [f"x{i}" for i in range(5)] for c in range(60)}
    log = str(tmp_path / "tasks")

    def judge(q: pd.DataFrame):
        from pyspark import TaskContext

        with open(log, "a") as f:
            f.write(f"{TaskContext.get().partitionId()}\n")
        return pairwise(fickle)(q)

    rows = sort(pairs(spark, lists), judge)
    return len(set(open(log))), rows, {d: bubble(d, ids, fickle)[0] for d, ids in lists.items()}


def test_tasks_of_a_pick_grow_in_number_with_the_questions(spark, tmp_path, monkeypatch):
    def pick(df, judge):
        return {r.d1_id: r.d2_candidates_id for r in J.compare_pick(df, judge, "COMPARING_PROMPT", OPTIONS).collect()}

    tasks, rows, want = tasks_that_ask(spark, tmp_path, monkeypatch, pick)
    assert tasks > 8 and rows == want


def test_tasks_of_a_sort_grow_in_number_with_the_questions(spark, tmp_path, monkeypatch):
    def sort(df, judge):
        return orders(J.compare_sort(df, judge, "COMPARING_PROMPT", OPTIONS))

    tasks, rows, want = tasks_that_ask(spark, tmp_path, monkeypatch, sort)
    assert tasks > 8 and rows == want


def test_lists_that_a_join_has_dealt_by_their_key_still_go_to_all_tasks(spark, tmp_path):
    lists = {f"d{c}": [f"x{i}" for i in range(5)] for c in range(60)}
    log = str(tmp_path / "tasks")

    def judge(q: pd.DataFrame):
        from pyspark import TaskContext

        with open(log, "a") as f:
            f.write(f"{TaskContext.get().partitionId()}\n")
        return pairwise(fickle)(q)

    df = pairs(spark, lists)
    joined = df.hint("merge").join(df.select("d1_id").distinct(), "d1_id")
    got = orders(J.compare_sort(joined, judge, "COMPARING_PROMPT", OPTIONS))
    assert got == {d: bubble(d, ids, fickle)[0] for d, ids in lists.items()}
    assert len(set(open(log))) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_long_lists_go_through_rounds_with_the_same_result(spark):
    rng = random.Random(5)
    lists = {f"d{n}": [f"x{i}" for i in rng.sample(range(50), n)] for n in range(1, 8)}
    got = J.compare_sort(pairs(spark, lists), pairwise(fickle), "COMPARING_PROMPT", OPTIONS, long_list=4)
    assert orders(got) == {d: bubble(d, ids, fickle)[0] for d, ids in lists.items()}


def test_long_lists_are_picked_and_selected_alike(spark, monkeypatch):
    lists = {"a": ["91", "11", "31", "21", "7"], "b": ["51", "5"], "c": ["8", "9"], "d": ["61", "41", "1"]}
    flows = lambda: [
        sorted((r.d1_id, r.d2_candidates_id, r.result, r.request_status) for r in rows.collect())
        for rows in (
            J.compare_pick(pairs(spark, lists), answer, "COMPARING_PROMPT", OPTIONS),
            J.select_cascade(pairs(spark, lists), answer, "SELECTING_PROMPT", OPTIONS),
        )
    ]
    want = flows()
    assert want[1] == [
        ("a", ["11", "21", "31", "91"], "11", "VALID"), ("b", ["51"], "51", "VALID"), ("c", [], None, "VALID"), ("d", ["1", "41", "61"], "1", "VALID"),
    ]
    monkeypatch.setattr(J, "LONG_LIST", 2)
    assert flows() == want


def test_plain_helpers_equal_the_column_functions(spark):
    rng = random.Random(3)
    words = ["Record A", "record b", "The answer is", ":", " ", "  ", "\n", "is more likely to refer to the same real-world entity", "</think>", "[1]", "é", "no"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "."]) for _ in range(rng.randint(0, 6))) for _ in range(400)]
    texts += [None, "", "Record A", "THE ANSWER IS record b", "Record B is more likely to refer to the same real world entity."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for flags in ({}, {"reasoning": True, "think": True}, {"reasoning": True, "think": False}):
        got = {r.i: (r.p.status, r.p.answer) for r in df.select("i", parse_comparing("t", **flags).alias("p")).collect()}
        assert got == {i: comparing_answer(t, **flags) for i, t in enumerate(texts)}
    long = ["".join(rng.choice(["a ", "bé\n", "  ", "\u00a0", "word"]) for _ in range(rng.randint(300, 2500))) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", truncate_tokens("t", 500).alias("x")).collect()}
    assert got == {i: truncate_text(t, 500) for i, t in enumerate(long)} and any(got[i] != t for i, t in enumerate(long))
    prompt = spark.range(1).select(build_prompt("COMPARING_PROMPT_ONLY", F.lit("r {1}"), F.array(F.lit("a"), F.lit("{0}")))).first()[0]
    assert prompt == fill_prompt("COMPARING_PROMPT_ONLY", "r {1}", "a", "{0}")


def test_an_outage_is_not_halved_to_the_end():
    calls = []

    def down(q):
        calls.append(len(q))
        raise ConnectionError

    assert ask_apart(down, pd.DataFrame({"prompt": ["x"] * 1000}), 1, 0.0) == ([None] * 1000, [True] * 1000)
    assert len(calls) == 6


def test_a_fault_of_the_judge_ends_the_job(spark):
    def broken(q):
        raise TypeError("a fault")

    with pytest.raises(Exception, match="a fault"):
        J.match_pairs(pairs(spark, {"a": ["x"]}), broken, "MATCHING_PROMPT", OPTIONS).collect()


def test_a_task_stops_asking_when_nobody_answers(spark, tmp_path):
    log = str(tmp_path / "calls")

    def down(q):
        with open(log, "a") as f:
            f.write("x\n")
        raise RequestFailed

    options = Options(retry_wait=0.0, attempts=1, batch_rows=10, outage_batches=2)
    out = J.match_pairs(pairs(spark, {"a": [str(i) for i in range(500)]}).coalesce(1), down, "MATCHING_PROMPT", options)
    assert {r.request_status for r in out.collect()} == {"FAILED"}
    assert len(open(log).readlines()) == 2 * 6


def test_request_options_reach_the_judge(spark):
    def judge(q, request):
        return [" ".join(f"{k}={v}" for k, v in sorted(request.items()))] * len(q)

    options = Options(model="deepseek-r1:14b", max_tokens=8192, temperature=0.5, think=False)
    questions = spark.createDataFrame([("p",)], "prompt string")
    row = J.judge_retry(questions, judge, options).first()
    assert row.response == "model=deepseek-r1:14b num_ctx=8192 num_predict=8192 temperature=0.5 think=False"
    assert Options(model="phi4:14b").request["num_predict"] == 128


LISTS = {f"d{k}": [f"{k}{i}" for i in range(3)] for k in range(1, 9)}


def records(spark):
    ids = sorted({*LISTS, *(i for own in LISTS.values() for i in own)})
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "record_id string, text string")
    return pairs(spark, LISTS).select("d1_id", "pos", "d2_id"), rows, rows


def answer(q):
    if "a_id" in q:
        return ["Record A" if a < b else "Record B" for a, b in zip(q["a_id"], q["b_id"])]
    if "d2_id" not in q:
        return ["[1]"] * len(q)
    return ["yes" if d.endswith("1") else "no" for d in q["d2_id"]]


@pytest.mark.parametrize("mode, prompt", [("MATCHING", "MATCHING_PROMPT"), ("COMPARING", "COMPARING_PROMPT"), ("SELECTING", "SELECTING_PROMPT")])
def test_a_run_that_ends_half_way_is_taken_up_again(spark, tmp_path, mode, prompt):
    path, log, state = scratch_path(spark, "results"), str(tmp_path / "asked"), tmp_path / "broken"
    state.touch()
    # A question of the last of four portions ends the job.
    key = ["d1_id", "d2_id"] if mode == "MATCHING" else ["d1_id"]
    last = records(spark)[0].orderBy(F.pmod(F.xxhash64(*key), F.lit(4)).desc(), "d1_id").first()

    def judge(q):
        if state.exists() and any(d == last.d1_id and e in (None, last.d2_id) for d, e in zip(q["d1_id"], q.get("d2_id", [None] * len(q)))):
            raise ValueError("killed")
        with open(log, "a") as f:
            f.writelines(f"{d}\n" for d in q["d1_id"])
        return answer(q)

    run = lambda: run_judge(mode, *records(spark), judge, prompt, Options(retry_wait=0.0, commit_pairs=6), path)
    with pytest.raises(Exception, match="killed"):
        run()
    kept = {(r.d1_id, tuple(r.d2_candidates_id)) for r in spark.read.parquet(path).collect()}
    assert kept and (last.d1_id not in {d for d, _ in kept} or mode == "MATCHING")
    state.unlink()
    open(log, "w").close()
    full = [(r.d1_id, tuple(r.d2_candidates_id)) for r in run().collect()]
    assert len(full) == len(set(full)) == (24 if mode == "MATCHING" else 8)
    again = {x.strip() for x in open(log)}
    assert again == {d for d, ids in full if (d, ids) not in kept}
    open(log, "w").close()
    assert run().count() == len(full) and not open(log).read()


@pytest.mark.parametrize("mode, prompt", [("MATCHING", "MATCHING_PROMPT"), ("COMPARING", "COMPARING_PROMPT"), ("SELECTING", "SELECTING_PROMPT")])
def test_what_failed_is_asked_again(spark, tmp_path, mode, prompt):
    path, state = scratch_path(spark, "results"), tmp_path / "down"
    state.touch()

    def judge(q):
        if state.exists() and {"d2", "d7"} & set(q["d1_id"]):
            raise TimeoutError
        return answer(q)

    run = lambda **o: run_judge(mode, *records(spark), judge, prompt, Options(retry_wait=0.0, attempts=1, **o), path)
    first = run()
    assert {r.d1_id for r in first.collect()} == LISTS.keys() - {"d2", "d7"}
    assert first.filter("request_status = 'FAILED'").count() == 0
    with pytest.raises(JudgeOutage):
        run(failure_limit=1)
    state.unlink()
    full = run()
    assert {r.d1_id for r in full.collect()} == LISTS.keys()
    assert full.count() == (24 if mode == "MATCHING" else 8)


def test_answers_have_their_own_times(spark):
    import time

    def slow(q):
        time.sleep(0.3)
        return answer(q)

    options = Options(retry_wait=0.0, batch_rows=1)
    path = scratch_path(spark, "results")
    log = run_judge("MATCHING", *(f.coalesce(1) for f in records(spark)), slow, "MATCHING_PROMPT", options, path)
    span = log.agg((F.max("inserted_at").cast("double") - F.min("inserted_at").cast("double")).alias("s")).first().s
    assert span >= 0.3
