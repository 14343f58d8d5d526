import random
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from twinlink.operators import judge as J
from twinlink.operators.judge import Options, ask_with_retry
from twinlink.plans.judging import run_judge
from twinlink.session import scratch_path
from twinlink.sources.tables import results_table

OPTIONS = Options(retry_wait=0.0)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pairs(spark, lists):
    rows = [(d1, pos, d2, f"t{d1}", f"t{d2}") for d1, ids in lists.items() for pos, d2 in enumerate(ids)]
    return spark.createDataFrame(rows, "d1_id string, pos long, d2_id string, d1_text string, d2_text string")


def orders(sorted_rows):
    out = {}
    for r in sorted(sorted_rows.collect(), key=lambda r: r.slot):
        out.setdefault(r.d1_id, []).append(r.d2_id)
    return out


def bubble(d1, ids, answer):
    """The sequential sort, with the questions it asks."""
    ids, asked = list(ids), []
    for end in range(len(ids) - 1, 0, -1):
        for i in range(end):
            a, b = ids[i + 1], ids[i]
            asked.append((d1, a, b))
            if answer(d1, a, b) == "Record A":
                ids[i], ids[i + 1] = a, b
    return ids, asked


def fickle(d1, a, b):
    """Not transitive, not symmetric, sometimes no valid answer."""
    h = sum(ord(c) * 31**i for i, c in enumerate(f"{d1}|{a}|{b}")) % 10
    return "Record A" if h < 5 else "Record B" if h < 8 else "cannot say"


def pairwise(answer):
    def judge(q: pd.DataFrame):
        return [answer(*row) for row in zip(q["d1_id"], q["a_id"], q["b_id"])]

    return judge


def test_compare_sort_equals_the_sequential_sort(spark):
    rng = random.Random(1)
    lists = {f"d{n}_{c}": [f"x{i}" for i in rng.sample(range(50), n)] for n in range(1, 9) for c in range(3)}
    got = orders(J.compare_sort(pairs(spark, lists), pairwise(fickle), "COMPARING_PROMPT", OPTIONS))
    assert got == {d1: bubble(d1, ids, fickle)[0] for d1, ids in lists.items()}


def test_compare_sort_asks_the_questions_of_the_sequential_sort(spark, tmp_path):
    lists = {"a": list("uvwxy"), "b": list("pq"), "c": ["z"]}
    log = str(tmp_path / "asked")

    def judge(q: pd.DataFrame):
        with open(log, "a") as f:
            f.writelines(f"{r.d1_id} {r.a_id} {r.b_id}\n" for r in q.itertuples())
        return pairwise(fickle)(q)

    J.compare_sort(pairs(spark, lists), judge, "COMPARING_PROMPT", OPTIONS).collect()
    asked = sorted(tuple(line.split()) for line in open(log))
    assert asked == sorted(q for d1, ids in lists.items() for q in bubble(d1, ids, fickle)[1])


def test_always_b_keeps_the_order(spark):
    lists = {"a": list("dacb"), "b": ["z"]}
    got = orders(J.compare_sort(pairs(spark, lists), pairwise(lambda *_: "Record B"), "COMPARING_PROMPT", OPTIONS))
    assert got == lists


def test_score_sort_is_what_a_score_judge_gives(spark):
    rng = random.Random(2)
    lists = {f"d{c}": [f"{i}" for i in rng.sample(range(90), 7)] for c in range(6)}
    prefer = pairwise(lambda d1, a, b: "Record A" if int(a) % 4 > int(b) % 4 else "Record B")
    by_judge = orders(J.compare_sort(pairs(spark, lists), prefer, "COMPARING_PROMPT", OPTIONS))
    by_score = J.score_sort(pairs(spark, lists).withColumn("score", F.col("d2_id").cast("int") % 4), "score")
    assert orders(by_score) == by_judge


def test_single_candidate_is_picked_without_asking(spark):
    def never(q):
        raise AssertionError("asked")

    row = J.compare_pick(pairs(spark, {"a": ["x"]}), never, "COMPARING_PROMPT", OPTIONS).first()
    assert (row.result, row.request_status, row.prompt_type) == ("x", "VALID", "COMPARING_PROMPT")


def by_prompt(q: pd.DataFrame):
    """Accepts ids below 50, prefers the smaller id, selects what the d1 says."""
    if "a_id" in q:
        return ["Record A" if a < b else "Record B" for a, b in zip(q["a_id"], q["b_id"])]
    if "d2_id" not in q:
        return [{"none": "[0]", "second": "The answer is [2]", "wild": "[9]"}.get(d, "1") for d in q["d1_id"]]
    return ["yes" if int(d) < 50 else "no" for d in q["d2_id"]]


def test_select_cascade(spark):
    lists = {
        "none": ["30", "20"], "second": ["40", "99", "10", "30"], "wild": ["11"], "nobody": ["77", "78"], "first": ["21", "12"],
    }
    got = {r.d1_id: r for r in J.select_cascade(pairs(spark, lists), by_prompt, "SELECTING_PROMPT", OPTIONS).collect()}
    assert {d: (r.d2_candidates_id, r.result, r.request_status) for d, r in got.items()} == {
        "none": (["20", "30"], None, "VALID"),
        "second": (["10", "30", "40"], "30", "VALID"),
        "wild": (["11"], None, "INVALID"),
        "nobody": ([], None, "VALID"),
        "first": (["12", "21"], "12", "VALID"),
    }


def test_a_long_list_leaves_the_prompt_of_the_whole(spark):
    from twinlink.functions.prompts import build_prompt
    from twinlink.functions.text import truncate_tokens

    ids = [str(i) for i in range(700)]
    ordered = pairs(spark, {"a": ids}).withColumnRenamed("pos", "slot")
    whole = spark.createDataFrame([("ta", [f"t{i}" for i in ids])], "record string, candidates array<string>")
    want = whole.select(truncate_tokens(build_prompt("SELECTING_PROMPT", "record", "candidates"), 310)).first()[0]
    row = J._selecting_questions(ordered, 310).select("*", truncate_tokens("full_prompt", 310).alias("prompt")).first()
    assert row.prompt == want and row.n_candidates == 700
    assert row.full_prompt.count("[") == 312 + 100


def test_long_lists_take_several_log_rows(spark, monkeypatch):
    monkeypatch.setattr(J, "LIST_ROWS", 2)
    got = J.compare_pick(pairs(spark, {"a": list("edcba")}), pairwise(lambda d, a, b: "Record B"), "COMPARING_PROMPT", OPTIONS)
    assert sorted((r.d2_candidates_id, r.result) for r in got.collect()) == [(["a"], None), (["c", "b"], None), (["e", "d"], "e")]


def test_a_failing_question_costs_only_itself():
    calls = []

    def judge(q):
        calls.append(len(q))
        if "bad" in set(q["prompt"]):
            raise TimeoutError
        return q["prompt"].str.upper()

    q = pd.DataFrame({"prompt": ["a", "bad", "c", "d", "e"]})
    assert ask_with_retry(judge, q, attempts=2, wait=0.0) == ["A", None, "C", "D", "E"]
    assert calls[:2] == [5, 5]


def test_a_passing_failure_is_retried():
    state = {"left": 2}

    def judge(q):
        if state["left"]:
            state["left"] -= 1
            raise TimeoutError
        return ["ok"] * len(q)

    assert ask_with_retry(judge, pd.DataFrame({"prompt": ["a", "b"]}), attempts=3, wait=0.0) == ["ok", "ok"]


def test_missing_response_is_logged(spark):
    row = J.match_pairs(pairs(spark, {"a": ["x"]}), lambda q: [None] * len(q), "MATCHING_PROMPT", OPTIONS).first()
    assert (row.result, row.request_status) == (None, "NO_RESPONSE")


def test_prompt_must_fit_the_mode(spark):
    with pytest.raises(ValueError):
        J.run_mode("MATCHING", pairs(spark, {"a": ["x"]}), by_prompt, "SELECTING_PROMPT", OPTIONS)
    with pytest.raises(ValueError):
        J.run_mode("GUESSING", pairs(spark, {"a": ["x"]}), by_prompt, "SELECTING_PROMPT", OPTIONS)


@pytest.mark.parametrize("mode, prompt", [("MATCHING", "MATCHING_PROMPT_ONLY"), ("SELECTING", "SELECTING_PROMPT")])
def test_resume(spark, mode, prompt):
    path = scratch_path(spark, "results")
    p = pairs(spark, {"a": ["10", "60"], "b": ["20"], "c": ["70"]})
    d1 = spark.createDataFrame([(i, i) for i in "abc"], "record_id string, text string")
    d2 = spark.createDataFrame([(i, i) for i in ("10", "20", "60", "70")], "record_id string, text string")
    p = p.select("d1_id", "pos", "d2_id")
    once = Options(run_id="one", retry_wait=0.0)
    other = Options(run_id="two", retry_wait=0.0)

    first = run_judge(mode, p.filter("d1_id = 'a'"), d1, d2, by_prompt, prompt, once, path).count()
    full = run_judge(mode, p, d1, d2, by_prompt, prompt, once, path)
    expected = 4 if mode == "MATCHING" else 3
    assert first < expected and full.count() == expected
    assert run_judge(mode, p, d1, d2, by_prompt, prompt, once, path).count() == expected
    assert run_judge(mode, p, d1, d2, by_prompt, prompt, other, path).count() == 2 * expected
    again = run_judge(mode, p.filter("d1_id = 'b'"), d1, d2, by_prompt, prompt, once, path, restart=True)
    assert again.filter("run_id = 'one'").count() == 1 and again.filter("run_id = 'two'").count() == expected
    assert results_table(spark, path, force=True).count() == 0
