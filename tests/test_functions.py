import math

import pytest
from pyspark.sql import functions as F

from twinlink.functions import parse, prompts, text, times, vectors


def one(spark, column, **values):
    """The value of a column expression over one row."""
    schema = ", ".join(f"{k} {kind}" for k, (_, kind) in values.items()) or "x int"
    row = tuple(v for v, _ in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


def s(value):
    return (value, "string")


@pytest.mark.parametrize(
    "response, status, answer",
    [
        ("Yes.", "VALID", "yes"),
        ("no, they differ", "VALID", "no"),
        ("YES it is", "VALID", "yes"),
        ("yesterday", "INVALID", None),
        ("I say yes", "INVALID", None),
        ("", "INVALID", None),
        (None, "NO_RESPONSE", None),
    ],
)
def test_matching_answers(spark, response, status, answer):
    got = one(spark, parse.parse_matching("r"), r=s(response))
    assert (got.status, got.answer) == (status, answer)


@pytest.mark.parametrize(
    "response, answer",
    [
        ("Record A", "record a"),
        ("record b!", "record b"),
        ("The answer is: Record B", "record b"),
        ("The answer is Record A because", "record a"),
        ("Well, Record B is more likely to refer to the same real-world entity", "record b"),
        ("Record B is more likely to refer to the same real-world entity; Record A is more likely to refer to the same "
         "real world entity", "record a"),
        ("Record A or so", None),
    ],
)
def test_comparing_answers(spark, response, answer):
    got = one(spark, parse.parse_comparing("r"), r=s(response))
    assert (got.status, got.answer) == ("VALID" if answer else "INVALID", answer)


@pytest.mark.parametrize(
    "response, n, reasoning, answer",
    [
        ("[2]", 3, False, 2),
        ("0", 3, False, 0),
        ("7", 3, False, None),
        ("2 is my choice 3", 3, False, 2),
        ("my choice is 3", 3, False, 3),
        ("The answer is: [1] as the answer is [2]", 3, False, 2),
        ("none", 3, False, None),
        ("99999999999999", 3, False, None),
        ("", 3, False, None),
        ("<think>1</think> it is 2", 3, True, 2),
        ("2 was my thought", 3, True, None),
    ],
)
def test_selecting_answers(spark, response, n, reasoning, answer):
    got = one(spark, parse.parse_selecting("r", "n", reasoning=reasoning), r=s(response), n=(n, "int"))
    assert (got.status, got.answer) == ("INVALID" if answer is None else "VALID", answer)


def test_thinking_is_cut_after_the_last_marker(spark):
    assert one(spark, parse.strip_thinking("r"), r=s("a</think>b</think> YES ")) == "yes"
    assert one(spark, parse.strip_thinking("r"), r=s("yes")) is None
    got = one(spark, parse.parse_matching("r", reasoning=True), r=s("yes"))
    assert got.status == "INVALID"
    got = one(spark, parse.parse_matching("r", reasoning=True, think=False), r=s("yes"))
    assert got.status == "VALID"


def test_punctuation_keeps_words_of_every_script(spark):
    assert one(spark, text.strip_punctuation("t"), t=s("Él—dijo: «ÑANDÚ_2», 日本 ½!")) == "él dijo ñandú_2 日本 ½"


def test_missing_values_are_written_out(spark):
    got = one(spark, text.serialize_record(["a", "b", "c"]), a=s("x"), b=s(None), c=(7, "int"))
    assert got == "x nan 7"


def test_truncation_keeps_head_and_tail(spark):
    words = [f"w{i}" for i in range(1000)]
    long = "\n ".join(words)
    got = one(spark, text.truncate_tokens("t", 520), t=s(long))
    assert got == "\n ".join(words[:220]) + "\n " + "\n ".join(words[900:])
    short = "\n ".join(words[:320])
    assert one(spark, text.truncate_tokens("t", 520), t=s(short)) == short
    with pytest.raises(ValueError):
        text.truncate_tokens("t", 300)


def test_prompts(spark):
    got = one(spark, prompts.matching_prompt("r", F.array("c"), "MATCHING_PROMPT_ONLY"), r=s("left {1}"), c=s("right"))
    assert "Record 1: left {1}\n        Record 2: right\n\n        The answer is:\n" in got
    got = one(spark, prompts.comparing_prompt("r", F.array("c", "r")), r=s("left"), c=s("right"))
    assert "Given entity record: left\n        Record A: right\n        Record B: left \n" in got
    got = one(spark, prompts.selecting_prompt("r", F.array("c", "r")), r=s("left"), c=s("right"))
    assert got.endswith("Given entity record: left\n        [1] right\n[2] left\n\nThe answer is:")


def test_wrong_candidate_count_fails(spark):
    with pytest.raises(Exception, match="expected 2 candidate"):
        one(spark, prompts.comparing_prompt("r", F.array("c")), r=s("left"), c=s("right"))


def test_prompt_without_template_fails():
    with pytest.raises(ValueError):
        prompts.build_prompt("SELECTING_PROMPT_ONLY", "r", "c")


def test_scores(spark):
    a, b, zero = ([3.0, 4.0], "array<float>"), ([4.0, 3.0], "array<float>"), ([0.0, 0.0], "array<float>")
    assert math.isclose(one(spark, vectors.cosine_score("a", "b"), a=a, b=b), 24 / 25)
    assert math.isclose(one(spark, vectors.euclidean_score("a", "b"), a=a, b=b), 1 / 3)
    assert one(spark, vectors.cosine_score("a", "b"), a=a, b=zero) == 0.0
    assert one(spark, vectors.l2_normalize("a"), a=a) == [0.6000000000000001, 0.8] or one(
        spark, vectors.l2_normalize("a"), a=a
    ) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize("a"), a=zero) == [0.0, 0.0]


def test_ragged_vectors_fail(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception):
        df.select(vectors.cosine_score("a", "b")).collect()


@pytest.mark.parametrize(
    "seconds, out", [(0.0, "0.00 minutes"), (90.0, "1.50 minutes"), (3599.9, "60.00 minutes"), (3618.0, "1.00 hours"), (450.0, "7.50 minutes")]
)
def test_durations_round_the_binary_value(spark, seconds, out):
    assert one(spark, times.format_duration("t"), t=(seconds, "double")) == out


def test_minute_boundaries_count_marks_passed(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:59' AS a, timestamp_ntz'2024-01-01 00:02:01' AS b")
    assert df.select(times.minute_boundaries("a", "b")).first()[0] == 2.0


def test_run_id_and_back(spark):
    rid = times.make_run_id(F.lit(8192), F.lit("MATCHING_PROMPT_ONLY"), F.lit("phi4:14b"), F.lit("2025-03-05"))
    assert one(spark, rid) == "8192_max_MATCHING_PROMPT_ONLY_phi4:14b_2025-03-05"
    assert one(spark, times.prompt_of_run(rid)) == "MATCHING_PROMPT_ONLY"


def test_a_text_is_tokenised_once(spark):
    from twinlink.functions import parse
    from twinlink.functions.text import truncate_tokens

    df = spark.createDataFrame([("the answer is 2", 5)], "text string, n int")
    columns = [
        truncate_tokens("text"),
        parse.parse_matching("text"),
        parse.parse_comparing("text"),
        parse.parse_selecting("text", "n"),
    ]
    for column in columns:
        plan = df.select(column.alias("out"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
