"""Judge answers to ``struct<status, answer>``.

``answer`` is "yes"/"no" for matching, "record a"/"record b" for comparing and the chosen number for selecting;
it is null unless the status is VALID.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlink.functions.prompts import mode_of
from twinlink.functions.text import _col, once, strip_punctuation
from twinlink.schema import COMPARING, INVALID, MATCHING, NO_RESPONSE, SELECTING, VALID

# The markers looked for in an answer.
END_OF_THOUGHT = "</think>"
MORE_LIKELY = "{} is more likely to refer to the same real world entity"
THE_ANSWER_IS = "the answer is"


def strip_thinking(response: Column | str) -> Column:
    """Text after the last end-of-thought marker, in lower case; null when the marker is missing."""
    response = _col(response)
    after = F.trim(F.substring_index(F.lower(response), END_OF_THOUGHT, -1))
    return F.when(response.contains(END_OF_THOUGHT), after)


def _result(response: Column, answer: Column) -> Column:
    status = (
        F.when(response.isNull(), NO_RESPONSE).when(answer.isNotNull(), VALID).otherwise(F.lit(INVALID))
    )
    return F.struct(status.alias("status"), answer.alias("answer"))


def _clean(response: Column, reasoning: bool, think: bool) -> Column:
    return strip_punctuation(strip_thinking(response) if reasoning and think else response)


def parse_matching(response: Column | str, reasoning: bool = False, think: bool = True) -> Column:
    response = _col(response)

    def answer(text: Column) -> Column:
        no, yes = (text == "no") | text.startswith("no "), (text == "yes") | text.startswith("yes ")
        return _result(response, F.when(no, "no").when(yes, "yes"))

    return once(_clean(response, reasoning, think), answer)


def parse_comparing(response: Column | str, reasoning: bool = False, think: bool = True) -> Column:
    """A stated preference anywhere in the text goes first, then the bare record, then "the answer is ..."."""
    response = _col(response)
    records = ("record a", "record b")

    def answer(text: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for r in records:
            out = out.when(text.contains(MORE_LIKELY.format(r)), r)
        for r in records:
            out = out.when(text == r, r)
        for r in records:
            out = out.when(text.rlike(f"^{THE_ANSWER_IS}  ?{r}"), r)
        return _result(response, out)

    return once(_clean(response, reasoning, think), answer)


def comparing_answer(response: str | None, reasoning: bool = False, think: bool = True) -> tuple[str, str | None]:
    """Status and answer of one plain response, as ``parse_comparing`` gives them, for steps inside a task."""
    if response is None:
        return NO_RESPONSE, None
    if reasoning and think:
        if END_OF_THOUGHT not in response:
            return INVALID, None
        response = response.lower().rpartition(END_OF_THOUGHT)[2].strip(" ")
    text = " ".join(re.findall(r"\w+", response)).lower()
    records = ("record a", "record b")
    for found in (
        lambda r: MORE_LIKELY.format(r) in text,
        lambda r: text == r,
        lambda r: re.match(f"{THE_ANSWER_IS}  ?{r}", text) is not None,
    ):
        for r in records:
            if found(r):
                return VALID, r
    return INVALID, None


def parse_selecting(
    response: Column | str, n_candidates: Column | str, reasoning: bool = False, think: bool = True
) -> Column:
    """The first word when it is a number, else the last word; a reasoning model only gives the last word."""
    response = _col(response)

    def words(text: Column) -> Column:
        end = F.trim(F.substring_index(text, THE_ANSWER_IS, -1))
        return F.split(F.when(text.contains(THE_ANSWER_IS), end).otherwise(text), " ")

    def number(found: Column) -> Column:
        last, first = F.element_at(found, -1), F.element_at(found, 1)
        word = last if reasoning else F.when(first.rlike("^[0-9]+$"), first).otherwise(last)
        return F.when(word.rlike("^[0-9]+$"), word.try_cast("int"))

    chosen = once(once(_clean(response, reasoning, think), words), number)
    return once(chosen, lambda n: _result(response, F.when(n <= _col(n_candidates), n)))


def response_status(
    prompt_type: str, response: Column | str, n_candidates: Column | str | None = None, **flags: bool
) -> Column:
    return parse(prompt_type, response, n_candidates, **flags)["status"]


def parse(
    prompt_type: str, response: Column | str, n_candidates: Column | str | None = None, **flags: bool
) -> Column:
    """Parse by the family of the prompt that was asked; the answer is always a string here."""
    mode = mode_of(prompt_type)
    if mode == MATCHING:
        return parse_matching(response, **flags)
    if mode == COMPARING:
        return parse_comparing(response, **flags)
    assert mode == SELECTING
    parsed = parse_selecting(response, n_candidates, **flags)
    return once(parsed, lambda p: F.struct(p["status"].alias("status"), p["answer"].cast("string").alias("answer")))
