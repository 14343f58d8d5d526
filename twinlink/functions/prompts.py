"""Prompts as column expressions.

A template is cut at its placeholders once, on the driver, and becomes one ``concat``; a record text that happens
to contain a placeholder is therefore never substituted again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlink.functions.text import _col
from twinlink.schema import COMPARING, MATCHING, PROMPTS_BY_MODE, SELECTING

# The prompt texts. {0} is the record, {1} and {2} its candidates.
TEMPLATES = {
    "MATCHING_PROMPT": """Do the two entity records refer to the same real-world entity?
        Answer "Yes" if they do and "No" if they do not.
        Record 1: {0}
        Record 2: {1}
        """,
    "MATCHING_PROMPT_ONLY": """Do the two entity records refer to the same real-world entity?
        Answer ONLY "Yes" if they do and ONLY "No" if they do not.
        Record 1: {0}
        Record 2: {1}

        The answer is:
        """,
    "COMPARING_PROMPT": """Which of the following two records is more likely to refer to the same real-world entity as the given record? Answer with the corresponding record identifier "Record A" or "Record B"
        Given entity record: {0}
        Record A: {1}
        Record B: {2} 
        """,
    "COMPARING_PROMPT_ONLY": """Which of the following two records is more likely to refer to the same real-world entity as the given record? Answer ONLY with the corresponding record identifier "Record A" or "Record B" and nothing else.
        Given entity record: {0}
        Record A: {1}
        Record B: {2}
        
        The answer is: 
        """,
    "SELECTING_PROMPT": """
        Select a record from the following candidates that refers to the same real-world entity as the given record. Answer ONLY with the corresponding record number surrounded by "[]" or "[0]" if there is none.
        Given entity record: {0}
        """,
}
SELECTING_END = "\nThe answer is:"


def mode_of(prompt_type: str) -> str:
    for mode, prompts in PROMPTS_BY_MODE.items():
        if prompt_type in prompts:
            return mode
    raise ValueError(f"unknown prompt type: {prompt_type}")


def prompt_group(prompt_type: str) -> str:
    """The plain variant of a prompt's family."""
    return PROMPTS_BY_MODE[mode_of(prompt_type)][0]


def _fill(prompt_type: str, values: list[Column]) -> Column:
    pieces = re.split(r"\{(\d)\}", TEMPLATES[prompt_type])
    parts = [values[int(p)] if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*parts)


def fill_prompt(prompt_type: str, *values: str) -> str:
    """The same prompt from plain texts, for steps that put questions inside a task."""
    return prompt_filler(prompt_type)(*values)


def prompt_filler(prompt_type: str) -> Callable[..., str]:
    """A function of the texts that fills the template, which is cut at its placeholders once."""
    pieces = re.split(r"\{(\d)\}", TEMPLATES[prompt_type])
    places = [int(p) for p in pieces[1::2]]

    def fill(*values: str) -> str:
        out = pieces.copy()
        out[1::2] = [values[p] for p in places]
        return "".join(out)

    return fill


def _exactly(n: int, candidates: Column, prompt: Column) -> Column:
    message = F.concat(F.lit(f"expected {n} candidate(s), got "), F.size(candidates).cast("string"))
    return F.when(F.size(candidates) == n, prompt).otherwise(F.raise_error(message))


def matching_prompt(record: Column | str, candidates: Column | str, prompt_type: str = "MATCHING_PROMPT") -> Column:
    record, candidates = _col(record), _col(candidates)
    return _exactly(1, candidates, _fill(prompt_type, [record, F.get(candidates, F.lit(0))]))


def comparing_prompt(record: Column | str, candidates: Column | str, prompt_type: str = "COMPARING_PROMPT") -> Column:
    record, candidates = _col(record), _col(candidates)
    values = [record, F.get(candidates, F.lit(0)), F.get(candidates, F.lit(1))]
    return _exactly(2, candidates, _fill(prompt_type, values))


def selecting_prompt(record: Column | str, candidates: Column | str, numbers: Column | str | None = None) -> Column:
    """The record followed by its candidates, numbered from 1 or by the array ``numbers``."""

    def line(text: Column, number: Column) -> Column:
        return F.concat(F.lit("["), number.cast("string"), F.lit("] "), text, F.lit("\n"))

    if numbers is None:
        lines = F.transform(_col(candidates), lambda c, i: line(c, i + 1))
    else:
        lines = F.zip_with(_col(candidates), _col(numbers), line)
    return F.concat(_fill("SELECTING_PROMPT", [_col(record)]), F.array_join(lines, ""), F.lit(SELECTING_END))


def build_prompt(prompt_type: str, record: Column | str, candidates: Column | str) -> Column:
    mode = mode_of(prompt_type)
    if prompt_type not in TEMPLATES:
        raise ValueError(f"{prompt_type} has no template")
    if mode == MATCHING:
        return matching_prompt(record, candidates, prompt_type)
    if mode == COMPARING:
        return comparing_prompt(record, candidates, prompt_type)
    assert mode == SELECTING
    return selecting_prompt(record, candidates)
