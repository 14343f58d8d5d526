"""Record texts and token truncation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, numbers and underscore of every script.
WORD = r"[\p{L}\p{N}_]+"
# A token together with the blanks before it, so that joining the tokens gives the text back.
SPACED_TOKEN = r"\s*\S+|\s+$"

RESERVED_TOKENS = 200
TAIL_TOKENS = 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often the expression names it."""
    return F.transform(F.array(value), use)[0]


def serialize_record(attributes: list[Column | str], null_token: str = "nan") -> Column:
    """Attribute values as strings joined by one space; a missing value becomes ``null_token``."""
    return F.concat_ws(" ", *[F.coalesce(_col(a).cast("string"), F.lit(null_token)) for a in attributes])


def strip_punctuation(text: Column | str) -> Column:
    """Word runs joined by one space, in lower case."""
    return F.lower(F.array_join(F.regexp_extract_all(_col(text), F.lit(WORD), F.lit(0)), " "))


def spaced_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACED_TOKEN), F.lit(0))


def truncate_tokens(
    text: Column | str, max_tokens: int = 2048, tokenize: Callable[[Column], Column] = spaced_tokens
) -> Column:
    """Keep a text that has at most ``max_tokens - 200`` tokens; else drop its middle.

    What is kept of a longer text is its first ``max_tokens - 300`` and its last 100 tokens. ``tokenize`` maps a
    text column to an array of pieces that add up to the text.
    """
    limit = max_tokens - RESERVED_TOKENS
    if limit <= TAIL_TOKENS:
        raise ValueError("max_tokens must exceed 300")
    text = _col(text)

    def shorten(tokens: Column) -> Column:
        kept = F.concat(F.slice(tokens, 1, limit - TAIL_TOKENS), F.slice(tokens, -TAIL_TOKENS, TAIL_TOKENS))
        return F.when(F.size(tokens) > limit, F.array_join(kept, "")).otherwise(text)

    # A token has at least one byte, so a short text is kept without being cut into tokens.
    short = F.octet_length(text) <= limit
    return F.when(short, text).otherwise(once(tokenize(text), shorten))


_SPACED_TOKEN = re.compile(SPACED_TOKEN, re.ASCII)


def truncate_text(text: str, max_tokens: int = 2048) -> str:
    """``truncate_tokens`` of one plain text, for steps that put questions inside a task."""
    limit = max_tokens - RESERVED_TOKENS
    if limit <= TAIL_TOKENS:
        raise ValueError("max_tokens must exceed 300")
    if len(text) <= limit:
        return text
    tokens = _SPACED_TOKEN.findall(text)
    if len(tokens) <= limit:
        return text
    return "".join(tokens[: limit - TAIL_TOKENS] + tokens[-TAIL_TOKENS:])


def instruct_prefix(task: str, text: Column | str) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), _col(text))
