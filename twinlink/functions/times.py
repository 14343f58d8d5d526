"""Durations and run ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlink.functions.text import _col
from twinlink.schema import PROMPTS_BY_MODE


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds as a double, the same in every session time zone for zone-free timestamps."""
    gap = _col(end) - _col(start)
    parts = (
        F.extract(F.lit("DAY"), gap) * 86400
        + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
    )
    return parts.cast("double") + F.extract(F.lit("SECOND"), gap).cast("double")


def _full_minute(ts: Column) -> Column:
    return ts - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), ts))


def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """Number of full-minute marks passed between two timestamps."""
    return seconds_between(_full_minute(_col(start)), _full_minute(_col(end))) / 60


def _two_places(x: Column) -> Column:
    # format_number rounds the exact binary value, ties to even; format_string rounds its shortest decimal text up.
    return F.call_function("format_number", x, F.lit("0.00"))


def format_duration(seconds: Column | str) -> Column:
    """``x.xx minutes`` below one hour, else ``x.xx hours``."""
    seconds = _col(seconds)
    return F.when(seconds < 3600, F.concat(_two_places(seconds / 60), F.lit(" minutes"))).otherwise(
        F.concat(_two_places(seconds / 3600), F.lit(" hours"))
    )


def make_run_id(max_tokens: Column | str, prompt_type: Column | str, model: Column | str, day: Column | str) -> Column:
    parts = [_col(max_tokens).cast("string"), F.lit("max"), _col(prompt_type), _col(model)]
    return F.concat_ws("_", *parts, _col(day).cast("string"))


def prompt_of_run(run_id: Column | str) -> Column:
    """The prompt variant named in a run id; empty when there is none."""
    names = sorted((p for prompts in PROMPTS_BY_MODE.values() for p in prompts), key=len, reverse=True)
    return F.regexp_extract(_col(run_id), "_max_(" + "|".join(names) + ")_", 1)
