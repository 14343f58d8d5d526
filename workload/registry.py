"""All registered queries by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("blocking", "ranking", "evaluation", "texts", "judging", "storage")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out = {}
    for name in MODULES:
        out.update(importlib.import_module(f"workload.{name}").QUERIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
