"""Run registered queries next to their SQL on DuckDB: ``python -m workload.check [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

from twinlink.session import build_session
from workload import registry

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()


def normal(rows: list[dict]) -> list[tuple]:
    """Rows with their columns in name order, in an order of their own."""
    out = [tuple((k, r[k]) for k in sorted(r)) for r in rows]
    return sorted(out, key=repr)


def oracle(sf_dir: str, sql: str) -> list[dict]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return [dict(zip(rel.columns, row)) for row in rel.fetchall()]


def compare(spark, sf_dir: str, name: str) -> str:
    start = time.time()
    rows = [r.asDict() for r in registry.queries()[name](spark, sf_dir).collect()]
    took = f"{len(rows)} rows, {time.time() - start:.1f}s"
    sql = registry.oracle_sql().get(name)
    if not sql:
        return f"no SQL ({took})"
    got, want = normal(rows), normal(oracle(sf_dir, sql))
    if got == want:
        return f"ok ({took})"
    only_got = [r for r in got if r not in set(want)][:2] if len(got) < 5000 else [g for g, w in zip(got, want) if g != w][:2]
    only_want = [r for r in want if r not in set(got)][:2] if len(got) < 5000 else [w for g, w in zip(got, want) if g != w][:2]
    return f"DIFFERENT ({took}, SQL {len(want)})\n   spark {only_got}\n   sql   {only_want}"


def main(args: list[str]) -> int:
    sf = args[0] if args else "0.01"
    sf_dir = str(Path(os.environ.get("TESTDATA", "/root/testdata")) / f"sf{sf}")
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in args[1:] or registry.queries():
        try:
            result = compare(spark, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            result = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        bad += not result.startswith(("ok", "no SQL"))
        print(f"{name}: {result}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
