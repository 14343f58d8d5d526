"""Queries whose tasks get a model run where the workers cannot import this package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from twinlink.session import build_session
conf = {{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": {shared!r}}}
spark = build_session("elsewhere", "local[2]", **conf)
from twinlink.llm import queries
for name in {names!r}:
    print(name, queries.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


@pytest.mark.parametrize("names", [["op1_lattice_scoring", "op5_toxicity", "op11_cutting_stock_packing", "op13_fim_frames"]])
def test_from_another_folder(tmp_path, names):
    script = SCRIPT.format(root=str(ROOT), shared=str(tmp_path / "shared"), names=names)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names, done.stderr[-3000:]
