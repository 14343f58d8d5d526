"""Candidate lists in the written object as a plain JSON reader sees them."""

import json

import pytest

from twinlink.sources import files


@pytest.mark.parametrize("list_rows", [1000, 2])
def test_a_long_list_is_one_entry(spark, tmp_path, list_rows):
    want = {"a": [f"c{i}" for i in range(2500)], 'b"]': ["x, y]", 'z"'], "c": ["only"], "d": ["1", "2", "3"]}
    rows = [(d1, i, d2) for d1, ids in want.items() for i, d2 in enumerate(ids)]
    df = spark.createDataFrame(rows, "d1_id string, pos long, d2_id string").repartition(3)
    path = tmp_path / "pairs.json"
    files.sink_pairs(df, str(path), list_rows)
    entries = []
    for part in path.glob("part-*"):
        json.loads(part.read_text(), object_pairs_hook=entries.extend)
    assert len(entries) == len(want) and dict(entries) == want
    assert sorted(map(tuple, files.scan_pairs_json(spark, str(path)).collect())) == sorted(rows)
