"""Files with line breaks in quotes and one-line objects, cut into many splits."""

import json
import random

import pandas as pd
import pytest

from twinlink.sources import files, splitting


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "40"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def random_file(path, seed, sep="|", end="\n", n=90):
    rng = random.Random(seed)
    parts = ["a", "Ü", sep, '"', '""', "\n", "\n\n", " ", "long word", "x" * 150, '"\n"', f'"{sep}"']
    lines, want = [], []
    for i in range(n):
        values = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 6))) for _ in range(2)]
        # A bare value may hold quotes, but not in front.
        cells = ['5" tv "new', values[1]] if i % 7 == 0 else values
        cells = [str(i), *cells]
        text = [c if c and not set(c) & {"\n", sep} and c[0] not in ' "' else '"' + c.replace('"', '""') + '"' for c in cells]
        lines.append(sep.join(text))
        want.append(tuple(c or None for c in cells))  # as Spark's own reader has it
    path.write_bytes((end.join([sep.join(["id", "Title", "price"]), *lines]) + (end if seed % 2 else "")).encode())
    return want


@pytest.mark.parametrize("seed, sep, end", [(1, "|", "\n"), (2, ",", "\n"), (3, "\t", "\n"), (4, "^", "\r\n")])
def test_quoted_line_breaks_in_many_splits(spark, tmp_path, small_splits, seed, sep, end):
    path = tmp_path / "d.csv"
    want = random_file(path, seed, sep, end)
    df = files.scan_entities(spark, str(path), sep=sep, multi_line=True, with_position=True)
    assert df.columns == ["id", "Title", "price", files.ROW_POS]
    got = [tuple(r)[:3] for r in df.orderBy(files.ROW_POS).collect()]
    assert got == want
    read = pd.read_csv(path, sep=sep, dtype=str, keep_default_na=False)
    assert got == [tuple(v or None for v in r) for r in read.itertuples(index=False)]
    whole = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True).csv(str(path))
    assert sorted(got, key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert df.select(f"{files.ROW_POS}.start").distinct().count() > 3


def test_several_files_each_with_its_header(spark, tmp_path, small_splits):
    want = random_file(tmp_path / "a.csv", 5) + random_file(tmp_path / "b.csv", 7)
    df = files.scan_entities(spark, str(tmp_path), ["id", "Title", "price"], multi_line=True)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("names", [["Title", "id", "price"], ["id", "Title"], ["id", "Title", "price", "more"]])
def test_another_header_fails(spark, tmp_path, names):
    random_file(tmp_path / "a.csv", 5)
    with pytest.raises(Exception, match="the header is not"):
        files.scan_entities(spark, str(tmp_path / "a.csv"), names, multi_line=True).collect()


def test_empty_files_and_missing_values(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id|t|p\n1||""\n\n2|x\n')
    df = files.scan_entities(spark, str(path), multi_line=True)
    assert sorted(map(tuple, df.collect())) == [("1", None, None), ("2", "x", None)]
    path.write_text("id|t|p")
    assert files.scan_entities(spark, str(path), multi_line=True).collect() == []


@pytest.mark.parametrize("indent", [None, 4])
def test_one_object_in_many_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(11)
    marks = ["a", "], ", "]", '"', "\\", '\\"', ", ", "[", "{", "}", "Ü", "\n", "]}"]
    name = lambda i: f"{i}" + "".join(rng.choice(marks) for _ in range(rng.randrange(0, 5)))
    pairs = {name(i): [name(j) for j in range(rng.randrange(0, 40 if i % 9 == 0 else 4))] for i in range(150)}
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps(pairs, indent=indent))
    df = files.scan_pairs_json(spark, str(path), "compact")
    want = sorted((d1, at, d2) for d1, ids in pairs.items() for at, d2 in enumerate(ids))
    assert sorted(map(tuple, df.collect())) == want
    assert spark.read.text(str(path), lineSep="]").rdd.getNumPartitions() > 5


def test_broken_object_fails(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text('{"a": ["x", "y"], "b": "z"], "c": ["u"]}')
    with pytest.raises(Exception, match="not an entry"):
        files.scan_pairs_json(spark, str(path), "compact").collect()
    path.write_text("{}")
    assert files.scan_pairs_json(spark, str(path), "compact").collect() == []


def test_more_splits_than_a_broadcast_takes(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(splitting, "BROADCAST_SPLITS", 3)
    path = tmp_path / "d.csv"
    want = random_file(path, 13)
    df = files.scan_entities(spark, str(path), multi_line=True)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
