"""Hits of benchmark windows against a brute-force version and the registered SQL."""

import hashlib
import re

import pytest

from twinlink.llm import decontaminate, queries
from workload.check import normal, oracle

SF_DIR = "/root/testdata/sf0.001"
NAME = "op10_benchmark_decontamination"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = []
    for i, text in items:
        w = words(text)
        if i is not None and w:
            m = min(size, len(w))
            windows += [(str(i), w[p : p + m]) for p in range(len(w) - m + 1)]
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_query_against_sql(spark):
    got = [r.asDict() for r in queries.queries()[NAME](spark, SF_DIR).collect()]
    want = oracle(SF_DIR, queries.oracle_sql()[NAME])
    assert normal(got) == normal(want)
    assert any(r["contaminated"] for r in got)


@pytest.fixture()
def tables(spark):
    line = "One two three four five six seven eight nine ten eleven twelve"
    docs = [
        (1, None), (2, ""), (3, "..!"), (4, line), (5, "zero-" + line.replace(" ", "--") + " end"), (6, line.upper() + " " + line),
        (7, "two three"), (8, "É é 10 two three x two three"), (None, line), (4, "other words"), (9, "a " * 3000), (10, "é"), (11, "É"),
    ]
    items = [(1, line), (10, "TWO three!"), (2, line), (None, "zero"), (3, ""), (4, None), (5, "a a a"), (6, "é"), (7, "nine ten eleven twelve thirteen " * 3)]
    return (
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, row int"),
        spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, size int"),
        docs,
        items,
    )


@pytest.mark.parametrize("longs", [1 << 17, 1])
def test_odd_rows(tables, longs, monkeypatch):
    """With a hash set of 64 bits nearly every window is a suspect, and the results stay the same."""
    monkeypatch.setattr(decontaminate, "MAX_LONGS", longs)
    docs_df, items_df, docs, items = tables
    out = decontaminate.contamination(docs_df, items_df)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=repr)
    assert got == brute(docs, items)


def test_removal(tables):
    """Each row is judged by its own text: id 4 has a hit in one of its rows, and so has the row without an id."""
    docs_df, items_df, docs, items = tables
    kept = decontaminate.drop_contaminated(docs_df, items_df)
    assert kept.columns == docs_df.columns
    want = [d for d in docs if not brute([d], items)[0][2]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert (4, "other words") in want and not any(i is None for i, _ in want)
    clean = {r.doc_id: r.clean_text for r in decontaminate.remove_spans(docs_df, items_df).collect()}
    assert clean[5] == "zero end" and clean[8] == "É 10 x" and clean[7] == "" and clean[1] == ""


def test_removal_where_rows_share_an_id(spark):
    line = "one two three four five six seven eight nine ten"
    docs = [(1, "a " + line), (1, line + " b"), (1, "a b c d e f g h i j k"), (None, line), (None, "x y"), (None, "x y")]
    docs_df = spark.createDataFrame([(*d, 5, "z") for d in docs], "doc_id long, text string, row_key int, id string")
    items_df = spark.createDataFrame([("i", line)], "item_id string, text string")
    clean = decontaminate.remove_spans(docs_df, items_df).collect()
    want = [(1, "a"), (1, "b"), (1, "a b c d e f g h i j k"), (None, ""), (None, "x y"), (None, "x y")]
    assert sorted(map(tuple, clean), key=repr) == sorted(want, key=repr)
    kept = decontaminate.drop_contaminated(docs_df, items_df)
    assert kept.columns == docs_df.columns
    assert sorted((r.text, r.row_key, r.id) for r in kept.collect()) == [("a b c d e f g h i j k", 5, "z"), ("x y", 5, "z"), ("x y", 5, "z")]


def test_no_rows(tables):
    docs_df, items_df, docs, _ = tables
    assert decontaminate.contamination(docs_df.where("false"), items_df).count() == 0
    none = decontaminate.contamination(docs_df, items_df.where("false")).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and list(r["items"]) == [] for r in none)
    assert hashlib.sha256(b"").hexdigest() == [r for r in oracle(SF_DIR, "SELECT sha256('') AS h")][0]["h"]
