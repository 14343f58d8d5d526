"""The audit against a version that runs the filters one after the other, and against the registered SQL."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from twinlink.llm import filter_audit, queries
from workload.check import normal, oracle

SF_DIR = "/root/testdata/sf0.001"
NAME = "op12_filter_audit"


def failing(docs):
    """For each (id, text, part) the letters of the filters it fails, found by comparing all with all."""
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        bad |= {"A"} if len(w) < 50 else set()
        bad |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            bad.add("E")
        out.append(bad)
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    bad = failing(docs)
    rows, shares = {}, {}
    for part in {p or "" for _, _, p in docs}:
        mine = [(i, b) for (i, _, p), b in zip(docs, bad) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [(i, b) for i, b in left if c in b]
                left = [(i, b) for i, b in left if c not in b]
                every = sum(c in b for _, b in mine)
                known = lambda ids: sum(i is not None and i in ids for i, _ in gone)  # noqa: E731, B023
                rows[part, "".join(order), step] = (
                    len(left), len(gone), every - len(gone), sum(b == {c} for _, b in mine), known(good), known(toxic),
                )
                shares[part, c] = shares.get((part, c), 0) + len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def rows(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


LONG = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (None, LONG, "a"), (4, None, None), (5, "", ""), (6, "", "a"),
    (7, LONG + " #", "a"), (8, "same " * 80, "b"), (9, "A" * 500, "b"), (10, "A" * 500, "b"), (11, LONG.upper(), "c"), (12, LONG.upper() + "|", "c"),
    (13, "é€😀 " * 100, "c"), (14, "x" * 200_000, "c"), (15, "\t\n\x0b\x0c\r ", "c"), (None, None, None), (-5, LONG + " #", "a"),
    (16, "one\xa0two\x1fthree " * 60, "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (99, 1, 1), (None, 1, 1), (10, 1, 1), (14, 0, 1)]


@pytest.fixture()
def odd(spark):
    docs = spark.createDataFrame([(*d, "x", 0) for d in DOCS], "doc_id long, text string, source string, mask string, row int")
    return docs, spark.createDataFrame([(*m, 5) for m in LABELS], "doc_id long, quality int, toxic int, bits int")


def test_odd_rows(odd):
    got = rows(filter_audit.audit(*odd).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    want = brute(DOCS, LABELS)
    assert got == want
    assert len(got) == 4 * 600
    assert any(v[4] for v in got.values()) and any(v[5] for v in got.values())


def test_copies_of_one_text_are_compared_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SALT_ROWS", 3)
    docs = spark.createDataFrame([(i % 40, LONG if i < 60 else f"{LONG} {i % 7}", "a") for i in range(100)], "doc_id long, text string, source string")
    got = filter_audit.failures(docs, filter_audit.CONDITIONS).groupBy("mask").count().collect()
    bad = failing([tuple(r) for r in docs.collect()])
    assert {r["mask"] & 16: r["count"] for r in got} == {16: sum("E" in b for b in bad), 0: sum("E" not in b for b in bad)}


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "ab", "p"), (2, "a", "p"), (3, "ab", "p")], "doc_id int, text string, source string")
    conditions = {"S": lambda t: F.length(t) < 2}
    out = filter_audit.audit(docs, spark.createDataFrame([], "doc_id int, quality int, toxic int"), conditions)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in out.collect()}
    assert got == {("SE", 1): (2, 1, 0, 1, 2), ("SE", 2): (1, 1, 0, 1, 2), ("ES", 1): (2, 1, 0, 1, 2), ("ES", 2): (1, 1, 0, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.interactions(docs, "AAB")


def test_no_rows(odd):
    docs, labels = odd
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert rows(filter_audit.audit(docs, labels.where("false"))).keys() == brute(DOCS, []).keys()


def test_query(spark):
    got = [r.asDict() for r in queries.queries()[NAME](spark, SF_DIR).collect()]
    assert normal(got) == normal(oracle(SF_DIR, queries.oracle_sql()[NAME]))
