"""Removed lines against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from twinlink.llm import line_dedup, queries

SF_DIR = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b, edits):
    """Whether equal beginnings and at most ``edits`` changes lead from one to the other, tried in all ways."""
    if abs(len(a) - len(b)) > edits:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    return edits > 0 and any(near(x, y, edits - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def brute(docs, edits=2, min_chars=20):
    """docs: list of (id, text). Rows (id, number of lines, number of removed ones, their numbers).

    Of lines of fewer than ``min_chars`` characters only equal ones repeat each other; empty lines stay."""
    first = {}
    for i, text in docs:
        for n, line in enumerate(text.split("\n")) if text is not None else ():
            at = (i is None, i or 0, n)
            first[line] = min(at, first.get(line, at))
    by_length = {}
    for line in first:
        if len(line) >= min_chars:
            by_length.setdefault(len(line), []).append(line)
    earliest = dict(first)
    for line, at in first.items():
        if len(line) >= min_chars:
            others = [o for d in range(-edits, edits + 1) for o in by_length.get(len(line) + d, ()) if first[o] < at and near(line, o, edits)]
            earliest[line] = min([at, *(first[o] for o in others)])
    out = []
    for i, text in docs:
        lines = text.split("\n") if text is not None else []
        gone = [n for n, x in enumerate(lines) if x and earliest[x] < (i is None, i or 0, n)]
        out.append((i, len(lines), len(gone), ",".join(map(str, gone))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query_on_documents(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = rows(queries.op9_line_dedup(spark, SF_DIR).select("doc_id", "n_lines", "n_removed", "removed_lines"))
    assert got == brute(docs)


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_band_of_bits_gives_the_edit_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("ab", "ba"), ("é€😀x", "é€x")]
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, edits + 2)):
            at, what = rng.randint(0, len(b)), rng.choice("ird")
            b[at : at + (what != "i")] = [rng.choice("abé")] if what != "d" else []
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect()
    assert [r.near for r in got] == [distance(r.a, r.b) <= edits for r in got]


@pytest.fixture()
def odd(spark):
    rng = random.Random(2)
    base = ["the first line of them all", "a second line, équally long", "x" * 300, "a" * 40, "ab" * 20]
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "\n".join(base)), (5, "\n".join(base)), (None, "\n".join(base[:2])), (None, "short\n" + base[0])]
    for i in range(6, 40):
        out = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(line))
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            out.append("".join(line))
        docs.append((i, "\n".join(out)))
    docs += [(7, "once more, the first line\nthe first line of them all"), docs[8]]
    return spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, line string, removed int")


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_odd_rows(odd, edits):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    out = line_dedup.removed_lines(odd, edits=edits)
    got = rows(out.select("doc_id", "n_lines", F.size("removed"), F.array_join("removed", ",")))
    assert got == brute(docs, edits)
    assert any(r[2] for r in got)


def test_kept_texts(odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = []
    gone = {}
    for i, n, _, numbers in brute(docs):
        gone.setdefault((i, n), []).append([int(x) for x in numbers.split(",") if x])
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns
    for i, text in docs:
        lines = text.split("\n") if text is not None else []
        options = {"\n".join(x for k, x in enumerate(lines) if k not in g) for g in gone[(i, len(lines))]}
        want.append((i, None if text is None else options))
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(want)
    for i, text in got:
        assert any(i == j and (text is None if o is None else text in o) for j, o in want)


def test_no_rows(odd):
    assert line_dedup.removed_lines(odd.where("false")).count() == 0
    assert line_dedup.drop_repeated_lines(odd.where("text is null")).collect()[0].text is None


def test_sketches_of_near_lines_agree(spark):
    """Also where a letter's number passes a multiple of 32; the sketches of lines with other letters differ."""
    texts = ["e" * 31 + "xyz", "e" * 32 + "xyz", "t" + "e" * 31 + "xy", "a" * 3 + "e" * 31 + "xyz", "ä€" + "e" * 31 + "xyz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(line_dedup.sketch(F.col("t")).alias("s"), "t")
    first = df.where(F.col("t") == texts[0]).select(F.col("s").alias("f"))
    agree = {r.t: r.ok for r in df.join(first).select("t", line_dedup.sketches_agree(F.col("s"), F.col("f"), 1).alias("ok")).collect()}
    assert [agree[t] for t in texts] == [True, True, True, False, True]


@pytest.mark.parametrize("edits", [1, 2])
def test_equal_short_lines_go_and_near_ones_stay(spark, edits):
    nineteen, twenty = "n" * 19, "n" * 20
    docs = [
        (1, "Home\n\nHome\nHome "), (2, f"home\nHome\n\n \n{nineteen}\n{twenty}"), (3, f"x\n{nineteen}\n{nineteen}q\n{twenty}\n \nHomf"),
        (4, None), (5, ""), (None, "x\nHome\ny"), (None, "y"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = line_dedup.removed_lines(df, edits=edits)
    got = rows(out.select("doc_id", "n_lines", F.size("removed"), F.array_join("removed", ",")))
    assert got == brute(docs, edits)
    assert (1, 4, 1, "2") in got and (2, 6, 1, "1") in got and (3, 6, 4, "1,2,3,4") in got
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df, edits=edits).collect()}[3] == "x\nHomf"
