"""Removed words against a brute-force version."""

import hashlib
import random
import re

import pytest

from twinlink.llm import queries, substring_dedup

SF_DIR = "/root/testdata/sf0.001"


def brute(docs, k=13):
    """docs: list of (id, text). Rows (id, words, removed words, kept text, longest level)."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    out = []
    levels = [k]
    while any(len(w) >= 2 * levels[-1] for _, w in split):
        levels.append(2 * levels[-1])
    first = {}
    for n in levels:
        for i, w in split:
            if i is not None:
                for p in range(len(w) - n + 1):
                    key = tuple(w[p : p + n])
                    first[key] = min(i, first.get(key, i))
    for i, w in split:
        gone, longest = set(), 0
        if i is not None:
            for n in levels:
                for p in range(len(w) - n + 1):
                    if first[tuple(w[p : p + n])] < i:
                        longest = n
                        if n == k:
                            gone.update(range(p, p + n))
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone), longest))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def test_query_on_documents(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    want = [(i, n, r, hashlib.sha256(t.encode()).hexdigest(), k) for i, n, r, t, k in brute(docs)]
    got = [tuple(r) for r in queries.op2_substring_dedup(spark, SF_DIR).select("doc_id", "n_words", "n_removed", "kept_sha256", "longest").collect()]
    assert sorted(got) == sorted(want)
    assert sum(r for _, _, r, _, _ in want) > 0
    assert len({k for *_, k in want}) > 2


@pytest.fixture()
def odd(spark):
    rng = random.Random(1)
    words = ["la", "é", "x.", "%%%", "Of", "of"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n\t ", passage, passage, "start " + passage + " end", passage.replace(" ", "\x0b\n", 20), " ".join(passage.split()[:12])]
    texts += [" ".join(rng.choice(words) for _ in range(200)) + " " + passage[20:150] for _ in range(12)]
    texts += ["a " * 5000, "a " * 40, "b" * 100_000]
    rows_ = [(i, t, "x") for i, t in enumerate(texts)] + [(None, passage, "y"), (4, passage, "z"), (2, "a " * 30, "z")]
    return spark.createDataFrame(rows_, "doc_id long, text string, n_words string").repartition(3)


def test_odd_rows_and_levels(spark, odd, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 5000)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(docs)
    got = rows(substring_dedup.repeated_words(odd))
    assert got == want
    assert {r[4] for r in want} >= {0, 26, 52}


def test_no_rows(odd):
    assert substring_dedup.repeated_words(odd.where("false")).count() == 0
    assert substring_dedup.repeated_words(odd.where("text is null")).collect()[0].n_words == 0


def test_other_lengths(odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    for k in (1, 2, 6):
        got = rows(substring_dedup.repeated_words(odd, min_words=k, max_words=k).drop("longest"))
        assert got == [r[:4] for r in brute(docs, k)]


def test_large_ids_next_to_null_ones(spark):
    """Ids that doubles cannot hold, in one block with a null id."""
    text, big = " ".join(f"w{i}" for i in range(20)), 1 << 60
    docs = [(big + 3, text), (big + 1, text), (None, text), (-big - 1, "x " + text), (None, None), ((1 << 63) - 2, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = rows(substring_dedup.repeated_words(df))
    assert got == brute(docs)
    assert {r[0]: r[2] for r in got if r[0] is not None} == {big + 3: 20, big + 1: 20, -big - 1: 0, (1 << 63) - 2: 0}
