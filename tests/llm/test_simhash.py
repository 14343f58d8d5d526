"""Fingerprints and groups against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from twinlink.llm import queries, simhash

SF_DIR = "/root/testdata/sf0.001"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    values = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_groups(prints, budget=4):
    """prints: list of (id, fp). The smallest id reachable, for each row."""
    fps = sorted({fp for _, fp in prints})
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(fps, dtype=np.uint64)
    for i, fp in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= budget):
            root[find(fps[i + 1 + j])] = find(fp)
    least = {}
    for i, fp in prints:
        if i is not None:
            least[find(fp)] = min(i, least.get(find(fp), i))
    return sorted((i is None, i or 0, fp, least.get(find(fp))) for i, fp in prints)


def rows(df):
    return sorted((r[0] is None, r[0] or 0, r[1] % 2**64, r[2]) for r in df.collect())


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    want = brute_groups([(d.doc_id, brute_print(d.text)) for d in docs])
    got = queries.op8_simhash_near_dedup(spark, SF_DIR).collect()
    assert sorted((False, r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == want
    assert all(len(r.fingerprint) == 16 for r in got)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "one", "One", "one two three", "ONE two three", long, long, "é è ü words of four five", "É"]
    docs = spark.createDataFrame(
        [(i if i != 5 else None, t, "x", 7) for i, t in enumerate(texts)] + [(3, "one", "y", 8)],
        "doc_id long, text string, fp string, component_id int",
    )
    want = brute_groups([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    assert rows(simhash.simhash_groups(docs)) == want
    empty = docs.where("false")
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns


def test_one_row_of_each_group_stays(spark):
    """Also of rows that share the smallest id, and of groups without any id."""
    texts = [
        (5, "one two three four five"), (5, "ONE two three four five"), (7, "one two three four five"), (None, "one two three four five"),
        (8, "quite another text of more words"), (8, "quite another text of more words"), (None, "no id here"), (None, "no id here"),
        (9, None), (2, ""), (9, " "), (8, "a third one, under an id that stands elsewhere as well"),
    ]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, at string, row_key int").repartition(3)
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    got = sorted((repr(r.doc_id), (r.text or "").lower()) for r in kept.collect())
    groups = {}
    for i, t in texts:
        groups.setdefault(brute_print(t), []).append((i is None, i or 0, repr(i), (t or "").lower()))
    assert got == sorted(min(g)[2:] for g in groups.values())
    assert simhash.keep_first(docs.where("false")).count() == 0


@pytest.mark.parametrize("node_rows", [2048, 8])
def test_links_of_random_families(spark, node_rows):
    """Families of fingerprints around a centre, some chained, so that fronts are shared; with small nodes the join is walked."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([2, 30, 60])):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 9])):
                x ^= 1 << b
            fps.add(x)
            if rng.random() < 0.1:
                centre = x
    prints = [(i, fp) for i, fp in enumerate(sorted(fps))]
    df = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for _, fp in prints], "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.link_fingerprints(df, node_rows=node_rows).collect()}
    want = {}
    groups = {}
    for _, _, fp, least in brute_groups(prints):
        groups.setdefault(least, []).append(fp)
    for members in groups.values():
        if len(members) > 1:
            for m in members:
                want[m] = min(members, key=lambda v: v - (1 << 64) if v >> 63 else v)
    assert got == want


@pytest.mark.parametrize("sides", [False, True])
def test_trie_walk_finds_all_pairs(sides):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (40, 2))]))
    side = rng.integers(0, 2, len(fps)) if sides else np.zeros(len(fps), dtype=np.int64)
    order = np.lexsort((fps, side))
    fps, side = fps[order], side[order]
    a, b = simhash.trie_links(np.zeros(len(fps), dtype=np.int64), side, fps, 4)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j)
        for i in range(len(fps))
        for j in range(i + 1, len(fps))
        if bin(int(fps[i] ^ fps[j])).count("1") <= 4 and (not sides or side[i] != side[j])
    }
    assert len(a) == len(got) and got == want
