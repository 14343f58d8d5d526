"""Packed pieces against ids encoded in the test, and the linear program against small cases known by hand."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from twinlink.llm import packing, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(queries.tokenizer_json())


def encoded(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, want, capacity):
    """``pieces``: (doc, start, length, ids or crc, doc_tokens, sequence, offset); ``want``: ids by doc. Returns padding."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, ids, total, sequence, offset in pieces:
        by_doc.setdefault(doc, []).append((start, length, ids, total))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert by_doc.keys() == want.keys()
    for doc, parts in by_doc.items():
        at = 0
        for start, length, ids, total in sorted(parts):
            own = want[doc][start : start + length]
            assert start == at and length > 0 and total == len(want[doc])
            assert ids == (own if isinstance(ids, list) else zlib.crc32(np.array(own, dtype="<u4").tobytes()))
            at += length
        assert at == len(want[doc])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def rows(df):
    return [(r.doc_id, r.start, r.length, r.ids, r.doc_tokens, r.sequence_id, r.offset) for r in df.collect()]


def test_query_on_documents(spark, tokenizer):
    want = {d.doc_id: encoded(tokenizer, d.text) for d in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = [tuple(r) for r in queries.op11_cutting_stock_packing(spark, SF_DIR).collect()]
    assert check(got, want, 2048) == 0
    tokens = sum(map(len, want.values()))
    assert len({r[5] for r in got}) <= tokens // 2048 + 12


@pytest.mark.parametrize("capacity", [16, 64, 2048])
def test_odd_rows(spark, tokenizer, capacity):
    rng = random.Random(capacity)
    texts = [None, "", " ", "one", "é€😀\x00", "<|endoftext|> x", "word " * 3000, "x" * 5000, "\n\n  \t"]
    texts += ["".join(rng.choice(["a", " b", "\n", " long", "é"]) for _ in range(rng.randint(0, 150))) for _ in range(200)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*d, "s", 3) for d in docs], "doc_id int, text string, ids string, length int").repartition(3)
    packed = packing.pack(df, queries.tokenizer_json(), capacity=capacity)
    want = {i: encoded(tokenizer, t) for i, t in docs}
    assert check(rows(packed), want, capacity) == 0
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(map(len, want.values()))
    first = min(want)
    piece = next(r for r in packed.collect() if r.doc_id == first and r.start == 0)
    assert next(r.ids for r in whole if r.sequence_id == piece.sequence_id)[piece.offset : piece.offset + piece.length] == piece.ids


def test_repeated_and_null_ids(spark, tokenizer):
    df = spark.createDataFrame([(7, "same text")] * 5 + [(None, "other")] * 3 + [(7, None)], "doc_id long, text string")
    out = packing.pack(df, queries.tokenizer_json(), capacity=8)
    assert sum(r.length for r in out.collect()) == 5 * len(encoded(tokenizer, "same text")) + 3 * len(encoded(tokenizer, "other")) + 1
    assert packing.pack(df.where("false"), queries.tokenizer_json()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, queries.tokenizer_json(), capacity=10)


def test_ids_are_those_of_the_file(tokenizer, monkeypatch):
    """Every code point, and texts cut into parts, against the file's own library."""
    encode = packing.byte_level_encoder(queries.tokenizer_json())
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in points[k : k + 97]) for k in range(0, len(points), 97)]
    assert all(encode(t) == e.ids for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)))
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "é ", "  ", "it's ", "x_1 ", "\n ", "😀", " <|endoftext|> ", "..."]) for _ in range(500)) for _ in range(20)]
    texts += ["", "z" * 300, "no" + " " * 200 + "blank"]
    assert max(map(len, map(packing._parts, texts))) > 3
    assert [packing._encode(encode, t, 1).tolist() for t in texts] == [encoded(tokenizer, t) for t in texts]


def used(found):
    out = {}
    for pattern, n in found:
        for l, k in pattern.items():
            out[l] = out.get(l, 0) + k * n
    return out


def test_patterns_of_known_cases():
    # Three lengths that fill a sequence together, in equal numbers.
    found = packing.patterns({7: 30, 5: 30, 4: 30}, 16)
    assert sum(n for _, n in found) == 30 and used(found) == {7: 30, 5: 30, 4: 30}
    # Greedy takes 9 + 6 and leaves 5 + 5 + 5 and others; the program finds 9 + 7 and 6 + 5 + 5.
    found = packing.patterns({9: 40, 7: 40, 6: 40, 5: 80}, 16)
    assert sum(n for _, n in found) == 80 and used(found) == {9: 40, 7: 40, 6: 40, 5: 80}
    assert packing.patterns({16: 3}, 16) == [({16: 1}, 3)]
    assert packing.patterns({}, 16) == []


@pytest.mark.parametrize("seed", range(8))
def test_patterns_and_places_of_random_histograms(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([8, 64, 256]))
    histogram = {int(l): int(n) for l, n in zip(range(1, capacity + 1), rng.integers(0, 30, capacity)) if n and rng.random() < 0.6}
    found = packing.patterns(histogram, capacity, max_tables=int(rng.choice([0, 5, 1000])))
    assert all(sum(l * k for l, k in p.items()) <= capacity and n > 0 for p, n in found)
    assert all(n <= histogram[l] for l, n in used(found).items())
    places = packing._Places(histogram, found, capacity)
    lengths = np.repeat(list(histogram), list(histogram.values()))
    ranks = np.concatenate([np.arange(n) for n in histogram.values()])
    mixed = rng.permutation(len(lengths))
    owner, start, size, sequence, offset = places.cuts(lengths[mixed], ranks[mixed])
    pieces = [(int(o), int(a), int(s), None, 0, int(q), int(f)) for o, a, s, q, f in zip(owner, start, size, sequence, offset)]
    totals = np.bincount(sequence, size).astype(int)
    assert totals.max() <= capacity and totals.sum() == lengths.sum()
    assert all(t == capacity or t & (t - 1) == 0 for t in totals.tolist())
    for o in range(len(lengths)):
        mine = sorted((p[1], p[2]) for p in pieces if p[0] == o) if o < 50 else []
        assert not mine or (mine[0][0] == 0 and sum(s for _, s in mine) == lengths[mixed][o])
    by = {}
    for p in pieces:
        by.setdefault(p[5], []).append((p[6], p[2]))
    for parts in by.values():
        at = 0
        for f, s in sorted(parts):
            assert f == at
            at += s
