"""Framed outputs against plain string work, and exact round trips."""

import hashlib
import random

import pytest

from twinlink.llm import fim_frames, queries
from workload.check import normal, oracle

SF_DIR = "/root/testdata/sf0.001"
NAME = "op13_fim_frames"


def plain(doc_id, text):
    """(units, form, prefix, middle, output) by cutting a string."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture()
def odd(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "<P>", "x <S> y", "<M", "M>", "<<P", "<P<S", "P>S>M>", "é" * 9, "€😀" * 40, "a\x00b", "﻿x"]
    texts += ["".join(rng.choice("ab é😀<PSM>\n") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["".join(rng.choice(["word ", "é€ ", "😀", "<P", "S>"]) for _ in range(90_000)) for _ in range(3)] + ["x" * 300_000]
    docs = [(i - 20, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None), (5, "again"), (5, "again")]
    return docs, spark.createDataFrame([(*d, "f", 1) for d in docs], "doc_id long, text string, frames string, units int")


def test_outputs_and_round_trip(odd, monkeypatch):
    docs, df = odd
    stored = fim_frames.store_frames(df)
    outputs = fim_frames.fill_in_middle(stored)
    want = sorted((*plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in docs)
    out = fim_frames.digests(outputs).select("units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    assert {r[1] for r in want} == {"plain", "psm", "spm"}
    by = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert by(tuple(r) for r in fim_frames.texts(fim_frames.restore(outputs)).collect()) == by((i, t or "") for i, t in docs)
    assert by(tuple(r) for r in fim_frames.texts(outputs).collect()) == by((i, plain(i, t)[4]) for i, t in docs)


def test_whole_frames_are_copied_and_only_cut_ones_opened():
    class Counting(fim_frames.Codec):
        def __init__(self):
            super().__init__()
            self.opened, real = 0, self.open

            def count(data):
                self.opened += 1
                return real(data)

            self.open = count

    codec = Counting()
    text = ("a blank é " * 200_000).encode()
    writer = fim_frames.Writer(codec)
    for k in range(0, len(text), 100_000):
        writer.text(text[k : k + 100_000])
    frames = writer.frames()
    assert len(frames.entries) > 25 and frames.total == 2_000_000
    assert [e[0] for e in frames.entries[1:]] == [a + b for a, b, _ in frames.entries[:-1]]
    assert b"".join(frames.read(1_234_567, 1_234_590)).decode() == text.decode()[1_234_567:1_234_590]
    assert codec.opened == 1
    codec.opened = 0
    out = fim_frames.Writer(codec)
    frames.copy(100_001, 1_900_001, out)
    copied = out.frames()
    assert codec.opened <= 2
    assert {e[2] for e in copied.entries[2:-2]} <= {e[2] for e in frames.entries}
    assert b"".join(copied.read()).decode() == text.decode()[100_001:1_900_001]


def test_marker_found_across_frames():
    codec = fim_frames.Codec()
    raw = "é€".encode() * 5 + b"<S" + b">tail"
    frames = fim_frames.Frames([(0, 10, codec.pack(raw[:25])), (10, 2, codec.pack(raw[25:27])), (12, 5, codec.pack(raw[27:]))], codec)
    assert frames.find(b"<S>", 0) == 10
    with pytest.raises(ValueError):
        frames.find(b"<S>", 11)


def test_text_that_is_no_utf8(spark):
    df = spark.range(3).selectExpr("id AS doc_id", "cast(unhex('80FF41C3') AS string) AS text")
    outputs = fim_frames.fill_in_middle(fim_frames.store_frames(df))
    restored = {r.restored_sha256 for r in fim_frames.digests(outputs).collect()}
    assert restored == {hashlib.sha256(bytes.fromhex("80FF41C3")).hexdigest()}


def test_parts_that_begin_with_a_stray_byte_come_back(spark):
    raws = [b"\x80", b"\x80\x81", b"a\x80b\x81\xc3" * 3, b"\x80" * 9 + "é".encode()]
    rows = " UNION ALL ".join(f"SELECT {at} AS at, cast(unhex('{raw.hex()}') AS string) AS text" for at, raw in enumerate(raws))
    df = spark.sql(f"SELECT id * 4 + at AS doc_id, text FROM range(12) JOIN ({rows}) ON true")
    outputs = fim_frames.fill_in_middle(fim_frames.store_frames(df))
    made = fim_frames.digests(outputs).collect()
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert all(r.restored_sha256 == hashlib.sha256(raws[r.doc_id % 4]).hexdigest() for r in made)
    back = fim_frames.texts(fim_frames.restore(outputs)).selectExpr("doc_id", "cast(text AS binary) AS raw").collect()
    assert len(back) == 48 and all(bytes(r.raw) == raws[r.doc_id % 4] for r in back)


def test_other_parameters_and_no_rows(spark):
    df = spark.createDataFrame([("k", "some text"), ("l", "|other|")], "name string, body string")
    marks = (b"|p|", b"|s|", b"|m|")
    stored = fim_frames.store_frames(df, "name", "body", marks)
    outputs = fim_frames.fill_in_middle(stored, "name", marks, plain_from=100, spm_below=0)
    assert {r.name: r.form for r in outputs.collect()} == {"k": "psm", "l": "psm"}
    assert {r.name: r.text for r in fim_frames.texts(fim_frames.restore(outputs, "name", marks), "name").collect()} == {"k": "some text", "l": "|other|"}
    assert fim_frames.digests(fim_frames.fill_in_middle(fim_frames.store_frames(df.where("false"), "name", "body"), "name"), "name").count() == 0


def test_query(spark):
    got = [r.asDict() for r in queries.queries()[NAME](spark, SF_DIR).collect()]
    assert normal(got) == normal(oracle(SF_DIR, queries.oracle_sql()[NAME]))
