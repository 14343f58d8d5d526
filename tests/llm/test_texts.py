"""Scoring, toxicity, encoding and token counts: brute-force versions, round trips and held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from twinlink.llm import lattice_lm, queries, sentencepiece_codec, token_counts, toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_codec.load_vocabulary(queries.pieces_file())


ODD = [None, "", " ", "  a  b ", "a▁b", "😀x ☃☃ é", "\n\n\t", "word " * 3000, "x" * 20_000, "Thntblere of then, edtioner", "ÀÉ\u0000z"]


@pytest.fixture()
def odd(spark):
    rows = [(i, t, "x", 5.0) for i, t in enumerate(ODD)] + [(None, "some text", "y", 1.0), (3, "some text", "z", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score double")


def test_encoding_is_the_viterbi_path_of_the_library(spark, vocabulary):
    """The library itself, told that the same pieces and scores are a unigram model, is the reference."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(queries.pieces_file(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder = vocabulary.encoder()
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()] + [t for t in ODD if t and len(t) < 1000]

    def weight(ids):
        return sum(vocabulary.scores[i] if vocabulary.normal[i] else 0.0 for i in ids)

    for text in texts:
        mine, theirs = encoder.encode(text).tolist(), library.encode(text)
        assert mine == theirs or weight(mine) >= weight(theirs)


def test_round_trip(spark, odd, vocabulary):
    out = sentencepiece_codec.encode_texts(odd, vocabulary, keep=("score",))
    back = sentencepiece_codec.decode_ids(out, vocabulary)
    got = {(r.doc_id, r.n_tokens): r for r in out.collect()}
    assert all(r.round_trip == (r.doc_id != 4) and len(r.ids) == r.n_tokens for r in got.values())
    texts = sorted((r.text for r in back.collect()))
    assert texts == sorted((t or "").replace("▁", " ") for t in [*ODD, "some text", "some text"])
    assert sentencepiece_codec.encode_texts(odd.where("false"), vocabulary).count() == 0
    docs = queries.op4_sentencepiece(spark, SF_DIR).where("not round_trip").count()
    assert docs == 0


def test_histogram_answers_every_limit(spark, vocabulary):
    encoder = vocabulary.encoder()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sizes = sorted(len(encoder.encode(r.text or "")) for r in docs.collect())
    rows = queries.op6_token_counts(spark, SF_DIR).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(sizes))
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.total_docs, r.total_tokens) == (sizes.count(n), len(sizes), sum(sizes))
        assert r.docs_at_least == sum(s >= n for s in sizes) and r.tokens_at_least == sum(s for s in sizes if s >= n)
        assert r.truncated_tokens == sum(min(s, n) for s in sizes)
        assert r.quantile == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(docs, vocabulary)).cache()
    for limit in (0, 1, 77, 1024, 10**7):
        assert token_counts.truncated_total(histogram, limit) == sum(min(s, limit) for s in sizes)
    for share in (0.0, 0.5, 0.99, 1.0):
        assert token_counts.length_quantile(histogram, share) == next(s for s in sizes if sum(x <= s for x in sizes) >= share * len(sizes))
    histogram.unpersist()


def test_histogram_of_odd_rows(odd, vocabulary):
    lengths = token_counts.encoded_lengths(odd, vocabulary)
    assert lengths.where("n_tokens = 0").count() == 2
    assert token_counts.length_histogram(lengths.where("false")).count() == 0


def test_lattice_sums_over_all_segmentations(vocabulary):
    lattice = lattice_lm.Lattice(vocabulary)
    pieces = {}
    for word in ("the", "erthé", "☃a", "x"):
        for i, row in enumerate(lattice._arcs(word)):
            pieces.update({(word, i, a[0]): a for a in row})

        def total(at, word=word):
            if at == 0:
                return 1.0
            return sum(math.exp(a[1]) * total(a[0]) for a in lattice._arcs(word)[at])

        assert lattice.word(word) == pytest.approx(math.log(total(len(word) + 1)), rel=1e-9)
    into = np.zeros(len(vocabulary.pieces) + 1)
    lattice.expect("the", into)
    arcs = lattice._arcs("the")

    def walks(at):
        if at == 0:
            yield 1.0, 0
        else:
            for start, log_p, _, _ in arcs[at]:
                for p, n in walks(start):
                    yield p * math.exp(log_p), n + 1

    every = list(walks(4))
    assert into.sum() == pytest.approx(sum(p * n for p, n in every) / sum(p for p, _ in every))


def test_scores_against_token_by_token_probabilities(spark, vocabulary):
    """The base by its formula; the model's score as a product over tokens, each under the words before it."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").limit(80)
    rows = docs.collect()
    for frequent in (10**6, 50):
        got = {r.doc_id: r for r in lattice_lm.lattice_scores(docs, vocabulary, lambda i: queries.held_out(i, 1), max_frequent=frequent).collect()}
        counts, ends = {}, 0
        split = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in rows}
        for i, words in split.items():
            if zlib.crc32(str(i).encode()) % 5 != 1:
                ends += 1
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
        total, types = sum(counts.values()) + ends, len(counts) + 1
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount = once / (once + 2 * twice)
        into = np.zeros(len(vocabulary.pieces) + 1)
        first = lattice_lm.Lattice(vocabulary)
        for w in counts:
            first.expect(w, into)
        lattice = lattice_lm.Lattice(vocabulary, into)
        memory = {}

        def prior(w):
            if w not in memory:
                own = ends if w is None else counts.get(w, 0)
                memory[w] = max(own - discount, 0) / total + discount * types / total * math.exp(lattice.end if w is None else lattice.word(w))
            return memory[w]

        fits = []
        for alpha in lattice_lm.CONCENTRATIONS:
            by_doc = {}
            for i, words in split.items():
                seen, value = {}, 0.0
                for n, w in enumerate([*words, None]):
                    value += math.log10((alpha * prior(w) + seen.get(w, 0)) / (alpha + n))
                    seen[w] = seen.get(w, 0) + 1
                by_doc[i] = value
            fits.append(by_doc)
        worst = min(max(abs(got[i].score / fit[i] - 1) for i in fit) for fit in fits)
        assert worst < 1e-5
        for i, words in split.items():
            base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in words)
            base += math.log10((ends + 0.5) / (total + 0.5 * (types + 1)))
            assert got[i].base_score == pytest.approx(base) and got[i].train_tokens == total
            assert got[i].n_tokens == len(words) + 1 and got[i].n_known == sum(w in counts for w in words) + 1
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_scores_of_odd_rows(odd, vocabulary):
    out = lattice_lm.lattice_scores(odd, vocabulary, lambda i: queries.held_out(i, 1)).collect()
    assert len(out) == len(ODD) + 2 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert [r.n_tokens for r in out if r.doc_id in (0, 1, 2)] == [1, 1, 1]
    assert lattice_lm.lattice_scores(odd.where("false"), vocabulary, lambda i: queries.held_out(i, 1)).count() == 0
    nothing = lattice_lm.lattice_scores(odd, vocabulary, lambda i: i == i).collect()
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in nothing)


def _area(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / (y == 1).sum() / (y == 0).sum()


def test_toxicity_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.op5_toxicity(spark, sf_dir)
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert _area(y, s) > 0.87
    assert np.mean([r.toxic for r in rows if r.predicted]) > 0.85


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(11)] + [(None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    for held in (lambda i: i < 0, lambda i: i >= 0, lambda i: i != 8):
        model = toxicity.learn(odd, labels, held)
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(odd.where("false"), model).count() == 0
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score < 0.5 for r in rows)
