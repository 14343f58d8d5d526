"""Scores of texts with words whose probability is no floating-point number."""

import math
import random

import numpy as np
import pytest

from twinlink.llm import lattice_lm, queries, sentencepiece_codec


@pytest.mark.parametrize("max_frequent", [10**6, 3])
def test_unseen_long_words_keep_their_length(spark, max_frequent):
    vocabulary = sentencepiece_codec.load_vocabulary(queries.pieces_file())
    rng = random.Random(3)
    long, short = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789☃") for _ in range(n)) for n in (20_000, 600))
    train = ["the cat sat on the mat", "the dog and the cat", "a dog", f"once {short}"]
    held = [f"the {long} cat", f"{long} {long} the {long}", f"{short} dog", "the cat"]
    rows = list(enumerate(train)) + [(100 + i, t) for i, t in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice_lm.lattice_scores(df, vocabulary, lambda i: i >= 100, max_frequent=max_frequent).collect()}

    counts = {}
    for text in train:
        for w in text.split():
            counts[w] = counts.get(w, 0) + 1
    total, types = sum(counts.values()) + len(train), len(counts) + 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    into = np.zeros(len(vocabulary.pieces) + 1)
    first = lattice_lm.Lattice(vocabulary)
    for w in counts:
        first.expect(w, into)
    lattice = lattice_lm.Lattice(vocabulary, into)

    def log_prior(w):
        own = max((len(train) if w is None else counts.get(w, 0)) - discount, 0) / total
        free = math.log(discount * types / total) + (lattice.end if w is None else lattice.word(w))
        return np.logaddexp(math.log(own) if own else -math.inf, free)

    assert log_prior(long) < -20_000
    fits = []
    for alpha in lattice_lm.CONCENTRATIONS:
        by_doc = {}
        for i, text in rows:
            seen, value = {}, 0.0
            for n, w in enumerate([*text.split(), None]):
                again = math.log(seen[w]) if w in seen else -math.inf
                value += (np.logaddexp(math.log(alpha) + log_prior(w), again) - math.log(alpha + n)) / math.log(10)
                seen[w] = seen.get(w, 0) + 1
            by_doc[i] = value
        fits.append(by_doc)
    assert min(max(abs(got[i] / fit[i] - 1) for i in fit) for fit in fits) < 1e-6
