"""Document probability under a subword lattice: every word by all its segmentations, every document by its burstiness."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.llm.sentencepiece_codec import SPACE, Vocabulary
from twinlink.llm.texts import Words, packs, raw_texts, send_by_value
from twinlink.session import materialise

#: Words whose counts are sent to all tasks, the most frequent ones; the others meet theirs in a join.
MAX_FREQUENT = 300_000
PACK_BYTES = 1 << 21
#: Concentrations of the document model to choose from; the training documents decide.
CONCENTRATIONS = (30.0, 100.0, 300.0, 1000.0, 3000.0, 10_000.0, 100_000.0, 10_000_000.0)
#: Share of the lattice's mass for the end of a text and for each byte of a character without a piece.
END_SHARE, BYTE_SHARE = 0.002, 1e-6


class Lattice:
    """All segmentations of a word into the vocabulary's pieces, each piece weighted by its score.

    The pieces of a text, with an end, are drawn one by one; the probability of a word is the sum over all its
    segmentations. The vocabulary's scores are ranks, so a piece weighs one over its rank, unless ``weights`` (one for
    each piece and a last one for all bytes of characters without a piece) say how often it is expected.
    """

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None):
        usable = [i for i, n in enumerate(vocabulary.normal) if n and vocabulary.scores[i] > -1e8 and vocabulary.pieces[i]]
        ranked = np.array([1.0 / (10.0 - vocabulary.scores[i]) for i in usable])
        ranked /= ranked.sum()
        byte = 256 * BYTE_SHARE
        if weights is not None:
            # A piece that no training word needs keeps a little of its score's weight.
            ranked = 0.98 * weights[usable] / max(weights.sum(), 1e-300) + 0.02 * ranked
            byte += 0.98 * weights[-1] / max(weights.sum(), 1e-300)
            ranked /= ranked.sum()
        self.byte = math.log(byte / 256 * (1 - END_SHARE))
        mass = (1 - END_SHARE) * (1 - byte)
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        start = 0.0
        for i, share in zip(usable, ranked.tolist()):
            piece, p = vocabulary.pieces[i], share * mass
            self.automaton.add_word(piece, (i, len(piece), math.log(p)))
            start += p if piece.startswith(SPACE) else 0.0
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        #: Every word begins with a piece that starts with a blank, so a new piece is one of those, or the end.
        self.end = math.log(END_SHARE / (END_SHARE + start))

    def _arcs(self, word: str) -> list[list[tuple[int, float, int, int]]]:
        """For each place the pieces that end there: start, log probability, id (-1 for bytes), number of draws."""
        chunk = SPACE + word.replace(SPACE, "")
        arcs: list[list[tuple[int, float, int, int]]] = [[] for _ in range(len(chunk) + 1)]
        for end, (piece, length, log_p) in self.automaton.iter(chunk):
            arcs[end + 1].append((end + 1 - length, log_p, piece, 1))
        if not self.single.issuperset(chunk):
            for p, c in enumerate(chunk):
                if c not in self.single:
                    arcs[p + 1].append((p, len(c.encode()) * self.byte, -1, len(c.encode())))
        return arcs

    @staticmethod
    def _forward(arcs: list[list[tuple[int, float, int, int]]]) -> list[float]:
        forward = [0.0] + [-math.inf] * (len(arcs) - 1)
        for at in range(1, len(arcs)):
            terms = [forward[arc[0]] + arc[1] for arc in arcs[at]]
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                forward[at] = top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))
        return forward

    def word(self, word: str) -> float:
        """Natural log of the marginal probability of a word, by the forward recursion in log space."""
        return self._forward(self._arcs(word))[-1]

    def expect(self, word: str, into: np.ndarray) -> None:
        """Adds how often each piece is expected in a segmentation of the word."""
        arcs = self._arcs(word)
        forward = self._forward(arcs)
        backward = [-math.inf] * (len(arcs) - 1) + [0.0]
        for at in range(len(arcs) - 1, 0, -1):
            after = backward[at]
            if after == -math.inf:
                continue
            for start, log_p, piece, draws in arcs[at]:
                through = log_p + after
                into[piece] += draws * math.exp(min(forward[start] + through - forward[-1], 0.0))
                low, high = (through, backward[start]) if through < backward[start] else (backward[start], through)
                backward[start] = high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _expected_pieces(words: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Expected number of each piece over all different training words, the sample that new words resemble most."""
    size = len(vocabulary.pieces) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, into = Lattice(vocabulary), np.zeros(size)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                lattice.expect(word, into)
        used = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(into[used])], ["piece", "times"])

    found = words.select("word").mapInArrow(run, "piece long, times double").groupBy("piece").agg(F.sum("times").alias("times")).toPandas()
    out = np.zeros(size)
    out[found["piece"].to_numpy(dtype=np.int64)] = found["times"].to_numpy()
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers, by eight steps up and Stirling's series."""
    y = x + 8.0
    steps = np.ones_like(x)
    for i in range(8):
        steps = steps * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def _rising(log_base: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log of base * (base + 1) * ... , as many factors as ``times``; the base comes as a log, as it may be too small
    for a number."""
    out = log_base.copy()
    more = times > 1
    base = np.exp(log_base[more])
    out[more] += _lgamma(base + times[more]) - _lgamma(base + 1.0)
    return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``c`` over all texts; a task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for lo, hi in packs(texts, 8 * PACK_BYTES):
                counts = Counter(b"\n".join(texts[lo:hi]).lower().split())
                words, times = list(counts), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                for part in range(0, len(words), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words[part : part + 100_000], type=pa.binary()).cast(pa.string()), pa.array(times[part : part + 100_000])], ["word", "c"]
                    )

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _with_lattice(counts: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, weights)
        for batch in batches:
            words = batch.column("word").to_pylist()
            hashes = Words([w.encode() for w in words]).hashes()
            logs = np.array([lattice.word(w) for w in words], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(hashes.view(np.int64)), pa.array(logs)], ["word", "c", "h", "lat"])

    return counts.mapInArrow(run, "word string, c long, h long, lat double")


class _Prior:
    """Probability of a token before a document is read: discounted counts, and what they give up by the lattice."""

    def __init__(self, tokens: int, types: int, once: int, twice: int):
        self.tokens, self.types = tokens, types
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.given = self.discount * types / tokens if tokens else 1.0
        self.base = tokens + 0.5 * (types + 1)

    def log_p(self, counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        own = np.maximum(counts - self.discount, 0.0) / max(self.tokens, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(own), math.log(self.given) + logs)


def lattice_scores(
    docs: DataFrame,
    vocabulary: Vocabulary,
    held_out: Callable[[Column], Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_frequent: int = MAX_FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score`` (log10 probability of the text).

    Tokens are lower-case words cut at blanks and one end. A token's prior is its discounted count in the documents
    that are not held out, plus what the discount frees times its lattice probability, whose weights are the pieces
    that the vocabulary's scores let expect in the words of those documents. The document's probability is
    marginal over the segmentations and over the document's own word distribution, which varies around the prior with
    a concentration (a Dirichlet compound): words that a text has used come back. The concentration is the one of
    ``CONCENTRATIONS`` under which all training documents, each left out of the counts, are likeliest.

    Counts of at most ``max_frequent`` words are broadcast. Of the others a document sends each different word once to
    the join with the counts, where words without one are given their lattice probability. A null id is held out
    and learned from by no one; a null text has no words.
    """
    session = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    train = source.where(~F.col("held_out"))
    counts = materialise(_word_counts(train))
    weights = _expected_pieces(counts, vocabulary)
    counts = materialise(_with_lattice(counts, vocabulary, weights))
    ends = train.select("held_out").count()
    by_count = counts.groupBy("c").agg(F.count("*").alias("n"))
    sums = by_count.agg(
        F.sum(F.col("c") * F.col("n")).alias("tokens"), F.sum("n").alias("types"),
        F.sum(F.when(F.col("c") == 1, F.col("n"))).alias("once"), F.sum(F.when(F.col("c") == 2, F.col("n"))).alias("twice"),
    ).first()
    prior = _Prior((sums["tokens"] or 0) + ends, (sums["types"] or 0) + (ends > 0), sums["once"] or 0, sums["twice"] or 0)
    # Counts that so few words have that all of them can be broadcast: a list as long as there are different counts.
    least, left = 1 << 62, max_frequent
    for row in sorted(by_count.collect(), reverse=True):
        if row["n"] > left:
            break
        least, left = row["c"], left - row["n"]
    often = counts.where(F.col("c") >= least).select("h", "c", "lat").toPandas().sort_values("h", key=lambda h: h.astype("uint64"))
    end_log = Lattice(vocabulary, weights).end
    shared = send_by_value(
        session,
        (often["h"].to_numpy().astype(np.int64).view(np.uint64), often["c"].to_numpy(dtype=np.float64), often["lat"].to_numpy(dtype=np.float64), prior, ends, end_log),
    )
    scanned = source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _scan(shared), f"row long, id {source.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, "
        "fits array<double>, others array<double>, rare array<struct<word:string,times:int>>"
    )
    scanned = materialise(scanned)
    size = F.col("n_tokens").cast("double")
    total = scanned.where(~F.col("held_out")).select(F.posexplode("others").alias("g", "fit"), size.alias("n"))
    best = total.groupBy("g").agg(F.sum("fit").alias("fit")).orderBy(F.col("fit").desc(), "g").limit(1).collect()
    choice = best[0]["g"] if best else 3
    alpha = CONCENTRATIONS[choice]
    rare = scanned.select("row", F.inline("rare")).join(counts.where(F.col("c") < least).select("word", "c", "lat"), "word", "left")
    summed = rare.mapInArrow(_rare(vocabulary, weights, prior, alpha), "row long, logs double, base double, known long").groupBy("row")
    summed = summed.agg(*[F.sum(c).alias(f"r_{c}") for c in ("logs", "base", "known")])
    zero = lambda c: F.coalesce(c, F.lit(0))
    log_score = F.get("fits", F.lit(choice)) + zero("r_logs")
    return scanned.drop("others").join(summed, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + zero("r_known")).alias("n_known"),
        F.lit(prior.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("r_base")).alias("base_score"),
        (log_score / math.log(10)).alias("score"),
    )


def _scan(shared):
    """For each text what its end and its frequent words add to the scores under each concentration, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, lattice, prior, ends, end_log = shared()
        end_p = prior.log_p(np.array([float(ends)]), np.array([end_log]))
        end_less = prior.log_p(np.array([ends - 1.0]), np.array([end_log]))
        end_base = math.log10((ends + 0.5) / prior.base)
        for batch in batches:
            texts = [t.lower() for t in raw_texts(batch.column("text"))]
            for lo, hi in packs(texts, PACK_BYTES):
                words = Words(texts[lo:hi])
                owner, own = words.owners(), words.hashes()
                order = np.lexsort((own, owner))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (owner[order][1:] != owner[order][:-1]) | (own[order][1:] != own[order][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(order)))
                sample, of = order[first], owner[order[first]]
                at = np.minimum(np.searchsorted(hashes, own[sample]), max(len(hashes) - 1, 0))
                found = (hashes[at] == own[sample]) if len(hashes) else np.zeros(len(sample), dtype=bool)
                at, tf, doc = at[found], times[found].astype(np.float64), of[found]
                docs = hi - lo
                n_tokens = np.diff(words.bounds) + 1
                p = prior.log_p(counts[at], lattice[at])
                less = prior.log_p(np.maximum(counts[at] - tf, 0.0), lattice[at])
                n_rare = np.bincount(of[~found], minlength=docs)
                fits, others = np.empty((docs, len(CONCENTRATIONS))), np.empty((docs, len(CONCENTRATIONS)))
                for g, alpha in enumerate(CONCENTRATIONS):
                    size = _lgamma(alpha + n_tokens) - _lgamma(np.full(docs, alpha)) - n_rare * math.log(alpha)
                    fits[:, g] = np.bincount(doc, _rising(math.log(alpha) + p, tf), docs) + math.log(alpha) + end_p[0] - size
                    others[:, g] = np.bincount(doc, _rising(math.log(alpha) + less, tf), docs) + math.log(alpha) + end_less[0] - size
                base = np.bincount(doc, tf * np.log10((counts[at] + 0.5) / prior.base), docs) + end_base
                known = np.bincount(doc, tf, docs).astype(np.int64) + (ends > 0)
                rare = sample[~found]
                names = pa.array([words.data[s:e] for s, e in zip(words.starts[rare].tolist(), words.ends[rare].tolist())], type=pa.binary())
                cuts = np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([names.cast(pa.string()), pa.array(times[~found].astype(np.int32))], ["word", "times"])
                width = np.arange(docs + 1, dtype=np.int32) * len(CONCENTRATIONS)
                lists = [pa.ListArray.from_arrays(pa.array(width), pa.array(x.ravel())) for x in (fits, others)]
                part = batch.slice(lo, docs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), part.column("held_out"), pa.array(n_tokens.astype(np.int64)), pa.array(known), pa.array(base),
                     *lists, pa.ListArray.from_arrays(pa.array(cuts), pairs)],
                    ["row", "id", "held_out", "n_tokens", "known", "base", "fits", "others", "rare"],
                )

    return run


def _rare(vocabulary: Vocabulary, weights: np.ndarray, prior: _Prior, alpha: float):
    """What each rare word of a text adds under the chosen concentration, whose logarithm the scan has added already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary, weights)
        last: tuple[str, float] = ("", 0.0)
        for batch in batches:
            counts = np.nan_to_num(batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64))
            logs = batch.column("lat").to_numpy(zero_copy_only=False).astype(np.float64)
            for i in np.flatnonzero(np.isnan(logs)).tolist():
                word = batch.column("word")[i].as_py()
                if word != last[0]:
                    last = (word, lattice.word(word))
                logs[i] = last[1]
            times = batch.column("times").to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(_rising(math.log(alpha) + prior.log_p(counts, logs), times) - math.log(alpha)),
                    pa.array(times * np.log10((counts + 0.5) / prior.base)), pa.array(np.where(counts > 0, times, 0).astype(np.int64)),
                ],
                ["row", "logs", "base", "known"],
            )

    return run
