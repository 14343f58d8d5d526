"""Toxicity by two Kneser-Ney models, of toxic and of ordinary texts, that back off to counts they share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.llm.texts import Words, packs, raw_texts, send_by_value
from twinlink.session import materialise

#: Labelled documents of each class that the models are made of, and bytes of text tokenised at once.
MAX_ROWS = 2500
PACK_BYTES = 1 << 21
#: Absolute discount of Kneser-Ney smoothing.
DISCOUNT = 0.75
#: A fifth of the sample is held back from the counts and sets the score's scale.
FOLDS = 5
#: A word is spelled by its beginnings of these lengths in bytes, each the context of the next, then as a whole.
STEPS = (2, 3, 4, 5, 6, 7, 8, 10)
#: A word speaks for a class if the class makes it e to this power likelier; weaker evidence is noise in a long text.
EVIDENCE = 3.0


def _spelling(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step which words take it, with the hashes of the unit and of its context (0 for none)."""
    out, context = [], np.zeros(len(words), dtype=np.uint64)
    for longer, unit in words.prefix_hashes(STEPS):
        out.append((longer, unit, context))
        context = np.where(longer, unit, context)
    return [*out, (np.ones(len(words), dtype=bool), words.hashes(), context)]


@dataclass
class Model:
    """For each unit that the sample has, by sorted hash: the log ratio of toxic to ordinary probability of the
    beginnings up to it, and the same if an unknown unit follows it."""

    units: np.ndarray
    known: np.ndarray
    novel: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def ratios(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean over its words of log P(word | toxic) - log P(word | ordinary); 0 without words."""
        words = Words(texts)
        if not len(words) or not len(self.units):
            return np.zeros(len(texts))
        value = np.zeros(len(words))
        open_ = np.arange(len(words))
        for k, (takes, unit, _) in enumerate(reversed(_spelling(words))):
            asked = open_[takes[open_]]
            at = np.minimum(np.searchsorted(self.units, unit[asked]), len(self.units) - 1)
            found = self.units[at] == unit[asked]
            value[asked[found]] = (self.known if k == 0 else self.novel)[at[found]]
            rest = np.zeros(len(words), dtype=bool)
            rest[open_] = True
            rest[asked[found]] = False
            open_ = np.flatnonzero(rest)
        sums = np.concatenate([[0.0], np.cumsum(value)])
        return (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / np.maximum(np.diff(words.bounds), 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.ratios(texts) + self.offset, -60, 60)))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """A model of ``labelled`` (labels 0 and 1, other rows are left out), from at most ``max_rows`` rows of each class.

    The sample are the rows with the smallest hash of their id. Four fifths of it are counted; the rest, weighted by
    how often each class is among all labelled rows, sets slope and offset of the score. With a class missing the
    score says how often the other one is.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text")
    )
    return _fit(rows.select("id", "label"), lambda chosen: rows.join(chosen, ["id", "label"], "left_semi"), max_rows)


def _fit(marks: DataFrame, texts_of: Callable[[DataFrame], DataFrame], max_rows: int) -> Model:
    """``marks`` are the ``(id, label)`` of the labelled rows; ``texts_of`` gives ``(id, label, text)`` of the chosen ones."""
    ids = marks.where("id is not null")
    sizes = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return _empty(np.log(share / (1 - share)))
    order = F.xxhash64("id")
    chosen = ids.where("label = 0").orderBy(order, "id").limit(max_rows).union(ids.where("label = 1").orderBy(order, "id").limit(max_rows))
    # At most twice max_rows ids go to the tasks that read the texts, so no other text is shuffled.
    sample = texts_of(F.broadcast(chosen.distinct()))
    sample = materialise(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(FOLDS))))
    model = _counted(sample.where("fold != 0"))
    held = sample.where("fold = 0").select("label", "text").mapInArrow(_ratios(model), "label int, ratio double").toPandas()
    labels = held["label"].to_numpy()
    total = sizes[0] + sizes[1]
    weights = np.array([sizes[c] / total / max((labels == c).sum(), 1) for c in (0, 1)])[labels] * len(labels) if len(labels) else np.empty(0)
    model.slope, model.offset = _logistic(held["ratio"].to_numpy(), labels, weights, sizes[1] / total)
    return model


def _empty(offset: float) -> Model:
    return Model(np.empty(0, dtype=np.uint64), np.empty(0), np.empty(0), 1.0, float(offset))


def _counted(sample: DataFrame) -> Model:
    """Kneser-Ney counts, the number of documents of each class with a unit, summed by Spark; bounded by the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.asarray(batch.column("label").to_pylist(), dtype=np.int32)
            texts = [t.lower() for t in raw_texts(batch.column("text"))]
            for lo, hi in packs(texts, PACK_BYTES):
                words = Words(texts[lo:hi])
                owner = words.owners()
                for k, (takes, unit, context) in enumerate(_spelling(words)):
                    frame = pd.DataFrame({"u": unit[takes].view(np.int64), "p": context[takes].view(np.int64), "d": owner[takes]}).drop_duplicates()
                    frame["c"] = labels[lo:hi][frame["d"]]
                    grouped = frame.groupby(["u", "p", "c"]).size().reset_index(name="n")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(grouped["u"].astype("int64")), pa.array(grouped["p"].astype("int64")), pa.array(np.full(len(grouped), k, dtype=np.int32)),
                            pa.array(grouped["c"].astype("int32")), pa.array(grouped["n"].astype("int64")),
                        ],
                        ["u", "p", "k", "c", "n"],
                    )

    counts = sample.select("label", "text").mapInArrow(count, "u long, p long, k int, c int, n long").groupBy("u")
    counts = counts.agg(
        F.min("p").alias("p"), F.min("k").alias("k"), *[F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    )
    counts = materialise(counts)
    # What follows a unit: documents and different next units of each class, and different ones at all.
    after = counts.groupBy(F.col("p").alias("u")).agg(
        *[F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)], *[F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}") for c in (0, 1)], F.count("*").alias("kinds")
    )
    after = materialise(after)
    root = after.where("u = 0").first()
    if root is None:
        return _empty(0.0)
    # A unit of one document tells as much as an unknown one; its context has at least its documents and stays.
    often = counts.where(F.col("n0") + F.col("n1") > 1).join(after, "u", "left").na.fill(0)
    return _model(often.select("u", "p", "k", "n0", "n1", *AFTER).toPandas(), [float(root[c]) for c in AFTER])


AFTER = ("total0", "total1", "kinds0", "kinds1", "kinds")


def _model(rows: pd.DataFrame, root: list[float]) -> Model:
    """Walks down the spellings: P(unit | context) of a class discounts its counts and gives what it takes away to the
    distribution that both classes share, so a unit that is rare in both says little."""
    units = rows["u"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(units)
    units, context, step = units[order], rows["p"].to_numpy(dtype=np.int64).view(np.uint64)[order], rows["k"].to_numpy()[order]
    counts = [rows[f"n{c}"].to_numpy(dtype=np.float64)[order] for c in (0, 1)]
    after = {c: np.append(rows[c].to_numpy(dtype=np.float64)[order], top) for c, top in zip(AFTER, root)}
    del rows
    top = context == 0
    parent = np.where(top, len(units), np.minimum(np.searchsorted(units, context), max(len(units) - 1, 0)))
    both = np.maximum(after["total0"] + after["total1"], 1.0)
    shared = (counts[0] + counts[1] - DISCOUNT + DISCOUNT * after["kinds"][parent] / (after["kinds"][parent] + 1.0)) / both[parent]
    gain, left = np.zeros(len(units)), np.zeros(len(units) + 1)
    for c, sign in ((0, -1.0), (1, 1.0)):
        total = after[f"total{c}"]
        weight = np.where(total > 0, DISCOUNT * after[f"kinds{c}"] / np.maximum(total, 1.0), 1.0)
        own = np.maximum(counts[c] - DISCOUNT, 0) / np.maximum(total[parent], 1.0)
        gain += sign * np.log(own + weight[parent] * shared)
        left += sign * np.log(weight)
    known = np.zeros(len(units) + 1)
    for k in range(len(STEPS) + 1):
        own = np.flatnonzero(step == k)
        known[own] = gain[own] + np.where(top[own], 0.0, known[parent[own]])
    known, novel = known[:-1], known[:-1] + left[:-1]
    strong = lambda x: np.where(np.abs(x) < EVIDENCE, 0.0, x).astype(np.float32)
    return Model(units, strong(known), strong(novel))


def _ratios(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower() for t in raw_texts(batch.column("text"))]
            parts = [model.ratios(texts[lo:hi]) for lo, hi in packs(texts, PACK_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.concatenate([*parts, np.empty(0)]))], ["label", "ratio"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, share: float) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic regression on one number, by Newton steps with a little shrinkage."""
    slope, offset = 0.0, float(np.log(share / (1 - share)))
    if not len(x):
        return 1.0, offset
    scale = x.std() or 1.0
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
        g = np.array([(weights * (p - y) * z).sum() + 0.05 * slope, (weights * (p - y)).sum()])
        r = weights * p * (1 - p) + 1e-9
        h = np.array([[(r * z * z).sum() + 0.05, (r * z).sum()], [(r * z).sum(), r.sum()]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(slope), 0.0) / scale, float(offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row; a null text is scored as an empty one, by the classes' shares."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = send_by_value(docs.sparkSession, model)  # bounded by the sample it is made of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            texts = [t.lower() for t in raw_texts(batch.column("text"))]
            parts = [model.scores(texts[lo:hi]) for lo, hi in packs(texts, PACK_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate([*parts, np.empty(0)]))], ["id", "score"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def learn(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled documents whose id is not ``held_out`` (a function of the id column).

    The sample is chosen from the ids alone. An id with several documents or with both labels counts with each of them.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    marks = marks.where(~held_out(F.col("id")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _fit(rows.select("id").join(marks, "id"), lambda chosen: rows.join(chosen, "id").select("id", "label", "text"), MAX_ROWS)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores below ``threshold``; nothing is shuffled."""
    shared = send_by_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            texts = [t.lower() for t in raw_texts(batch.column(text_col))]
            parts = [model.scores(texts[lo:hi]) for lo, hi in packs(texts, PACK_BYTES)]
            yield batch.filter(pa.array(np.concatenate([*parts, np.empty(0)]) < threshold))

    return docs.mapInArrow(run, docs.schema)
