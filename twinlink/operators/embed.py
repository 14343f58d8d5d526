"""Record texts to vectors.

An encoder is any function from a list of texts to a 2-d array. It is made once per task by a factory, so that a
model is loaded where it is used, and sees texts in Arrow batches. An encoder without a model is included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.functions.text import instruct_prefix
from twinlink.operators.resume import resume_embeddings, resume_task_embeddings
from twinlink.schema import EMBEDDING_MODELS
from twinlink.session import materialise

Encoder = Callable[[Sequence[str]], np.ndarray]

# The task text, and the prefix one model always gets.
TASK = "Given a query, retrieve semantically similar text."
FIXED_TASKS = {"KiteFishAI/Nano-Em1-0.6B-v2.1": "Retrieve semantically similar text"}


def encode(texts: DataFrame, factory: Callable[[], Encoder], batch_rows: int = 256) -> DataFrame:
    """Replace ``text`` by ``embeddings`` and ``created_at``, the time at which the encoder gave the batch back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                encoder = encoder or factory()
                part = frame.iloc[at : at + batch_rows]
                vectors = np.asarray(encoder(part["text"].tolist()), dtype=np.float32)
                yield part.drop(columns="text").assign(embeddings=list(vectors), created_at=pd.Timestamp.now(tz="UTC"))

    keys = [f for f in texts.schema.fields if f.name != "text"]
    made = [T.StructField("embeddings", T.ArrayType(T.FloatType())), T.StructField("created_at", T.TimestampType())]
    return texts.select(*[f.name for f in keys], "text").mapInPandas(run, T.StructType(keys + made))


class _Places(dict):
    """Places of words by their hash; remembers up to a million of them."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        place = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % self.dim
        return place


def word_hash_encoder(dim: int = 32) -> Encoder:
    """Encoder without a model: word counts folded into ``dim`` places by a hash of the word."""
    places, words = _Places(dim), re.compile(r"\w+").findall

    def encode_texts(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            found = [places[w] for w in words((text or "").lower())]
            if found:
                out[row] = np.bincount(found, minlength=dim)
        return out

    return encode_texts


def hashed_words(texts: DataFrame) -> DataFrame:
    """The encoder without a model; a null text is an empty one.

    It stays in Python: the same counts from built-in functions took 17 s where this takes 4, as each word is hashed
    inside a lambda and each place is counted on its own.
    """
    return encode(texts, word_hash_encoder)


def _created(vectors: DataFrame) -> Column:
    """When an encoder made a vector; one that does not say gets the time of the query."""
    return F.col("created_at") if "created_at" in vectors.columns else F.current_timestamp()


def model_text(model: str, text: Column | str) -> Column:
    """The text as a model gets it: some models always have a task prefix."""
    if model in FIXED_TASKS:
        return instruct_prefix(FIXED_TASKS[model], text)
    return F.col(text) if isinstance(text, str) else text


def embed_records(
    records: DataFrame, dataset: str, model: str, to_vectors: Callable[[DataFrame], DataFrame], done: DataFrame | None = None
) -> DataFrame:
    """Rows for the embedding table, for records ``(record_id, text)`` that ``done`` does not hold yet."""
    todo = records if done is None else resume_embeddings(records, done, model, dataset)
    vectors = to_vectors(todo.select("record_id", model_text(model, "text").alias("text")))
    return vectors.select(
        F.col("record_id").cast("string").alias("record_id"),
        F.lit(dataset).alias("dataset"),
        "embeddings",
        _created(vectors).alias("created_at"),
        F.lit(model).alias("model"),
    )


def task_texts(pairs: DataFrame, d1_records: DataFrame, d2_records: DataFrame, task: str = TASK) -> DataFrame:
    """What is embedded, ``(is_d2, record_id, text)``: listed d1 records behind the task, and the listed candidates."""

    def listed(records: DataFrame, side: str, text: Column) -> DataFrame:
        ids = pairs.select(F.col(f"{side}_id").alias("record_id")).distinct()
        rows = records.join(ids, "record_id", "left_semi")
        return rows.select(F.lit(side == "d2").alias("is_d2"), "record_id", text.alias("text"))

    return listed(d1_records, "d1", instruct_prefix(task, "text")).unionByName(listed(d2_records, "d2", F.col("text")))


def embed_with_task(
    pairs: DataFrame,
    d1_records: DataFrame,
    d2_records: DataFrame,
    model: str,
    to_vectors: Callable[[DataFrame], DataFrame],
    done: DataFrame | None = None,
    task: str = TASK,
) -> DataFrame:
    """Rows for the task-embedding table; a d1 that ``done`` holds is skipped with all its candidates.

    A text is encoded once, in however many lists its record stands. Lists meet vectors only; no text is repeated for them.
    """
    todo = pairs if done is None else resume_task_embeddings(pairs, done, model)
    vectors = encode_distinct(task_texts(todo, d1_records, d2_records, task), to_vectors)
    d1 = vectors.filter(~F.col("is_d2")).withColumn("d1_reference_id", F.col("record_id"))
    lists = todo.select(F.col("d1_id").alias("d1_reference_id"), F.col("d2_id").alias("record_id"))
    vectors = d1.unionByName(lists.join(vectors.filter("is_d2"), "record_id"))
    return vectors.select(
        F.col("d1_reference_id").cast("string").alias("d1_reference_id"),
        F.col("record_id").cast("string").alias("record_id"),
        "is_d2",
        "embeddings",
        _created(vectors).alias("created_at"),
        F.lit(model).alias("model"),
    )


def encode_distinct(named: DataFrame, to_vectors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors in place of ``text``; equal texts are encoded once."""
    texts = named.select("text").distinct()
    # A table: an encoder is too dear to be run again for a lost task of the join.
    encoded = materialise(to_vectors(texts.select(F.col("text").alias("record_id"), "text")))
    return named.join(encoded.withColumnRenamed("record_id", "text"), "text").drop("text")


def loader_family(model: str) -> str:
    """How a model is loaded: by token model, by sentence model, or by its vendor's own library."""
    for _, name, family in EMBEDDING_MODELS:
        if name == model and family:
            return family
    raise ValueError(f"unsupported model: {model}")


def embed(
    d1_records: DataFrame,
    d2_records: DataFrame,
    pairs: DataFrame,
    model: str,
    encoders: dict[str, Callable[[DataFrame], DataFrame]],
    use_task: bool = False,
    done: DataFrame | None = None,
) -> DataFrame:
    """All missing vectors of one model, by the encoder registered for its loader family."""
    family = loader_family(model)
    if family not in encoders:
        raise ValueError(f"no encoder for loader family {family}")
    to_vectors = encoders[family]
    if use_task:
        return embed_with_task(pairs, d1_records, d2_records, model, to_vectors, done)
    return embed_records(d1_records, "d1", model, to_vectors, done).unionByName(
        embed_records(d2_records, "d2", model, to_vectors, done)
    )
