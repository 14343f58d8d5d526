"""Words of texts: column expressions for the JVM, and numpy helpers for the tasks that need whole-text hashing."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_SOLID = np.ones(256, dtype=bool)
_SOLID[list(BLANKS)] = False


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII takes the faster of the two equal ways."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null reads as an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packs(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of several texts, found and hashed in one buffer without a Python object per word."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        buffer = np.frombuffer(self.data, dtype=np.uint8)
        solid = np.diff(_SOLID[buffer].view(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(solid == 1), np.flatnonzero(solid == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        #: Word numbers at which the texts begin, and the end of the last one.
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))

    def __len__(self) -> int:
        return len(self.starts)

    def owners(self) -> np.ndarray:
        """For each word, the place of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        """64 bits for each word: a sum of random numbers by byte and place, then mixed."""
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        return mix(np.add.reduceat(self._values(), self.starts - self.starts[0]))

    def prefix_hashes(self, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length which words are longer in bytes, and 64 bits for the beginning of that length of each."""
        if not len(self.starts):
            return [(np.empty(0, dtype=bool), np.empty(0, dtype=np.uint64)) for _ in lengths]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self._values(), dtype=np.uint64)])
        first = self.starts - self.starts[0]
        sizes, out = self.ends - self.starts, []
        for n in lengths:
            part = sums[first + np.minimum(n, sizes)] - sums[first]
            out.append((sizes > n, mix(part + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))))
        return out

    def _values(self) -> np.ndarray:
        """From the first word on, a random number for each byte and its place in its word; blanks are zero."""
        first = self.starts[0]
        longest = int((self.ends - self.starts).max())
        by_byte, by_place = _tables(longest)
        buffer = np.frombuffer(self.data, dtype=np.uint8)[first:]
        spans = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(first, len(self.data), dtype=np.int64) - np.repeat(self.starts, spans)
        values = by_byte[buffer]
        values *= by_place[np.minimum(place, longest, out=place)]
        return values


def _tables(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random numbers for each byte (blanks count nothing) and an odd one for each place in a word."""
    by_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by_byte[list(BLANKS)] = 0
    by_place = mix(np.arange(1, longest + 2, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return by_byte, by_place


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, each joined from two windows of half the length."""
    if length == 1:
        return mix(words)
    if len(words) < length:
        return np.empty(0, dtype=np.uint64)
    half = (length + 1) // 2
    parts = window_hashes(words, half)
    count = len(words) - length + 1
    return mix(parts[:count] * np.uint64(0x9FB21C651E98DF25) + parts[length - half : length - half + count] + np.uint64(length))


def send_by_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast that tasks can open without this package: its classes travel with it. ``value`` is of bounded size."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once with a number for each row, and the name of that column, which ``df`` does not have.

    Written out, since the numbers must stay the same where the frame is read again after an executor is lost.
    """
    name, taken = "row_key", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return materialise(df.select("*", F.monotonically_increasing_id().alias(name))), name
