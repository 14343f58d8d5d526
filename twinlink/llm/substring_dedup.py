"""Removal of word sequences that an earlier document holds as well, found by doubling the length of repeated windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.llm.texts import Words, mix, packs, raw_texts, window_hashes
from twinlink.session import materialise

#: Text bytes in a block, the unit in which hashes travel, and in a bucket, the unit in which they are compared.
BLOCK_BYTES = 1 << 21
BUCKET_BYTES = 1 << 24
#: The first level compares this many bits; what agrees by chance falls at the next, which compares 64.
SCREEN_BITS = 48

BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("nulls", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("body", pa.binary())])


def repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, max_words: int | None = None
) -> DataFrame:
    """What is left of each document without the windows that also start in a document with a smaller id.

    Every row gives ``id_col`` (long), ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and
    ``longest`` (the longest level, ``min_words`` times a power of two, at which one of its windows starts in a
    document with a smaller id; 0 if none). Words are cut at blanks and taken as they are. All windows of ``min_words``
    words are judged on the input. Null texts have no words. Rows with a null id are no earlier document and keep all
    words; rows with the same id are not earlier than each other. ``max_words`` ends the doubling at a length, where
    only the removal is of interest; without it the levels go on until no window is repeated.

    The first level looks at half the length. Of the half windows inside a full one the one with the least hash stands
    for it: equal windows choose the same one, so only a quarter of the positions is compared. A full window is a
    candidate if its half window is in two documents; a window of twice a length is one if both its halves are repeated.

    Texts travel once, as compressed blocks of about two megabytes. A level sends, for each block and each range of
    hashes, one sorted array in which a hash stands once however often the block has it; the answers go back to
    the block in the same order. So a passage that a third of all documents share adds one number per block.

    From the first full level on, a block keeps only the places and hashes of its repeated windows: a window of twice the
    length is hashed from its halves, so later levels read no text.
    """
    blocks = materialise(_blocks(docs, id_col, text_col))
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = int(max(1, -(-total // BUCKET_BYTES)))
    answers = materialise(_compare(_sent(blocks, None, min_words, 0, buckets), 0))
    found = materialise(_compare(_sent(blocks, answers, min_words, 1, buckets), 1))
    answers = answers.unionByName(found)
    level, length = 1, min_words
    state = None if found.isEmpty() else materialise(_repeated(blocks, answers, min_words))
    while state is not None and (max_words is None or 2 * length <= max_words):
        level, length = level + 1, 2 * length
        found = materialise(_compare(_doubled(state, length // 2, buckets), level))
        if found.isEmpty():
            break
        state = materialise(_still_repeated(state, found, length))
        answers = answers.unionByName(state.select("block", F.lit(level).alias("level"), F.lit(length).cast("long").alias("bucket"), F.col("late").alias("answer")))
    return _kept(blocks, answers, min_words).withColumnRenamed("id", id_col)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), raw_texts(batch.column("text"))
            for lo, hi in packs(texts, BLOCK_BYTES):
                body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts[lo:hi]))
                # A null among the ids would make pandas turn them into doubles.
                known = [0 if x is None else x for x in ids[lo:hi]]
                row = {"block": number, "ids": known, "nulls": [x is None for x in ids[lo:hi]], "sizes": [len(t) for t in texts[lo:hi]], "body": body}
                yield pa.RecordBatch.from_pylist([row], schema=BLOCK)
                number += 1

    return source.mapInArrow(run, "block long, ids array<long>, nulls array<boolean>, sizes array<int>, body binary")


class _Block:
    """The documents of a block, its words and the hashes of its windows."""

    def __init__(self, row, min_words: int):
        sizes, body = row["sizes"], row["body"]
        cuts = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).tolist()
        data = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(cuts[-1], 1))
        self.texts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        self.words, self.min_words = Words(self.texts), min_words
        bounds = self.words.bounds
        #: For each word, where its document ends.
        self.ends = np.repeat(bounds[1:], np.diff(bounds))
        #: For each document whether its id is null, and the id (zero for a null one).
        self.nulls = np.array(row["nulls"], dtype=bool)
        self.numbers = np.array(row["ids"], dtype=np.int64)
        self.owners = self.words.owners()
        self.half = (min_words + 1) // 2
        self.hashes = self.words.hashes()

    def inside(self, length: int) -> np.ndarray:
        """Which windows of a length end before their document does and belong to a document with an id."""
        count = max(0, len(self.ends) - length + 1)
        return (np.arange(length, length + count) <= self.ends[:count]) & ~self.nulls[self.owners[:count]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each full window that may be compared, its place and the place of its least half window."""
        places = np.flatnonzero(self.inside(self.min_words))
        if not len(places):
            return places, places
        halves = window_hashes(self.hashes, self.half)
        view = np.lib.stride_tricks.sliding_window_view(halves, self.min_words - self.half + 1)
        return places, places + view.argmin(axis=1)[places]

    def screen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted half-window hashes of the anchors, whether two documents here have each, and each anchor's rank."""
        places, at = self.anchors()
        short = window_hashes(self.hashes, self.half)[at] >> np.uint64(64 - SCREEN_BITS) if len(at) else at.astype(np.uint64)
        values, rank = np.unique(short, return_inverse=True)
        low, high = _extremes(rank, self.numbers[self.owners[places]], len(values))
        return values, low < high, rank

    def windows(self, length: int, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the candidate windows, the least and largest id here of each, and each candidate's rank."""
        hashes = window_hashes(self.hashes, length)
        values, rank = np.unique(hashes[candidates], return_inverse=True)
        low, high = _extremes(rank, self.numbers[self.owners[candidates]], len(values))
        return values, low, high, rank

    def candidates(self, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
        """The places of the full windows that the first level leaves."""
        places, _ = self.anchors()
        _, _, rank = self.screen()
        return places[_unpack_flags(answers.get(0), rank)]

    def repeated(self, answers: dict[int, dict[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the full windows in two documents, and the least id that has each."""
        candidates = self.candidates(answers)
        _, _, _, rank = self.windows(self.min_words, candidates)
        least = _unpack_least(answers.get(1), rank)
        return candidates[least != _NEVER], least[least != _NEVER]


_NEVER = np.iinfo(np.int64).max


def _extremes(rank: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(count, _NEVER), np.full(count, np.iinfo(np.int64).min)
    np.minimum.at(low, rank, ids)
    np.maximum.at(high, rank, ids)
    return low, high


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers byte place by byte place, as sorted ones compress best."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _numbers(blob: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), dtype=np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel()


def _pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _bits(blob: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=count).astype(bool)


def _unpack_flags(parts: dict[int, bytes] | None, rank: np.ndarray) -> np.ndarray:
    """The answers of level 0 for each anchor. Buckets are ranges of hashes, so their answers follow in order."""
    if not parts:
        return np.zeros(len(rank), dtype=bool)
    flags = np.concatenate([_bits(x[4:], int.from_bytes(x[:4], "little")) for _, x in sorted(parts.items())])
    return flags[rank]


def _unpack_least(parts: dict[int, bytes] | None, rank: np.ndarray) -> np.ndarray:
    if not parts:
        return np.full(len(rank), _NEVER)
    least = np.concatenate([_numbers(x, 8).view(np.int64) for _, x in sorted(parts.items())])
    return least[rank]


def _sent(blocks: DataFrame, answers: DataFrame | None, min_words: int, level: int, buckets: int) -> DataFrame:
    """For each block and bucket the sorted hashes of the candidates of level 0 or 1, with what the block knows of each."""

    def send(block: _Block, number: int, past: dict[int, dict[int, bytes]]) -> Iterator[tuple]:
        if level == 0:
            values, several, _ = block.screen()
            width = SCREEN_BITS // 8
            bucket = (values * np.uint64(buckets)) >> np.uint64(SCREEN_BITS) if buckets < 1 << 16 else (values >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(SCREEN_BITS - 16)
        else:
            values, low, high, _ = block.windows(min_words, block.candidates(past))
            yield from _ranges(number, values, low, high, buckets)
            return
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))), len(values)) if len(values) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            yield int(bucket[lo]), number, _planes(values[lo:hi], width), _pack_bits(several[lo:hi]), None

    columns, kind = SENT, SENT_KIND
    types = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in columns[2:])])
    if level == 0:

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    x = batch.slice(row, 1).to_pylist()[0]
                    rows = list(send(_Block(x, min_words), x["block"], {}))
                    yield pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows], schema=types)

        return blocks.mapInArrow(screen, kind)

    def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            x = left.iloc[0]
            rows = list(send(_Block(x, min_words), int(x["block"]), _past(right)))
        return pd.DataFrame(rows, columns=columns)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(extend, kind)


SENT = ["bucket", "block", "hashes", "known", "spread"]
SENT_KIND = "bucket long, block long, hashes binary, known binary, spread binary"


def _ranges(number: int, values: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A row of ``SENT`` for each range of the sorted hashes, with the least and largest id of each hash in the block."""
    bucket = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(values)] if len(values) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        known = _planes(low[lo:hi].view(np.uint64), 8)
        yield int(bucket[lo]), number, _planes(values[lo:hi], 8), known, _planes((high[lo:hi] - low[lo:hi]).view(np.uint64), 8)


#: The repeated windows of a block: place and hash of each and its document's number in the block, with the ids of the documents
#: that have one; and the numbers of those with a window that starts in an earlier document. Places and numbers rise, so
#: their steps are kept.
STATE = ["block", "places", "hashes", "docs", "ids", "late"]
STATE_KIND = "block long, places binary, hashes binary, docs binary, ids binary, late binary"


def _state_row(number: int, windows: tuple, least: np.ndarray) -> pd.DataFrame:
    """The windows that are repeated, as a row of ``STATE``; none if there is no such window."""
    again = least != _NEVER
    places, hashes, docs, ids = (x[again] for x in windows)
    if not len(places):
        return pd.DataFrame(columns=STATE)
    late = np.unique(docs[least[again] < ids])
    _, first = np.unique(docs, return_index=True)
    columns = (np.diff(places, prepend=0), hashes, np.diff(docs, prepend=0), ids[first], late)
    packed = [_planes(np.ascontiguousarray(x).view(np.uint64), 8) for x in columns]
    return pd.DataFrame([(number, *packed)], columns=STATE)


def _state(row) -> tuple:
    places, docs = (np.cumsum(_numbers(row[c], 8).view(np.int64)) for c in ("places", "docs"))
    _, of = np.unique(docs, return_inverse=True)
    return places, _numbers(row["hashes"], 8), docs, _numbers(row["ids"], 8).view(np.int64)[of]


def _repeated(blocks: DataFrame, answers: DataFrame, min_words: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=STATE)
        x = left.iloc[0]
        block = _Block(x, min_words)
        places, least = block.repeated(_past(right))
        hashes = window_hashes(block.hashes, min_words)[places] if len(places) else np.empty(0, dtype=np.uint64)
        docs = block.owners[places].astype(np.int64)
        return _state_row(int(x["block"]), (places.astype(np.int64), hashes, docs, block.numbers[docs]), least)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, STATE_KIND)


def _double(row, length: int) -> tuple:
    """The windows of twice a length whose halves are both repeated, in the form of ``_state``."""
    places, hashes, docs, ids = _state(row)
    at = np.minimum(np.searchsorted(places, places + length), len(places) - 1)
    both = (places[at] == places + length) & (docs[at] == docs)
    with np.errstate(over="ignore"):
        joined = mix(hashes[both] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[both]])
    return places[both], joined, docs[both], ids[both]


def _doubled(state: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                _, hashes, _, ids = _double(row, length)
                values, rank = np.unique(hashes, return_inverse=True)
                low, high = _extremes(rank, ids, len(values))
                yield pd.DataFrame(list(_ranges(int(row["block"]), values, low, high, buckets)), columns=SENT)

    return state.mapInPandas(run, SENT_KIND)


def _still_repeated(state: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=STATE)
        x = left.iloc[0]
        windows = _double(x, length // 2)
        _, rank = np.unique(windows[1], return_inverse=True)
        (parts,) = _past(right).values()
        return _state_row(int(x["block"]), windows, _unpack_least(parts, rank))

    return state.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, STATE_KIND)


def _past(answers: pd.DataFrame) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, bucket, answer in zip(answers["level"], answers["bucket"], answers["answer"]):
        out.setdefault(int(level), {})[int(bucket)] = answer
    return out


def _compare(sent: DataFrame, level: int) -> DataFrame:
    """The answers to each block: at level 0 whether another document has a hash, later the least id that has it.

    A block without a repeated hash in a bucket gets no answer there at level 0 if it sent none; at later levels
    buckets in which nothing is repeated still answer, so that ranks stay whole, unless nothing is repeated at all.
    """

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        width = SCREEN_BITS // 8 if level == 0 else 8
        values = [_numbers(x, width) for x in rows["hashes"]]
        sizes = [len(v) for v in values]
        cuts = np.cumsum(sizes)[:-1]
        _, rank, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        if level == 0:
            several = np.concatenate([_bits(k, n) for k, n in zip(rows["known"], sizes)])
            here = np.zeros(len(count), dtype=bool)
            np.logical_or.at(here, rank, several)
            parts = np.split((here | (count > 1))[rank], cuts)
            out = [len(p).to_bytes(4, "little") + _pack_bits(p) for p in parts]
        else:
            low = np.concatenate([_numbers(k, 8).view(np.int64) for k in rows["known"]])
            high = low + np.concatenate([_numbers(k, 8).view(np.int64) for k in rows["spread"]])
            first, last = np.full(len(count), _NEVER), np.full(len(count), np.iinfo(np.int64).min)
            np.minimum.at(first, rank, low)
            np.maximum.at(last, rank, high)
            parts = np.split(np.where(first < last, first, _NEVER)[rank], cuts)
            out = [_planes(p.view(np.uint64), 8) for p in parts]
        return pd.DataFrame({"block": rows["block"], "level": level, "bucket": rows["bucket"], "answer": out})

    return sent.groupBy("bucket").applyInPandas(answer, "block long, level int, bucket long, answer binary")


def _kept(blocks: DataFrame, answers: DataFrame, min_words: int) -> DataFrame:
    def keep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["id", "n_words", "n_removed", "kept_text", "longest"])
        x = left.iloc[0]
        block, past = _Block(x, min_words), _past(right)
        covered = np.zeros(len(block.words) + 1, dtype=np.int64)
        longest = np.zeros(len(block.texts), dtype=np.int64)
        places, least = block.repeated(past)
        earlier = places[least < block.numbers[block.owners[places]]] if len(places) else places
        np.add.at(covered, earlier, 1)
        np.add.at(covered, earlier + min_words, -1)
        longest[block.owners[earlier]] = min_words
        for level in sorted(k for k in past if k > 1):
            for length, late in past[level].items():
                longest[_numbers(late, 8).view(np.int64)] = length
        gone = np.cumsum(covered)[:-1] > 0
        bounds, rows = block.words.bounds.tolist(), []
        for i, text in enumerate(block.texts):
            words, out = text.split(), gone[bounds[i] : bounds[i + 1]]
            removed = int(out.sum())
            kept = words if not removed else [w for w, g in zip(words, out.tolist()) if not g]
            rows.append((len(words), removed, b" ".join(kept).decode(), int(longest[i])))
        frame = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text", "longest"])
        frame.insert(0, "id", pd.arrays.IntegerArray(block.numbers, block.nulls))
        return frame

    kind = "id long, n_words long, n_removed long, kept_text string, longest long"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(keep, kind)
