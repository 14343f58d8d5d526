"""Fill-in-the-middle texts cut and joined as seekable zstandard frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.llm.texts import raw_texts

#: Bytes of text in a frame, and the most frame bytes in one record batch (a longer row is a batch of its own).
FRAME_BYTES = 1 << 16
BATCH_BYTES = 1 << 23
#: What stands before the prefix, the suffix and the middle.
MARKERS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: A frame holds whole units; ``first`` counts the units of the text before it.
FRAMES = "array<struct<first: long, units: long, data: binary>>"
_FRAME = pa.struct([("first", pa.int64()), ("units", pa.int64()), ("data", pa.binary())])


def _leads(raw: bytes) -> np.ndarray:
    """Which bytes begin a unit: those that begin a code point, and any that cannot go on with one as nothing or ASCII stands before."""
    data = np.frombuffer(raw, dtype=np.uint8)
    out = (data & 0xC0) != 0x80
    out[:1] = True
    out[1:] |= data[:-1] < 0x80
    return out


def _count(raw: bytes) -> int:
    return len(raw) if raw.isascii() else int(np.count_nonzero(_leads(raw)))


def _place(raw: bytes, unit: int) -> int:
    """The byte at which a unit begins, the end for the unit after the last."""
    if unit == 0 or raw.isascii():
        return unit
    starts = np.flatnonzero(_leads(raw))
    return int(starts[unit]) if unit < len(starts) else len(raw)


class Frames:
    """The frames of one text; ranges of units are read by opening only the frames that they touch."""

    def __init__(self, entries: Iterable[tuple[int, int, bytes]], codec: Codec):
        self.entries = list(entries)
        self.firsts = [first for first, _, _ in self.entries]
        self.total = self.entries[-1][0] + self.entries[-1][1] if self.entries else 0
        self.codec = codec

    def _touched(self, start: int, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
        """Of each frame with units in the range: its own first and last unit in it, its size and its data."""
        at = max(bisect_right(self.firsts, start) - 1, 0)
        while start < stop and at < len(self.entries) and self.firsts[at] < stop:
            first, units, data = self.entries[at]
            yield max(start - first, 0), min(stop - first, units), units, data
            at += 1

    def read(self, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """The text of a range, a frame at a time."""
        for lo, hi, units, data in self._touched(start, self.total if stop is None else stop):
            raw = self.codec.open(data)
            yield raw if hi - lo == units else raw[_place(raw, lo) : _place(raw, hi)]

    def copy(self, start: int, stop: int, out: Writer) -> None:
        """Append a range to ``out``: whole frames as they are, the cut ones opened."""
        for lo, hi, units, data in self._touched(start, stop):
            if hi - lo == units and units >= out.copied:
                out.frame(units, data)
            else:
                raw = self.codec.open(data)
                out.text(raw[_place(raw, lo) : _place(raw, hi)])

    def find(self, marker: bytes, start: int) -> int:
        """The unit at which ``marker`` first stands from ``start`` on."""
        at, held = start, []
        for raw in self.read(start):
            held.append((at, raw))
            at += _count(raw)
            found = b"".join(raw for _, raw in held).find(marker)
            if found >= 0:
                for first, raw in held:
                    if found < len(raw):
                        return first + _count(raw[:found])
                    found -= len(raw)
            # Of the frames behind, those stay in which a marker may have begun.
            while held and sum(len(raw) for _, raw in held[1:]) >= len(marker) - 1:
                held.pop(0)
        raise ValueError(f"no {marker!r} in the output")


class Writer:
    """Collects frames in order; texts in between are compressed once they fill a frame or a whole frame follows."""

    #: A frame of fewer units is joined with its neighbours instead of being copied.
    copied = 1024

    def __init__(self, codec: Codec):
        self.codec, self.entries, self.total, self.buffer = codec, [], 0, bytearray()

    def text(self, raw: bytes) -> None:
        self.buffer += raw
        while len(self.buffer) >= FRAME_BYTES + 4:
            end = FRAME_BYTES
            while end < FRAME_BYTES + 4 and self.buffer[end] & 0xC0 == 0x80:
                end += 1
            self._close(bytes(self.buffer[:end]))
            del self.buffer[:end]

    def frame(self, units: int, data: bytes) -> None:
        self._close(bytes(self.buffer))
        self.buffer.clear()
        self.entries.append((self.total, units, data))
        self.total += units

    def _close(self, raw: bytes) -> None:
        if raw:
            units = _count(raw)
            self.entries.append((self.total, units, self.codec.pack(raw)))
            self.total += units

    def frames(self) -> Frames:
        self._close(bytes(self.buffer))
        self.buffer.clear()
        return Frames(self.entries, self.codec)


class Codec:
    def __init__(self):
        self.pack, self.open = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress


def choose(key: str, units: int, marked: bool, plain_from: int = 90, spm_below: int = 20) -> tuple[str, int, int]:
    """The form of a text and the units at which its middle begins and ends, all from a hash of its id."""
    digest = hashlib.sha256(b"1:" + key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if units == 0 or marked or h3 % 100 >= plain_from:
        return PLAIN, 0, 0
    a, b = h1 % (units + 1), h2 % (units + 1)
    return (SPM if h4 % 100 < spm_below else PSM), min(a, b), max(a, b)


def _batches(rows: Iterator[tuple[tuple, Frames]], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Record batches of rows of plain values with their frames in a last column."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        entries = [e for _, frames in held for e in frames.entries]
        columns = [pa.array([e[k] for e in entries], type=_FRAME[k].type) for k in range(3)]
        offsets = np.concatenate([[0], np.cumsum([len(frames.entries) for _, frames in held])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_FRAME)))
        plain = [pa.array([values[k] for values, _ in held], type=f.type) for k, f in enumerate(fields)]
        return pa.RecordBatch.from_arrays([*plain, lists], [*(f.name for f in fields), "frames"])

    for values, frames in rows:
        held.append((values, frames))
        size += sum(len(data) for _, _, data in frames.entries) + 100
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows_frames(column: pa.Array, codec: Codec) -> Iterator[Frames]:
    for entries in column:
        yield Frames(((e["first"], e["units"], e["data"]) for e in entries.as_py() or ()), codec)


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markers: tuple[bytes, ...] = MARKERS) -> DataFrame:
    """Every row's whole text as ``frames``, with its ``units`` (code points) and whether it is ``marked`` by a marker.

    A null or empty text has no frames. Bytes that are no UTF-8 stay as they are and belong to the unit before them,
    or are one if nothing or ASCII stands before.
    Null and repeated ids give a row each; other columns are left out. A text is cut into frames one at a time, so
    beside the row itself a task holds one frame.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:

            def rows() -> Iterator[tuple[tuple, Frames]]:
                for at, raw in enumerate(raw_texts(batch.column("text"))):
                    out = Writer(codec)
                    for start in range(0, len(raw), FRAME_BYTES):
                        out.text(raw[start : start + FRAME_BYTES])
                    frames = out.frames()
                    yield (batch.column("id")[at].as_py(), frames.total, any(m in raw for m in markers)), frames

            yield from _batches(rows(), [pa.field("id", batch.schema.field("id").type), pa.field("units", pa.int64()), pa.field("marked", pa.bool_())])

    return source.mapInArrow(run, f"id {kind}, units long, marked boolean, frames {FRAMES}").withColumnRenamed("id", id_col)


def fill_in_middle(stored: DataFrame, id_col: str = "doc_id", markers: tuple[bytes, bytes, bytes] = MARKERS, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Stored texts as outputs in ``frames``, with ``units`` of the text, ``form``, ``prefix_chars`` and ``middle_chars``.

    Form and cuts follow from a hash of the id (``choose``); a null id is hashed as an empty one. Only the frames in
    which a cut falls are opened; all others go into the output as they are. An unmarked text cannot hold a marker,
    nor can one arise where a part meets a marker, so ``restore`` is exact.
    """
    source = stored.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), "units", "marked", "frames")
    kind = source.schema["id"].dataType.simpleString()
    before_prefix, before_suffix, before_middle = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:

            def rows() -> Iterator[tuple[tuple, Frames]]:
                columns = zip(batch.column("id"), batch.column("key").to_pylist(), batch.column("units").to_pylist(), batch.column("marked").to_pylist())
                for (id_, key, units, marked), text in zip(columns, _rows_frames(batch.column("frames"), codec)):
                    form, a, b = choose(key, units, marked, plain_from, spm_below)
                    if form == PLAIN:
                        yield (id_.as_py(), units, form, None, None), text
                        continue
                    prefix, suffix = (before_prefix, 0, a), (before_suffix, b, units)
                    out = Writer(codec)
                    for marker, start, stop in (*((suffix, prefix) if form == SPM else (prefix, suffix)), (before_middle, a, b)):
                        out.text(marker)
                        text.copy(start, stop, out)
                    yield (id_.as_py(), units, form, a, b - a), out.frames()

            fields = [("units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
            yield from _batches(rows(), [pa.field("id", batch.schema.field("id").type), *(pa.field(*f) for f in fields)])

    schema = f"id {kind}, units long, form string, prefix_chars long, middle_chars long, frames {FRAMES}"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _parts(output: Frames, form: str, markers: tuple[bytes, bytes, bytes]) -> list[tuple[int, int]]:
    """The ranges of an output that make up the text, in its order; found by the markers and the form alone."""
    if form == PLAIN:
        return [(0, output.total)]
    order = (1, 0, 2) if form == SPM else (0, 1, 2)
    starts, at = [], 0
    for k in order:
        at = output.find(markers[k], at)
        starts.append((at, at + len(markers[k])))
        at += len(markers[k])
    ends = [starts[1][0], starts[2][0], output.total]
    part = {k: (starts[n][1], ends[n]) for n, k in enumerate(order)}
    return [part[0], part[2], part[1]]


def restore(outputs: DataFrame, id_col: str = "doc_id", markers: tuple[bytes, bytes, bytes] = MARKERS) -> DataFrame:
    """``id_col`` and the texts as ``frames`` again, from the outputs and their forms."""
    source = outputs.select(F.col(id_col).alias("id"), "form", "frames")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:

            def rows() -> Iterator[tuple[tuple, Frames]]:
                for id_, form, output in zip(batch.column("id"), batch.column("form").to_pylist(), _rows_frames(batch.column("frames"), codec)):
                    out = Writer(codec)
                    for start, stop in _parts(output, form, markers):
                        output.copy(start, stop, out)
                    yield (id_.as_py(),), out.frames()

            yield from _batches(rows(), [pa.field("id", batch.schema.field("id").type)])

    return source.mapInArrow(run, f"id {kind}, frames {FRAMES}").withColumnRenamed("id", id_col)


def texts(framed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` of rows of frames."""
    source = framed.select(F.col(id_col).alias("id"), "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            for at, frames in enumerate(_rows_frames(batch.column("frames"), codec)):
                text = pa.array([b"".join(frames.read())], type=pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 1), text], ["id", "text"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def digests(outputs: DataFrame, id_col: str = "doc_id", markers: tuple[bytes, bytes, bytes] = MARKERS) -> DataFrame:
    """The outputs with ``output_sha256`` and ``restored_sha256`` (lowercase hex) in place of their frames.

    Both are fed one opened frame after the other: the output in its own order, the restored text in the order of the
    ranges that the markers and the form give.
    """
    others = [c for c in outputs.columns if c != "frames"]
    kinds = ", ".join(f"`{c}` {outputs.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            made, back = [], []
            for form, output in zip(batch.column("form").to_pylist(), _rows_frames(batch.column("frames"), codec)):
                made.append(_digest(output, [(0, output.total)]))
                back.append(_digest(output, _parts(output, form, markers)))
            columns = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.string()), pa.array(back, pa.string())], [*others, "output_sha256", "restored_sha256"])

    return outputs.mapInArrow(run, f"{kinds}, output_sha256 string, restored_sha256 string")


def _digest(frames: Frames, ranges: list[tuple[int, int]]) -> str:
    digest = hashlib.sha256()
    for start, stop in ranges:
        for raw in frames.read(start, stop):
            digest.update(raw)
    return digest.hexdigest()
