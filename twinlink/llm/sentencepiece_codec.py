"""SentencePiece encoding by one Viterbi pass over an Aho-Corasick automaton of the pieces, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Entries of a task's memory of encoded words, in each of its two generations.
REMEMBERED = 150_000


@dataclass
class Vocabulary:
    """Pieces, scores and byte pieces of a model with byte fallback and blanks written as U+2581."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_: list[int]  # id of the piece of each byte
    _tools: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tools": {}}

    def encoder(self) -> Encoder:
        return Encoder(self)


def load_vocabulary(model_file: str) -> Vocabulary:
    """The vocabulary of a model file, read on the driver; its size is the file's, whatever the documents."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], normal, byte_ids)


class Encoder:
    """Encodes and decodes texts. Words are remembered, since equal words have equal pieces wherever they stand."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        for i, (piece, score, normal) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal)):
            if normal and piece:
                self.automaton.add_word(piece, (i, len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} reaches over a blank, so words cannot be encoded one by one")
        self.automaton.make_automaton()
        self.unknown = min(s for s, n in zip(vocabulary.scores, vocabulary.normal) if n) - UNKNOWN_PENALTY
        self.byte_ids = vocabulary.bytes_
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.output = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(vocabulary.pieces, vocabulary.normal)]
        for b, i in enumerate(self.byte_ids):
            self.output[i] = bytes([b])

    def best(self, chunk: str) -> list[int]:
        """The best-scored pieces of ``chunk``: each match that the automaton reports at a place, longest first, is one
        relaxation of that place; a character without a piece of its own is also a step, spelled in bytes."""
        size = len(chunk)
        score, back = [0.0] + [-np.inf] * size, [None] * (size + 1)
        missing = [p for p in range(size) if chunk[p] not in self.single]
        nxt = 0
        for end, (piece, length, gain) in self.automaton.iter(chunk):
            while nxt < len(missing) and missing[nxt] <= end:
                self._relax_unknown(chunk, missing[nxt], score, back)
                nxt += 1
            total = score[end + 1 - length] + gain
            if total > score[end + 1]:
                score[end + 1], back[end + 1] = total, (piece, length)
        for p in missing[nxt:]:
            self._relax_unknown(chunk, p, score, back)
        out: list[int] = []
        at = size
        while at:
            piece, length = back[at]
            if piece is None:
                out.extend(self.byte_ids[b] for b in reversed(chunk[at - 1].encode()))
            else:
                out.append(piece)
            at -= length
        return out[::-1]

    def _relax_unknown(self, chunk: str, p: int, score: list[float], back: list) -> None:
        total = score[p] + self.unknown
        if total > score[p + 1]:
            score[p + 1], back[p + 1] = total, (None, 1)

    def _word(self, word: str) -> bytes:
        """Piece ids, as 32-bit numbers, of a word after one blank."""
        found = self.old.get(word)
        if found is None:
            found = np.array(self.best(SPACE + word.replace(" ", SPACE)), dtype=np.int32).tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text; an empty text has none. A blank is put in front; blanks become U+2581."""
        if not text:
            return np.empty(0, dtype=np.int32)
        words = text.split(" ")
        if "" in words or SPACE in text:
            words = [w[1:] for w in re.findall(f" [ ]*[^ ]*", " " + text.replace(SPACE, " "))]
        young, slow = self.young.get, self._word
        return np.frombuffer(b"".join([young(w) or slow(w) for w in words]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids, without the blank put in front; bytes that are no UTF-8 become U+FFFD."""
        out = self.output
        return b"".join([out[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def encode_texts(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, the columns ``keep``, ``n_tokens``, ``ids`` and ``round_trip`` (whether decoding gives the text back) of every row.

    A null text is encoded as an empty one, without pieces. Only U+2581 itself does not survive, as it becomes a blank.
    """
    source = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    others = [c for c in source.columns if c != "__text"]
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [t or "" for t in part.column("__text").to_pylist()]
                ids = [encoder.encode(t) for t in texts]
                same = [encoder.decode(i) == t for i, t in zip(ids, texts)]
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, dtype=np.int32)])))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(sizes), lists, pa.array(same)], [*others, "n_tokens", "ids", "round_trip"]
                )

    return source.mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every row of piece ids; null ids give an empty text."""
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            texts = [encoder.decode(np.asarray(x.as_py() or [], dtype=np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, type=pa.string())], ["id", "text"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
