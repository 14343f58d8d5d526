"""Packing of encoded documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlink.session import materialise

CAPACITY = 2048
#: Texts are encoded in parts of about so many characters.
PART_CHARS = 1 << 16
# Fixed value: the pattern of the byte-level format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The linear program ends at this relative distance from its lower bound, or after so many knapsack tables.
GAP, MAX_TABLES = 0.0005, 200
#: Patterns taken from one knapsack table.
COLUMNS = 30
_EPS, _PIVOT = 1e-9, 1e-6
#: Less than this of a length is not worth a greedy pattern; tiny remainders would make the basis ill-conditioned.
LEAST = 0.5
#: Before a blank after a letter, digit or underscore no token of the byte-level pattern goes on.
_SAFE = re.compile(r"(?<=\w) ")


def _parts(text: str) -> list[str]:
    """A text cut at blanks where tokens end anyway; a run without such a blank is one part, whatever its length."""
    out, start = [], 0
    while len(text) - start > PART_CHARS:
        found = _SAFE.search(text, start + PART_CHARS)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def byte_level_encoder(tokenizer_json: str) -> Callable[[str], list[int]]:
    """The encoding function of a byte-level tokenizer file.

    The file's vocabulary is handed to tiktoken, whose merge loop gives the same ids several times faster than the
    file's own library; a file whose ids are not in the order of its merges is refused, as they would differ.
    """
    import tiktoken

    model = json.loads(tokenizer_json)
    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    # Bytes that print stand for themselves in the file, the others for characters from 256 on.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printed)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges)
    if model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level tokenizer")
    if any(vocabulary[token] != 256 + n for n, token in enumerate(joined)):
        raise ValueError("the ids are not in the order of the merges")
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all")


def _encode(encode: Callable[[str], list[int]], text: str, end_id: int) -> np.ndarray:
    """The ids of a text with the end id."""
    found = [np.array(encode(part), dtype=np.int32) for part in _parts(text)] if text else []
    return np.concatenate([*found, np.array([end_id], dtype=np.int32)])


def encoded_pieces(docs: DataFrame, tokenizer_json: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ids with the end id, cut every ``capacity`` ids: ``(id, start, length, doc_tokens, ids)``.

    ``nth`` numbers the pieces of one length within a task. A null text is encoded as an empty one and has the end id
    alone; null and repeated ids are kept apart as rows; other columns are left out. ``tokenizer_json`` is the content
    of a byte-level tokenizer file, which every task gets.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(shared.value)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = [_encode(encode, t or "", end_id) for t in part.column("text").to_pylist()]
                totals = np.array([len(x) for x in ids], dtype=np.int64)
                counts = -(-totals // capacity)
                owner = np.repeat(np.arange(len(ids)), counts)
                starts = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
                lengths = np.minimum(capacity, totals[owner] - starts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                columns = [part.column("id").take(pa.array(owner)), starts, lengths, totals[owner], _numbered(lengths, seen)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns), lists], [*PIECE, "ids"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, nth long, ids array<int>")


PIECE = ("id", "start", "length", "doc_tokens", "nth")


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each length how often it came before, counting on from ``seen``, which is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    sorted_ = lengths[order]
    first = np.searchsorted(sorted_, sorted_)
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = np.arange(len(lengths)) - first + seen[sorted_]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


class _Program:
    """The restricted linear program: rows are lengths, columns are patterns or a length left to the stream.

    The basis begins with all lengths in the stream, so its inverse begins as the identity.
    """

    def __init__(self, demand: np.ndarray, stream_cost: np.ndarray):
        self.x = demand.astype(float)
        self.inverse = np.eye(len(demand))
        self.dual = stream_cost.astype(float).copy()
        #: A pattern, or the row of a length left to the stream.
        self.basis: list[tuple | int] = list(range(len(demand)))
        self.pivots = 0

    def step(self, rows: np.ndarray, times: np.ndarray, cost: float) -> tuple[float, int, np.ndarray]:
        """By how much a column would lower the cost, the row that it would take, and its form in the basis."""
        gain = float(self.dual[rows] @ times) - cost
        if gain <= _EPS:
            return 0.0, -1, rows
        change = self.inverse[:, rows] @ times
        down = np.flatnonzero(change > _PIVOT)
        if not len(down):
            return 0.0, -1, rows
        ratios = np.maximum(self.x[down], 0.0) / change[down]
        ties = np.flatnonzero(ratios <= ratios.min() + _EPS)
        at = int(ties[np.argmax(change[down][ties])])
        return gain * float(ratios[at]), int(down[at]), change

    def enter(self, rows: np.ndarray, times: np.ndarray, cost: float, column: tuple | int) -> bool:
        """Bring a column into the basis if that does not raise the cost."""
        _, out, change = self.step(rows, times, cost)
        if out < 0:
            return False
        gain = float(self.dual[rows] @ times) - cost
        amount = max(self.x[out], 0.0) / change[out]
        pivot = self.inverse[out] / change[out]
        others = np.flatnonzero(np.abs(change) > _EPS)
        others = others[others != out]
        filled = np.flatnonzero(pivot)
        self.inverse[np.ix_(others, filled)] -= np.outer(change[others], pivot[filled])
        self.x[others] -= change[others] * amount
        self.inverse[out], self.x[out], self.basis[out] = pivot, amount, column
        self.dual -= gain * pivot
        self.pivots += 1
        return True


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every total the best value of lengths that add up to it exactly, and the last length of one that does."""
    best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, dtype=np.int64)
    best[0] = 0.0
    for total in range(1, capacity + 1):
        found = best[total - 1 :: -1][:total] + value[1 : total + 1]
        last[total] = at = int(np.argmax(found)) + 1
        best[total] = found[at - 1]
    return best, last


def _unpack(total: int, last: np.ndarray, more: int = 0) -> dict[int, int]:
    out = {more: 1} if more else {}
    while total:
        out[int(last[total])] = out.get(int(last[total]), 0) + 1
        total -= int(last[total])
    return out


def _greedy(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Iterator[dict[int, int]]:
    """Patterns that take the longest length that still fits, each used until one of its lengths is used up."""
    live, left = lengths.tolist(), dict(zip(lengths.tolist(), demand.astype(float).tolist()))
    while live:
        pattern, room = {}, capacity
        while room and (at := bisect_right(live, room)):
            # A length that does not come again in this pattern makes room for the next shorter one.
            while at and live[at - 1] in pattern:
                at -= 1
            if not at:
                break
            l = live[at - 1]
            pattern[l] = min(room // l, max(1, int(left[l])))
            room -= l * pattern[l]
        times = min(left[l] / n for l, n in pattern.items())
        for l, n in pattern.items():
            left[l] -= n * times
            if left[l] < LEAST:
                live.remove(l)
        yield pattern


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, max_tables: int = MAX_TABLES) -> list[tuple[dict[int, int], int]]:
    """Patterns of lengths that go into one sequence, each with how often it is cut; together no more than
    ``histogram`` has.

    The linear program covers all lengths below ``capacity`` with the fewest sequences. Its first basis is greedy; a
    knapsack over the duals then prices new patterns, until the cost is within ``gap`` of its lower bound or
    ``max_tables`` tables were made (which leaves more waste, never an invalid result). The solution is rounded down;
    then, by falling fraction, a pattern is taken once more if all its lengths are left, and the patterns that waste most
    are given up until what is left over can fill all waste. Time and memory depend on ``capacity``, not on the number
    of documents.
    """
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(l for l, n in histogram.items() if 0 < l < capacity and n > 0), dtype=np.int64)
    if not len(lengths):
        return out
    demand = np.array([histogram[int(l)] for l in lengths], dtype=np.int64)
    row = {int(l): i for i, l in enumerate(lengths)}
    program = _Program(demand, 2.0 * np.ones(len(lengths)))

    def enter(pattern: dict[int, int]) -> bool:
        return program.enter(*column(pattern), 1.0, tuple(pattern.items()))

    def column(pattern: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([row[l] for l in pattern]), np.array(list(pattern.values()), dtype=float)

    for pattern in _greedy(lengths, demand, capacity):
        enter(pattern)
    bound = float(lengths @ demand) / capacity
    for _ in range(max_tables):
        cost = float(program.dual @ demand)
        if cost <= bound * (1.0 + gap):
            break
        value = np.full(capacity + 1, -np.inf)
        value[lengths] = program.dual
        exact, last = _knapsack(value, capacity)
        # The best total up to each, as a sequence need not be full.
        best = np.maximum.accumulate(exact)
        where = np.maximum.accumulate(np.where(exact >= best, np.arange(capacity + 1), 0))
        # Duals divided by the best value are a solution of the dual program.
        bound = max(bound, cost / max(1.0, float(best[capacity])))
        with_each = best[capacity - lengths] + program.dual - 1.0
        chosen = {tuple(sorted(_unpack(int(where[capacity]), last).items()))}
        for i in np.argsort(-with_each)[:COLUMNS]:
            pattern = _unpack(int(where[capacity - lengths[i]]), last)
            pattern[int(lengths[i])] = pattern.get(int(lengths[i]), 0) + 1
            chosen.add(tuple(sorted(pattern.items())))
        candidates = [dict(c) for c in chosen]
        moved = False
        # The pattern that lowers the cost most enters first.
        while candidates:
            gains = [program.step(*column(c), 1.0) for c in candidates]
            at = max(range(len(gains)), key=lambda k: (gains[k][0], gains[k][1]))
            if gains[at][1] < 0 or (moved and gains[at][0] <= 1e-6 * cost / len(lengths)):
                break
            moved |= enter(candidates.pop(at))
        if not moved:
            break
    return out + _rounded(program, row, demand, capacity)


def _rounded(program: _Program, row: dict[int, int], demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    left, counts = demand.copy(), {}
    shares = sorted(((p, x) for p, x in zip(program.basis, program.x) if isinstance(p, tuple) and x > 0), key=lambda s: -(s[1] % 1.0))

    def take(pattern: tuple, times: int) -> None:
        times = min([times, *(int(left[row[l]]) // n for l, n in pattern)])
        if times > 0:
            counts[pattern] = counts.get(pattern, 0) + times
            for l, n in pattern:
                left[row[l]] -= n * times

    for pattern, x in shares:
        take(pattern, int(np.floor(x + 1e-6)))
    for pattern, _ in shares:
        take(pattern, 1)
    waste = {p: capacity - sum(l * n for l, n in p) for p in counts}
    # Each use given up brings the left lengths and the waste closer by the whole capacity.
    spare = sum(l * int(left[i]) for l, i in row.items()) - sum(waste[p] * n for p, n in counts.items())
    for p in sorted(counts, key=waste.__getitem__, reverse=True):
        gone = min(counts[p], max(0, -(spare // capacity)))
        counts[p] -= gone
        spare += gone * capacity
    return [(dict(p), n) for p, n in counts.items() if n]


class _Places:
    """Where the pieces of each length go, by their rank among all of that length: plain arrays, whose size depends on
    the capacity alone."""

    def __init__(self, histogram: dict[int, int], chosen: list[tuple[dict[int, int], int]], capacity: int):
        self.capacity = capacity
        used = np.zeros(capacity + 1, dtype=np.int64)
        sequences, slots, gaps = 0, [], []
        for pattern, count in chosen:
            offset = 0
            for l in sorted(pattern, reverse=True):
                n = pattern[l]
                slots.append((l, int(used[l]), sequences, n, offset))
                used[l] += n * count
                offset += l * n
            if offset < capacity:
                gaps.append((capacity - offset, count, sequences))
            sequences += count
        slots.sort()
        self.length, self.first, self.sequence, self.times, self.offset = (np.array(c, dtype=np.int64) for c in zip(*slots)) if slots else [np.empty(0, np.int64)] * 5
        # A length's slots are neighbours, in the order of their first ranks.
        self.begin = np.searchsorted(self.length, np.arange(capacity + 2))
        self.used = used
        sizes = np.array([histogram.get(l, 0) for l in range(capacity + 1)], dtype=np.int64)
        rest = (sizes - used) * np.arange(capacity + 1)
        # The stream takes what no pattern holds, longest first.
        self.base = rest[::-1].cumsum()[::-1] - rest
        self._spaces(int(rest.sum()), gaps, sequences)

    def _spaces(self, total: int, gaps: list[tuple[int, int, int]], sequences: int) -> None:
        """Runs of equal spaces that the stream goes through: the gaps of the patterns, widest first, then sequences of
        its own, the last of them powers of two, which need no padding."""
        runs = []
        for size, count, sequence in sorted(gaps, reverse=True):
            runs.append((size, min(count, -(-total // size)), sequence, self.capacity - size))
            total = max(0, total - size * count)
        steps = [(self.capacity, total // self.capacity)] + [(1 << k, total >> k & 1) for k in range(self.capacity.bit_length() - 2, -1, -1)]
        for size, count in steps:
            runs.append((size, count, sequences, 0))
            sequences += count
        runs = [r for r in runs if r[1]] + [(1, 1, 0, 0)]
        self.size, count, self.number, self.offset_ = (np.array(c, dtype=np.int64) for c in zip(*runs))
        self.begin_at, self.begin_space = np.cumsum(self.size * count) - self.size * count, np.cumsum(count) - count

    def _bound(self, space: np.ndarray) -> np.ndarray:
        """The place of the stream at which a space begins."""
        run = np.searchsorted(self.begin_space, space, side="right") - 1
        return self.begin_at[run] + (space - self.begin_space[run]) * self.size[run]

    def _space(self, place: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.begin_at, place, side="right") - 1
        return self.begin_space[run] + (place - self.begin_at[run]) // self.size[run]

    def cuts(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every cut: which piece it is of, its start there, its length, its sequence and its offset in that."""
        placed = ranks < self.used[lengths]
        at = np.zeros(len(lengths), dtype=np.int64)
        for l in np.unique(lengths[placed]):
            mine = np.flatnonzero(placed & (lengths == l))
            lo, hi = self.begin[l], self.begin[l + 1]
            at[mine] = lo + np.searchsorted(self.first[lo:hi], ranks[mine], side="right") - 1
        place = self.base[lengths] + (ranks - self.used[lengths]) * lengths
        low = self._space(np.where(placed, 0, place))
        high = np.where(placed, low, self._space(np.where(placed, 0, place + lengths - 1)))
        counts = high - low + 1
        owner = np.repeat(np.arange(len(lengths)), counts)
        space = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.maximum(place[owner], self._bound(space))
        end = np.minimum(place[owner] + lengths[owner], self._bound(space + 1))
        run = np.searchsorted(self.begin_space, space, side="right") - 1
        sequence, offset = self.number[run] + space - self.begin_space[run], self.offset_[run] + begin - self._bound(space)
        start, size = begin - place[owner], end - begin
        own = placed[owner]
        if own.any():
            slot, piece = at[owner[own]], owner[own]
            nth = ranks[piece] - self.first[slot]
            sequence[own] = self.sequence[slot] + nth // self.times[slot]
            offset[own] = self.offset[slot] + nth % self.times[slot] * lengths[piece]
            start[own], size[own] = 0, lengths[piece]
        return owner, start, size, sequence, offset


def pack(docs: DataFrame, tokenizer_json: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Pieces of all documents' ids in sequences: ``(id_col, start, length, ids, doc_tokens, sequence_id, offset)``.

    Every id lies in one piece; the pieces of a sequence fill it from 0 without gaps, at most up to ``capacity`` (a
    power of two). Whole runs of ``capacity`` ids are sequences of their own. The ends of the documents go into the
    patterns of ``patterns``, by their rank among all ends of that length. Those that no pattern holds are a stream, laid
    end to end, longest first: it fills what the patterns leave free and then sequences of its own, cut where those
    are full, and ends in powers of two, so nothing is padded. Only the histogram of at most ``capacity`` lengths
    comes to the driver, and only the patterns go out. Documents are handled as ``encoded_pieces`` says; without rows
    there are no pieces.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    pieces = encoded_pieces(docs, tokenizer_json, end_id, capacity, id_col, text_col)
    pieces = materialise(pieces.withColumn("block", F.shiftright(F.monotonically_increasing_id(), 33)))
    # Ranks among all pieces of a length: the block's own numbers after those of the blocks before it.
    blocks = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long"))))
    histogram = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _Places(histogram, patterns(histogram, capacity, **options), capacity)
    ranked = pieces.join(blocks.select("length", "block", "before"), ["length", "block"])
    ranked = ranked.select("id", "start", "length", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lengths, ranks, starts = (part.column(c).to_numpy() for c in ("length", "rank", "start"))
                owner, start, size, sequence, offset = places.cuts(lengths, ranks)
                # Cuts follow each other as the ids do.
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), part.column("ids").flatten())
                taken = pa.array(owner)
                columns = [part.column("id").take(taken), pa.array(starts[owner] + start), pa.array(size), ids, part.column("doc_tokens").take(taken)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the sequences themselves, put together from their pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def checksums(packed: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32``, over their ids as little-endian 32-bit numbers, in place of the ids."""
    others = [c for c in packed.columns if c != "ids"]
    kinds = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, bounds = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sums, type=pa.int64())], [*others, "ids_crc32"])

    return packed.mapInArrow(run, f"{kinds}, ids_crc32 long")
