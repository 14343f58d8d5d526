"""Records of a file that was cut at every separator, also at those inside quotes, put together again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlink.session import materialise

#: Splits, and characters that run over their ends, up to which they are broadcast to the lines; beyond, lines are joined.
BROADCAST_SPLITS, BROADCAST_CHARS = 100_000, 16 << 20
SPLIT = ["_file", "_start"]


def rejoined(pieces: DataFrame, pos: str, ends_inside: Callable[[str, bool], bool], cut: str) -> DataFrame:
    """``(value, pos)`` of the records in ``pieces``, a scan of ``value`` and its place ``pos`` (file, start of the
    split, row in it) that was cut at every ``cut``.

    ``ends_inside`` says whether a piece with a quote ends inside quotes, from the state it starts in; a piece without
    one leaves the state as it is. A split is gone through for both states and gives one row with what it does to them.
    Those rows, run through in order, tell each split the state it starts in, and with it each record begins at a piece
    that starts outside. What runs over the end of a split is sent after its record. Rows are numbered from 1 in each
    split. The rows of splits, and what runs over their ends, are written once and broadcast to the lines if they are few;
    a join takes any number.
    """
    rows = pieces.select(
        "value", F.col(pos)["file"].alias("_file"), F.col(pos)["start"].alias("_start"), F.col(pos)["row"].alias("_at"),
        F.xxhash64(F.col(pos)["file"]).alias("_file_hash"),
    )
    effect = "end0 boolean, end1 boolean, n0 long, n1 long"
    ends = rows.mapInArrow(_effects(ends_inside), f"_file string, _start long, {effect}")
    starts = materialise(_starting(ends))
    splits = starts.count()

    def ordered(some: DataFrame) -> DataFrame:
        # Rows of a split stay together in any join; only their order may be lost.
        return rows.join(F.broadcast(some) if splits <= BROADCAST_SPLITS else some, SPLIT).sortWithinPartitions(*SPLIT, "_at")

    found = "_file string, _start long, _no long, value string"
    records = ordered(starts).mapInArrow(_records(ends_inside, cut, False), found)
    running = starts.filter(F.col("_inside"))
    rests = ordered(running).mapInArrow(_records(ends_inside, cut, True), found).join(running.select(*SPLIT, "_owner", "_owner_no"), SPLIT)
    rests = rests.groupBy("_file", F.col("_owner").alias("_start"), F.col("_owner_no").alias("_no")).agg(
        F.array_sort(F.collect_list(F.struct("_start", "value"))).alias("_rest")
    )
    rests = materialise(rests)
    length = rests.agg(F.sum(F.aggregate("_rest", F.lit(0).cast("long"), lambda n, x: n + F.length(x["value"])))).first()[0] or 0
    if splits <= BROADCAST_SPLITS and length <= BROADCAST_CHARS:
        rests = F.broadcast(rests)
    place = F.struct(F.col("_file").alias("file"), F.col("_start").alias("start"), F.col("_no").alias("row"))
    whole = F.array_join(F.concat(F.array("value"), F.coalesce(F.col("_rest")["value"], F.array())), cut)
    return records.join(rests, [*SPLIT, "_no"], "left").select(whole.alias("value"), place.alias(pos))


def _starting(ends: DataFrame) -> DataFrame:
    """For each split the state it starts in and, if that is inside quotes, the record before it that goes on: its split
    and number."""
    order = Window.partitionBy("_file").orderBy("_start")
    turns = F.col("end0") & ~F.col("end1")
    known = ends.withColumn("_turns", F.sum(turns.cast("int")).over(order))
    fixed = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("to"), F.col("_turns").alias("turns")))
    known = known.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(order))
    # From the last split that ends alike from both states, or the start of the file, each turning split turns it round.
    odd = (F.col("_turns") - F.coalesce("_fixed.turns", F.lit(0))) % 2 == 1
    after = F.coalesce("_fixed.to", F.lit(False)) != odd
    known = known.withColumn("_after", after).withColumn("_inside", F.lag("_after", 1, False).over(order))
    known = known.withColumn("_n", F.when(F.col("_inside"), F.col("n1")).otherwise(F.col("n0")))
    last = F.last(F.when(F.col("_n") > 0, F.struct("_start", "_n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return known.withColumn("_last", last).select(*SPLIT, "_inside", F.col("_last._start").alias("_owner"), F.col("_last._n").alias("_owner_no"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches cut where the split changes: the split, its first row here and its values here."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, file = batch.column("_start").to_numpy(), batch.column("_file_hash").to_numpy()
        new = np.flatnonzero((np.diff(start) != 0) | (np.diff(file) != 0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            yield (batch.column("_file")[lo].as_py(), int(start[lo])), batch.slice(lo, 1), batch.column("value").slice(lo, hi - lo).to_pylist()


def _effects(ends_inside: Callable[[str, bool], bool]):
    """One row for each split: the state it ends in and the records that begin in it, from either state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"_file": at[0], "_start": at[1], "end0": end[0], "end1": end[1], "n0": n[0], "n1": n[1]}], schema=schema)

        schema = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()), ("n0", pa.int64()), ("n1", pa.int64())])
        at, end, n = None, [False, True], [0, 0]
        for split, _, values in _runs(batches):
            if split != at:
                if at is not None:
                    yield row()
                at, end, n = split, [False, True], [0, 0]
            for value in values:
                n = [x + (not inside) for x, inside in zip(n, end)]
                if '"' in value:
                    end = [ends_inside(value, inside) for inside in end]
        if at is not None:
            yield row()

    return run


def _records(ends_inside: Callable[[str, bool], bool], cut: str, rest: bool):
    """The records that begin in each split as far as it holds them, or with ``rest`` the end of the one before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, no, held = None, False, 0, []

        def frame(split: tuple, numbers: list, texts: list) -> pa.RecordBatch:
            columns = [pa.array([split[0]] * len(texts), pa.string()), pa.array([split[1]] * len(texts), pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["_file", "_start", "_no", "value"])

        for split, first, values in _runs(batches):
            if split != at:
                if held and (no == 0) == rest:
                    yield frame(at, [no], [cut.join(held)])
                at, inside, no, held = split, first.column("_inside")[0].as_py(), 0, []
            numbers, texts = [], []
            for value in values:
                if not inside:
                    if held and (no == 0) == rest:
                        numbers.append(no)
                        texts.append(cut.join(held))
                    no, held = no + 1, []
                if not rest or no == 0:
                    held.append(value)
                if '"' in value:
                    inside = ends_inside(value, inside)
            if texts:
                yield frame(at, numbers, texts)
        if held and (no == 0) == rest:
            yield frame(at, [no], [cut.join(held)])

    return run


def in_quoted_field(sep: str) -> Callable[[str, bool], bool]:
    """Whether a line of a delimited file ends inside a quoted value. A quote opens one only where a value begins; what
    follows the closing quote, up to the separator, is text."""

    def ends_inside(line: str, inside: bool) -> bool:
        at = 0
        if not inside:
            if not line.startswith('"'):
                at = line.find(sep + '"') + len(sep)
                if at < len(sep):
                    return False
            at += 1
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            at = line.find(sep + '"', at + 1)
            if at < 0:
                return False
            at += len(sep) + 1

    return ends_inside


def in_json_string(piece: str, inside: bool) -> bool:
    """Whether a piece of JSON, not cut inside an escape, ends inside a string."""
    if "\\" in piece:
        piece = re.sub(r"\\.", "", piece, flags=re.DOTALL)
    return inside != (piece.count('"') % 2 == 1)
