"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.llm.components import connected_components
from twinlink.llm.texts import with_row_key
from twinlink.session import materialise

SEED = 42
BITS = 64
#: Bits a node pair takes at once when it is too large for one task.
STEP = 8


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col`` and ``fp`` (64 bits as a long) of every row.

    A-Z are lower-cased, words are cut at blanks, shingles are ``shingle`` words joined by a space, repeats included;
    fewer words are one shingle, no words (or a null text) give fingerprint zero. A bit is set if it is set in more
    than half the XXH64 values (seed 42) of the shingles. Any id type, null and repeated ids included.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = [_fingerprint(x.as_py() or b"", shingle) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), type=pa.int64())], ["id", "fp"]
            )

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")
    return out.withColumnRenamed("id", id_col)


def _fingerprint(text: bytes, k: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-k]]).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    count = len(words) - k + 1
    values = np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, count)
    ones = np.zeros(BITS, dtype=np.int64)
    for part in range(0, count, 65536):
        bits = np.unpackbits(values[part : part + 65536].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def link_fingerprints(prints: DataFrame, max_distance: int = 4, node_rows: int = 2048) -> DataFrame:
    """``node`` and ``root`` of every fingerprint of ``prints`` (column ``fp``) that is within ``max_distance`` bits of another.

    Of ``max_distance + 2`` blocks of bits two linked fingerprints share at least two, so one trie is made for each
    pair of blocks with those bits in front; below a front that several fingerprints share, node pairs are walked
    together, differing bits are added up and a pair is dropped once they exceed ``max_distance``. A front with more
    than ``node_rows`` fingerprints is first walked as a join of its nodes, so that no task holds it whole.
    """
    distinct = materialise(prints.select("fp").where("fp is not null").distinct())
    fronts = [(i, mask) for i, mask in enumerate(_masks(max_distance + 2))]
    rows = distinct.select("fp", F.explode(F.array(*[_front(i, mask) for i, mask in fronts])).alias("node"))
    shared = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(rows.join(shared, "node").select("node", F.lit(0).alias("side"), "fp", "n"))
    done = members.where(F.col("n") <= node_rows).select("node", "side", "fp")
    large = members.where(F.col("n") > node_rows).select("node", "side", "fp", F.lit(0).alias("err"))
    depth = 0
    while depth < BITS and not large.isEmpty():
        pairs = materialise(_descend(large, depth, max_distance))
        depth += STEP
        done = done.union(pairs.where(F.col("n") <= node_rows).select("node", "side", "fp"))
        large = pairs.where(F.col("n") > node_rows).select("node", "side", "fp", "err")
    ordered = done.repartition("node").sortWithinPartitions("node", "side", "fp")
    links = ordered.mapInArrow(_walker(max_distance), "a long, b long")
    return connected_components(links, "a", "b")


def _masks(blocks: int) -> list[int]:
    """For each pair of the blocks that 64 bits are cut into, the mask of their bits."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    single = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(single, 2)]


def _front(trie: int, mask: int) -> Column:
    signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
    return F.xxhash64(F.lit(trie), F.col("fp").bitwiseAND(F.lit(signed).cast("long")))


def _descend(rows: DataFrame, depth: int, max_distance: int) -> DataFrame:
    """The pairs of child nodes, ``STEP`` bits further down, whose bits differ little enough, with their members."""
    child = F.shiftrightunsigned(F.col("fp"), BITS - STEP - depth).bitwiseAND(F.lit((1 << STEP) - 1).cast("long"))
    split = rows.withColumn("child", child)
    nodes = split.groupBy("node", "side", "err", "child").agg(F.count("*").alias("n"))
    crossed = nodes.groupBy("node").agg((F.max("side") > 0).alias("crossed"))
    nodes = nodes.join(crossed, "node")
    a, b = nodes.alias("a"), nodes.alias("b")
    differ = F.bit_count(F.col("a.child").bitwiseXOR(F.col("b.child")))
    met = a.join(b, F.col("a.node") == F.col("b.node")).where(
        F.when(F.col("a.crossed"), (F.col("a.side") == 0) & (F.col("b.side") == 1)).otherwise(F.col("a.child") <= F.col("b.child"))
        & (F.col("a.err") + differ <= max_distance)
    )
    itself = ~F.col("a.crossed") & (F.col("a.child") == F.col("b.child"))
    pair = met.select(
        F.col("a.node").alias("node"),
        F.xxhash64(F.col("a.node"), F.col("a.child"), F.col("b.child"), F.col("a.crossed")).alias("next"),
        (F.col("a.err") + differ).alias("next_err"),
        F.when(itself, F.col("a.n")).otherwise(F.col("a.n") + F.col("b.n")).alias("size"),
        F.explode(
            F.when(itself, F.array(F.struct(F.lit(0).alias("to"), F.col("a.side").alias("of"), F.col("a.child").alias("c")))).otherwise(
                F.array(
                    F.struct(F.lit(0).alias("to"), F.col("a.side").alias("of"), F.col("a.child").alias("c")),
                    F.struct(F.lit(1).alias("to"), F.col("b.side").alias("of"), F.col("b.child").alias("c")),
                )
            )
        ).alias("end"),
    ).select("node", "next", "next_err", "size", "end.*")
    members = split.select("node", F.col("side").alias("of"), F.col("child").alias("c"), "fp").join(pair, ["node", "of", "c"])
    return members.where("size > 1").select(
        F.col("next").alias("node"), F.col("to").alias("side"), "fp", F.col("next_err").alias("err"), F.col("size").alias("n")
    )


def _walker(max_distance: int):
    """Walks the node pairs of a partition's fronts; gives each linked fingerprint with the smallest of its group there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "side", "fp")])
            rest.append(part)
            if part.shape[1] and part[0, -1] != rest[0][0, 0]:
                held = np.concatenate(rest, axis=1)
                cut = int(np.flatnonzero(held[0] != held[0, -1])[-1]) + 1
                yield from _walk_chunks(held[:, :cut], max_distance)
                rest = [held[:, cut:]]
        if rest:
            yield from _walk_chunks(np.concatenate(rest, axis=1), max_distance)

    return run


def _walk_chunks(rows: np.ndarray, max_distance: int) -> Iterator[pa.RecordBatch]:
    """Whole fronts at a time, so many that their node pairs fit in some 100 MB."""
    if not rows.shape[1]:
        return
    edges = np.append(np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] - 1)), rows.shape[1])
    cost = np.cumsum(np.diff(edges).astype(np.float64) ** 2)
    chunk = (cost // 2e6).astype(np.int64)
    for k in np.unique(chunk):
        own = np.flatnonzero(chunk == k)
        part = rows[:, edges[own[0]] : edges[own[-1] + 1]]
        a, b = trie_links(part[0], part[1], part[2].view(np.uint64), max_distance)
        yield _forest(part[2], a, b)


def _forest(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The links as a star around the smallest fingerprint of each group."""
    used = np.unique(np.concatenate([fps[a], fps[b]])) if len(a) else np.empty(0, dtype=np.int64)
    x, y = np.searchsorted(used, fps[a]), np.searchsorted(used, fps[b])
    label = np.arange(len(used))
    while len(x):
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(used)))
    return pa.RecordBatch.from_arrays([pa.array(used[moved]), pa.array(used[label[moved]])], ["a", "b"])


def trie_links(node: np.ndarray, side: np.ndarray, fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within ``max_distance`` bits below each root; rows come sorted by (node, side, fp).

    A sorted range is a trie: a node is a range whose fingerprints agree in their first bits, and its children are the
    two parts around the first one with the next bit set. All node pairs of one depth are walked at once. A root whose
    rows have two sides is a pair of nodes, any other is a node paired with itself.
    """
    order = np.lexsort((fps, side, node))
    fps, node, side = fps[order], node[order], side[order]
    roots = np.flatnonzero(np.diff(node, prepend=node[0] - 1)) if len(node) else np.empty(0, dtype=np.int64)
    ends = np.append(roots[1:], len(node)) if len(node) else roots
    ones = np.concatenate([[0], np.cumsum(side != 0)])
    middle = ends - (ones[ends] - ones[roots])
    alone = middle == ends
    alo, ahi = roots, np.where(alone, ends, middle)
    blo, bhi = np.where(alone, roots, middle), ends
    err = np.zeros(len(roots), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(BITS + 1):
        same = alo == blo
        keep = ~(same & (ahi - alo < 2)) & (ahi > alo) & (bhi > blo)
        leaf = keep & ~same & (ahi - alo == 1) & (bhi - blo == 1)
        x, y = alo[leaf], blo[leaf]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= max_distance
        found.append((order[x[near]], order[y[near]]))
        walk = keep & ~leaf
        alo, ahi, blo, bhi, err, same = alo[walk], ahi[walk], blo[walk], bhi[walk], err[walk], same[walk]
        if not len(alo) or depth == BITS:
            break
        bit = (fps >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        sums = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        amid, bmid = ahi - (sums[ahi] - sums[alo]), bhi - (sums[bhi] - sums[blo])
        far = ~same
        children = [
            (alo, amid, blo, bmid, err, slice(None)),
            (amid, ahi, bmid, bhi, err, slice(None)),
            (alo, amid, bmid, bhi, err + 1, slice(None)),
            (amid, ahi, blo, bmid, err + 1, far),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate([c[i][c[5]] for c in children]) for i in range(5))
        near = (err <= max_distance) & (ahi > alo) & (bhi > blo)
        alo, ahi, blo, bhi, err = alo[near], ahi[near], blo[near], bhi[near], err[near]
    a = np.concatenate([f[0] for f in found]) if found else np.empty(0, dtype=np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.empty(0, dtype=np.int64)
    return a, b


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4
) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` and ``component_id``, the smallest id reachable over links.

    Documents with the same fingerprint are linked; so are those whose fingerprints differ in at most ``max_distance``
    bits. A null id never is the smallest one; a group of null ids only has a null ``component_id``. Copies meet in one
    row by fingerprint before anything is joined, and no table of links leaves the executors.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle))
    groups = _groups(prints, F.min(id_col), F.min("first"), max_distance)
    return prints.join(groups.withColumnRenamed("first", "component_id"), "fp").select(id_col, "fp", "component_id")


def _groups(prints: DataFrame, least: Column, least_of_firsts: Column, max_distance: int) -> DataFrame:
    """``fp`` and ``first``, the least of the group's rows: ``least`` over rows, ``least_of_firsts`` over fingerprints."""
    firsts = prints.groupBy("fp").agg(least.alias("first"))
    roots = link_fingerprints(prints, max_distance)
    by_print = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    by_print = materialise(by_print)
    return by_print.select("fp", "root").join(by_print.groupBy("root").agg(least_of_firsts.alias("first")), "root").select("fp", "first")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row of each group, with its columns: the one with the smallest id, and null ids come after all others.

    Rows are told apart by a number of their own, so of rows that share the smallest id, or of a group without ids, one
    stays as well.
    """
    keyed, key = with_row_key(docs)
    at = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col(key).alias("row"))
    placed = keyed.select(at.alias("at"), F.col(text_col).alias("text"))
    groups = _groups(materialise(fingerprints(placed, "at", "text", shingle)), F.min("at"), F.min("first"), max_distance)
    first = groups.select(F.col("first.row").alias(key)).distinct()
    return keyed.join(first, key, "left_semi").select(*docs.columns)
