"""Removal of repeated lines, equal or a few edits apart, with DataFrame functions only: a segment-partition edit join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.session import materialise


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from zero) and length of segment ``i`` of a line cut into ``parts`` even ones, the longer ones last."""
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(F.lit(0), F.lit(i - parts) + longer)
    return base * i + extra, base + F.when(longer >= parts - i, 1).otherwise(0)


def _key(line: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size))


def index_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys under which a line is found: its length, a segment's number and the segment."""
    return [_key(line, length, i, *_segment(length, i, edits + 1)) for i in range(edits + 1)]


def probe_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """Keys under which lines of the same or a smaller length within ``edits`` are looked for.

    With ``less`` characters fewer there, segment ``i`` has moved by at most ``i`` places seen from the left and by
    ``edits - i`` seen from the right, or one further left of it or right of it matches.
    """
    out = []
    for less in range(edits + 1):
        other = length - less
        for i in range(edits + 1):
            start, size = _segment(other, i, edits + 1)
            for move in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                if less == 0 and move == 0:
                    continue  # the line's own index key
                inside = (start + move >= 0) & (start + move + size <= length)
                out.append(F.when(inside, _key(line, other, i, start + move, size)))
    return out


#: Letters whose numbers in a line make its sketch, and the bits that each of them has there.
SKETCHED, SKETCH_BITS = "etaoinrshdlu", 5


def sketch(line: Column) -> Column:
    """How often each of twelve letters stands in a line, modulo 32, in one long."""
    out, field = F.lit(0).cast("long"), F.lit((1 << SKETCH_BITS) - 1).cast("long")
    for k, letter in enumerate(SKETCHED):
        # The letters take one byte each, and bytes need no count of characters.
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(field), SKETCH_BITS * k))
    return out


def sketches_agree(a: Column, b: Column, edits: int) -> Column:
    """False only for lines further apart than ``edits``: an edit changes two numbers by one, or one."""
    total, half, field = F.lit(0).cast("long"), 1 << (SKETCH_BITS - 1), F.lit((1 << SKETCH_BITS) - 1).cast("long")
    for k in range(len(SKETCHED)):
        x, y = (F.shiftright(s, SKETCH_BITS * k) for s in (a, b))
        total = total + F.abs((x - y + half).bitwiseAND(field) - half)
    return total <= 2 * edits


def _common(a: Column, b: Column, most: Column) -> Column:
    """The length of the common beginning of two strings, at most ``most``, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(17, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda p, s: F.when((p + s <= most) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s)), p + s).otherwise(p)
    )


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``, by bit-parallel steps along a diagonal band.

    A word of ``2 * edits + 1`` bits holds the vertical differences of a column's cells around the diagonal; a step
    to the next column moves the band down by one row. The distance of the band's middle cell is followed to the end.
    What the strings begin and end with alike is cut off first.
    """
    width = 2 * edits + 1
    mask = F.lit((1 << width) - 1).cast("long")
    zero = F.lit(0).cast("long")

    def matches(x: Column, y: Column) -> Column:
        """For each character of ``y`` the bits of the band's rows with the same character of ``x``."""

        def bits(c: Column, j: Column) -> Column:
            out = zero
            for t in range(width):
                place = j + (t - edits)
                same = (place >= 0) & F.coalesce(F.get(x, F.greatest(place, F.lit(0))) == c, F.lit(False))
                out = out.bitwiseOR(F.when(same, F.lit(1 << t).cast("long")).otherwise(zero))
            return out

        return F.transform(y, bits)

    def step(s: Column, match: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        diagonal = match.bitwiseAND(vp) + vp
        diagonal = diagonal.bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(mask)

        def go_on(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                # The middle cell follows the main diagonal: it grows unless its diagonal difference is zero.
                (s["score"] + F.when(d0.bitwiseAND(F.lit(1 << edits).cast("long")) == 0, 1).otherwise(0)).alias("score"),
            )

        return F.transform(F.array(diagonal), go_on)[0]

    def walk(x: Column, y: Column) -> Column:
        """``x`` is the longer one by at most ``edits``; what it has more is added down the last column."""
        # Below row 0 the first column counts up; rows above it stand for row 0 and differ by nothing.
        start = F.struct(
            F.lit(((1 << width) - 1) ^ ((1 << edits) - 1)).cast("long").alias("vp"), zero.alias("vn"), F.lit(0).alias("score")
        )
        end = F.aggregate(matches(x, y), start, step)

        def total(s: Column) -> Column:
            out = s["score"]
            for t in range(1, edits + 1):
                # After a step the vertical differences are those of the next column's band: row m + t is bit edits + t - 1.
                bit = F.lit(1 << (edits + t - 1)).cast("long")
                more = F.when(s["vp"].bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(s["vn"].bitwiseAND(bit) != 0, 1).otherwise(0)
                out = out + F.when(F.size(x) - F.size(y) >= t, more).otherwise(0)
            return out

        return F.transform(F.array(end), total)[0] <= edits

    swap = F.length(a) < F.length(b)
    ends = F.struct(F.when(swap, b).otherwise(a).alias("x"), F.when(swap, a).otherwise(b).alias("y"))
    # Each step is named once, so that the next one does not compute it for every use.
    least = F.least(F.length(a), F.length(b))
    begun = F.transform(F.array(ends), lambda e: F.struct(
        e["x"].alias("x"), e["y"].alias("y"), F.reverse(e["x"]).alias("u"), F.reverse(e["y"]).alias("v"),
        _common(e["x"], e["y"], least).alias("p"),
    ))
    ended = F.transform(begun, lambda e: F.struct(
        e["x"].alias("x"), e["y"].alias("y"), e["p"].alias("p"), _common(e["u"], e["v"], least - e["p"]).alias("q")
    ))
    middle = lambda line, e: F.split(F.substring(line, e["p"] + 1, F.length(line) - e["p"] - e["q"]), "")
    cut = F.transform(ended, lambda e: F.struct(middle(e["x"], e).alias("x"), middle(e["y"], e).alias("y")))
    # An empty middle is cut into one empty string.
    cut = F.transform(cut, lambda e: F.struct(F.array_remove(e["x"], "").alias("x"), F.array_remove(e["y"], "").alias("y")))
    near = F.transform(cut, lambda e: walk(e["x"], e["y"]))[0]
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, near).otherwise(F.lit(False))


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``text_hash``, ``n_lines`` and ``removed``, the sorted numbers (from zero) of its repeated lines.

    Lines are cut at line feeds; empty ones are never repeated. A line is repeated if a line at most ``edits`` edits away
    stands before it, by id and then line number, in the whole input; of fewer than ``min_chars`` characters, where that
    many edits make most lines alike, only an equal one counts. Lines are judged on the input, so one that goes itself
    still counts. Rows with a null id come after all others; rows that
    share an id and their text get the same answer. A null text has no lines, an empty one has one empty line.

    Equal lines meet in one row per 128-bit hash before anything is joined. A class is found under the keys of its
    segments and looks under those where an equal segment may be; every pair of keys shared is verified once.
    """
    if min_chars <= edits:
        raise ValueError("a line must have a character for each segment")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    split = F.split("text", "\n")
    hashed = source.select("*", F.xxhash64("text").alias("text_hash"))  # once for a text, not for each of its lines
    exploded = hashed.select("id", "text_hash", F.posexplode(split).alias("line", "body"))
    lines = (
        exploded.withColumn("chars", F.length("body"))
        .where(F.col("chars") > 0)
        .select(
            "id", "text_hash", "line", "body", "chars",
            F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"),
            F.struct(F.col("id").isNull().alias("unknown"), "id", "line").alias("at"),
        )
    )
    classes = materialise(_classes(lines, edits, min_chars))
    links = materialise(_links(classes, lines, edits))
    before = (
        links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("b_at").alias("other"))
        .union(links.select("b1", "b2", "a_at"))
        .groupBy("h1", "h2")
        .agg(F.min("other").alias("other"))
    )
    earliest = (
        classes.join(before, ["h1", "h2"], "left")
        .where((F.col("n") > 1) | F.col("other").isNotNull())
        .select("h1", "h2", F.least("first", F.coalesce("other", "first")).alias("earliest"))
    )
    gone = (
        lines.select("id", "text_hash", "line", "at", "h1", "h2")
        .join(earliest, ["h1", "h2"])
        .where(F.col("earliest") < F.col("at"))
        .groupBy("id", "text_hash")
        .agg(F.sort_array(F.collect_set("line")).alias("removed"))
        .select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed")
    )
    counted = source.select("id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.size(split), F.lit(0)).alias("n_lines"))
    counted = counted.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    return counted.join(gone, same, "left").select(
        F.col("id").alias(id_col), "text_hash", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )


def _classes(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """One row per different line: its hashes, first place, number of places and keys; short lines have no keys."""
    body, chars = F.col("body"), F.col("chars")
    long = lambda c: F.first(F.when(chars >= min_chars, c))
    # Inside the aggregates, so that a task computes them for the first of equal lines only, and in methods short enough
    # to be compiled; in a step before the grouping all keys would be one long method.
    return lines.groupBy("h1", "h2").agg(
        F.min("at").alias("first"), F.count("*").alias("n"), long(sketch(body)).alias("sketch"),
        long(F.array(*index_keys(body, chars, edits))).alias("index"), long(F.array(*probe_keys(body, chars, edits))).alias("probe"),
    )


def _links(classes: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Pairs of classes whose lines are within ``edits``, with the first place of each."""
    index = classes.select(F.col("h1").alias("b1"), F.col("sketch").alias("b_sketch"), F.explode("index").alias("key"))
    probe = classes.select(F.col("h1").alias("a1"), F.col("sketch").alias("a_sketch"), F.explode("probe").alias("probe_key"), F.lit(True).alias("moved"))
    own = index.select(F.col("b1").alias("a1"), F.col("b_sketch").alias("a_sketch"), F.col("key").alias("probe_key"), F.lit(False).alias("moved"))
    # In the condition of the join, so that lines that only share a long segment make no row.
    alike = sketches_agree(F.col("a_sketch"), F.col("b_sketch"), edits) & F.expr("moved and a1 != b1 or a1 < b1")
    met = probe.where("probe_key is not null").union(own).join(index, (F.col("probe_key") == F.col("key")) & alike)
    pairs = met.select(F.least("a1", "b1").alias("a1"), F.greatest("a1", "b1").alias("b1"))
    pairs = materialise(pairs.distinct())
    wanted = pairs.select(F.col("a1").alias("h1")).union(pairs.select("b1")).distinct()
    firsts = classes.join(wanted, "h1", "left_semi").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("first.id").alias("c_id"), F.col("first.line").alias("c_line"), "first"
    )
    here = (
        F.col("id").eqNullSafe(F.col("c_id")) & (F.col("line") == F.col("c_line"))
        & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    )
    texts = lines.select("id", "line", "h1", "h2", "body").join(firsts, here).select("h1", "h2", "body", "first")
    texts = materialise(texts.dropDuplicates(["h1", "h2"]))
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("body").alias("a_body"), F.col("first").alias("a_at"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("body").alias("b_body"), F.col("first").alias("b_at"))
    # Few bytes, but much work for each. Written out evenly, since otherwise the test is pushed into the join, which
    # adaptive execution gives to one task.
    spread = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(pairs.join(a, "a1").join(b, "b1").repartition(spread))
    near = met.where(within_edits(F.col("a_body"), F.col("b_body"), edits))
    return near.select("a1", "a2", "a_at", "b1", "b2", "b_at")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_chars: int = 20
) -> DataFrame:
    """``docs`` with the same columns and rows, their texts without repeated lines; a null text stays null."""
    gone = removed_lines(docs, id_col, text_col, edits, min_chars).where(F.size("removed") > 0).distinct()
    gone = gone.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__removed"))
    text = F.col(text_col).cast("string")
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    lines, removed = F.split(text, "\n"), F.col("__removed")

    def between(parts: Column) -> Column:
        """The stretches of lines between the removed ones, each one slice."""

        def stretch(g: Column) -> Column:
            start = F.when(g == 0, F.lit(0)).otherwise(F.get(removed, g - 1) + 1)
            end = F.when(g == F.size(removed), F.size(parts)).otherwise(F.get(removed, g))
            return F.slice(parts, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), stretch)), "\n")

    kept = F.when(removed.isNull(), text).otherwise(F.transform(F.array(lines), between)[0])
    return joined.select(*[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns])
