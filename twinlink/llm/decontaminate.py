"""Benchmark decontamination with DataFrame functions only: windows of training words against a broadcast hash set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.llm.texts import ascii_lower, with_row_key
from twinlink.session import materialise

#: What separates words: all of ASCII but digits and lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The hash set is a bitmap of at most this many longs (1 MB), whatever the number of windows.
MAX_LONGS = 1 << 17


def item_words(text: Column) -> Column:
    """Lower-case words of a text; null and texts without a word give an empty array."""
    lowered = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.array_remove(F.split(lowered, GAPS), "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """Distinct ``item`` (the id as a string), ``size`` and ``window`` (words joined by a space) of all items.

    A shorter item is one window of its own size; one without words has none, and neither has one with a null id.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("words"))
    count = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(count - size + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(F.col("words"), i, size), " "))
    return (
        words.where((count > 0) & F.col("item").isNotNull())
        .select("item", F.least(count, F.lit(size)).alias("size"), F.explode(windows).alias("window"))
        .distinct()
    )


def _probe(hashes: Column, start: Column, size: int) -> Column:
    """A hash of four words of a window, from the hashes of all words; places count from zero."""
    return F.xxhash64(F.lit(size), *[F.get(hashes, start + (size - 1) * i // 3) for i in range(4)])


def _bitmap(windows: DataFrame) -> tuple[list[int], list[int]]:
    """The sizes of the windows, and the hash set of their probes as longs of 64 bits."""
    rows = windows.select("size", "window").distinct().withColumn("hashes", F.transform(F.split("window", " "), lambda w: F.xxhash64(w)))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    probes = None
    for size in sizes:
        part = rows.where(F.col("size") == size).select(_probe(F.col("hashes"), F.lit(0), size).alias("h"))
        probes = part if probes is None else probes.union(part)
    if probes is None:
        return [], [0]
    count = rows.count()
    longs = min(MAX_LONGS, max(1024, 1 << (count // 2).bit_length()))
    place, bit = _place(F.col("h"), longs)
    filled = probes.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).collect()
    out = [0] * longs
    for row in filled:
        out[row["place"]] = row["bits"]
    return sizes, out


def _place(h: Column, longs: int) -> tuple[Column, Column]:
    bit = F.shiftrightunsigned(h, 58).cast("int")
    return h.bitwiseAND(F.lit(longs - 1).cast("long")).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _suspects(words: Column, sizes: list[int], bitmap: list[int]) -> Column:
    """``start``, ``size`` and ``window`` of the windows whose probe is in the hash set."""
    # One text that the optimizer folds into one array; a literal for each long would be a plan of its own.
    table = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def known(hashes: Column, size: int):
        def test(start: Column) -> Column:
            return bound(_probe(hashes, start, size), lambda h: _test(table, h, len(bitmap)))

        return test

    def of_words(w: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            parts = []
            for size in sizes:
                starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))))
                kept = F.coalesce(F.filter(starts, known(hashes, size)), F.array().cast("array<int>"))
                parts.append(F.transform(kept, _window_of(w, size)))
            return F.flatten(F.array(*parts)) if parts else F.array().cast("array<struct<start:int,size:int,window:string>>")

        return F.struct(F.size(w).cast("long").alias("n_words"), bound(F.transform(w, lambda x: F.xxhash64(x)), of_hashes).alias("suspects"))

    return bound(words, of_words)


def _window_of(w: Column, size: int):
    return lambda i: F.struct(
        i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(w, i + 1, size), " ").alias("window")
    )


def _test(table: Column, h: Column, longs: int) -> Column:
    place, bit = _place(h, longs)
    return F.get(table, place).bitwiseAND(bit) != 0


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``spans`` (start and size of every occurrence of a window),
    ``n_hit`` (words inside one) and ``items`` (ids of the items found, sorted as strings).

    A probe hashes four words of every window of the documents; those in the bitmap of the items' probes are suspects,
    and a suspect counts if its words equal a window's, by a join. The bitmap has a fixed largest size: more windows
    than fit it well make more suspects, never other results. Texts are read once and never shuffled.
    Null texts have no words; null and repeated ids give a row each; without items nothing is hit.
    """
    windows = materialise(item_windows(items, item_id_col, item_text_col, size))
    sizes, bitmap = _bitmap(windows)
    scanned = docs.select(
        F.col(id_col).alias("id"), _suspects(item_words(F.col(text_col)), sizes, bitmap).alias("found")
    ).select("id", "found.*", F.monotonically_increasing_id().alias("row"))
    scanned = materialise(scanned)
    suspects = scanned.select("row", F.inline("suspects"))
    hits = suspects.join(windows, ["size", "window"])
    cells = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    per_row = (
        hits.groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("n_hit", F.size(F.array_distinct(cells)).cast("long"))
    )
    none = F.array().cast("array<struct<start:int,size:int>>")
    return (
        scanned.drop("suspects")
        .join(per_row, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that have a hit, columns unchanged. Each row is judged by its own text, whatever its id."""
    keyed, key = with_row_key(docs)
    hit = contamination(keyed, items, key, text_col, **options).where("n_hit > 0").select(key)
    return keyed.join(hit, key, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col`` and ``clean_text``: the lower-case words outside every hit, joined by one space, a row per row of ``docs``.

    Each row is cleaned by its own spans, also where rows share an id or have none.
    """
    keyed, key = with_row_key(docs)
    spans = contamination(keyed, items, key, text_col, **options).where("n_hit > 0").select(F.col(key).alias("hit_row"), "spans")
    worded = keyed.select(F.col(id_col).alias("id"), F.col(key).alias("row"), item_words(F.col(text_col)).alias("words"))
    joined = worded.join(spans, F.col("row") == F.col("hit_row"), "left")
    inside = lambda i: F.exists("spans", lambda s: (i >= s["start"]) & (i < s["start"] + s["size"]))
    kept = F.when(F.col("spans").isNull(), F.col("words")).otherwise(F.filter("words", lambda w, i: ~inside(i)))
    return joined.select(F.col("id").alias(id_col), F.array_join(kept, " ").alias("clean_text"))
