"""How document filters interact: what each one removes at every place of every order, from counts of bit combinations."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.session import materialise

#: Failure conditions of a text, by letter, in the order of their bits; the last bit is the copy of an earlier text.
Conditions = dict[str, Callable[[Column], Column]]
COPY = "E"
#: Rows of one text that a task compares at most with the text of its smallest id.
SALT_ROWS = 1000
#: Up to so many hashes under more than one id are sent to all tasks (some 30 MB); beyond, the texts are shuffled by hash.
BROADCAST_ROWS = 250_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def upper_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]+", ""))


#: The audit's own conditions; each gets the text (never null) and says whether it fails.
CONDITIONS: Conditions = {
    "A": lambda t: F.size(words(t)) < 50,
    "B": lambda t: 100 * F.size(F.array_distinct(words(t))) < 65 * F.size(words(t)),
    "C": lambda t: 100 * upper_letters(t).cast("long") > 5 * F.length(t).cast("long"),
    "D": lambda t: t.rlike("[#$%&*|]"),
}


def failures(
    docs: DataFrame, conditions: Conditions, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", marks: DataFrame | None = None
) -> DataFrame:
    """``(row, part, mask, seen)`` for every row of ``docs``: the bits of the conditions it fails, the last one for a
    copy of a text with a smaller id anywhere in the table, and in ``seen`` the bits that ``marks`` (``id``, ``bits``)
    has for its id.

    A null text is judged as an empty one, a null part is the empty string. A null id is no smaller id and has none
    smaller; rows that repeat an id with its text are no copies of each other. ``marks`` may repeat ids, their bits add
    up. Other columns of ``docs`` play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    source = source.withColumn("digest", F.unhex(F.sha2("text", 256)))
    mask = sum((F.when(fails(F.col("text")), F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(conditions.values())), F.lit(0))
    # One row for each document, without its text; the row number is fixed by being written.
    facts = materialise(source.select(F.monotonically_increasing_id().alias("row"), "id", "part", "digest", mask.alias("mask")))
    copies = facts.select("row", "id", "digest").join(earlier_copies(source, facts), ["id", "digest"], "left_semi")
    found = [
        facts.select("row", "part", "mask", F.lit(0).alias("seen")),
        copies.select("row", F.lit(None).cast("string").alias("part"), F.lit(1 << len(conditions)).alias("mask"), F.lit(0).alias("seen")),
    ]
    if marks is not None:
        bits = marks.where("id is not null").groupBy("id").agg(F.bit_or("bits").alias("seen"))
        found.append(facts.join(bits, "id").select("row", F.lit(None).cast("string").alias("part"), F.lit(0).alias("mask"), F.col("seen").cast("int")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("row").agg(F.max("part").alias("part"), F.bit_or("mask").alias("mask"), F.bit_or("seen").alias("seen"))


def earlier_copies(source: DataFrame, facts: DataFrame) -> DataFrame:
    """The ``(id, digest)`` of all rows of ``source`` whose text also stands under a smaller id.

    Hashes under more than one id are found without the texts; only rows with such a hash bring theirs. The smallest
    id of each text stands for all of them, once for every ``SALT_ROWS`` rows, so that a text with many copies is
    compared in many tasks. Few enough hashes are sent to the tasks that read the texts.
    """
    shared = facts.groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).where("lo < hi")
    shared = materialise(shared.select("digest", "lo", F.floor(F.col("n") / SALT_ROWS).alias("salts")))
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    texts = source.where("id is not null").select("id", "digest", "text").join(shared, "digest")
    first = texts.groupBy("digest", "text", "salts").agg(F.min("id").alias("first"))
    first = first.select("digest", "text", "first", F.explode(F.sequence(F.lit(0).cast("long"), "salts")).alias("salt"))
    later = texts.where("id > lo").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts") + 1))
    a, b = later.alias("a"), first.alias("b")
    same = (F.col("a.digest") == F.col("b.digest")) & (F.col("a.text") == F.col("b.text")) & (F.col("a.salt") == F.col("b.salt"))
    return a.join(b, same & (F.col("b.first") < F.col("a.id")), "left_semi").select("id", "digest").distinct()


def interactions(failed: DataFrame, letters: str, good: int = 1, toxic: int = 2) -> DataFrame:
    """The audit of documents ``(part, mask, seen)``, bit k of ``mask`` being the failure of filter ``letters[k]``: one
    row per part, order of the filters and step, zeros included, and none for a table without documents.

    Documents are counted by bit combination first, so all else works on at most ``2 ** len(letters)`` rows of a part.
    Every figure of a step is a sum of numbers of documents that pass a set of filters.
    """
    spark, k = failed.sparkSession, len(letters)
    if not 0 < k <= 6 or len(set(letters)) != k:
        raise ValueError("one to six different filters")
    counted = failed.groupBy("part", "mask").agg(
        F.count("*").alias("docs"), F.count_if(F.col("seen").bitwiseAND(good) != 0).alias("good"), F.count_if(F.col("seen").bitwiseAND(toxic) != 0).alias("toxic")
    )
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: s.bitwiseAND(F.col("mask")) == 0)
    passing = counted.select("part", "docs", "good", "toxic", F.explode(sets).alias("passed"))
    passing = passing.groupBy("part", "passed").agg(*[F.sum(c).alias(c) for c in ("docs", "good", "toxic")])
    steps = spark.createDataFrame(_steps(letters), "filter_order string, step int, passed int, kept int, removed int, fails int, unique int")

    def total(weight: str, of: str = "docs") -> Column:
        return F.sum(F.col(weight) * F.col(of))

    # The steps are fixed by the number of filters.
    out = passing.join(F.broadcast(steps), "passed").groupBy("part", "filter_order", "step")
    out = out.agg(
        total("kept").alias("kept"), total("removed").alias("removed"), (total("fails") - total("removed")).alias("redundant"),
        total("unique").alias("unique_fails"), total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"),
    ).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shares = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "letter"]).drop("letter")


def _steps(letters: str) -> list[tuple]:
    """For each order and step, the weights of the documents that pass the set ``passed``, given as bits."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    every = (1 << len(letters)) - 1
    out = []
    for order in permutations(letters):
        before = 0
        for step, c in enumerate(order, 1):
            weights = {s: [0, 0, 0, 0] for s in (before, before | bit[c], 0, bit[c], every, every ^ bit[c])}
            weights[before | bit[c]][0] += 1
            for s, column, by in ((before, 1, 1), (before | bit[c], 1, -1), (0, 2, 1), (bit[c], 2, -1), (every ^ bit[c], 3, 1), (every, 3, -1)):
                weights[s][column] += by
            out.extend(("".join(order), step, s, *w) for s, w in weights.items())
            before |= bit[c]
    return out


def audit(docs: DataFrame, labels: DataFrame, conditions: Conditions = CONDITIONS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``interactions`` of the conditions and the copy filter over whole ``docs``, with ``labels`` (``quality``, ``toxic``).

    A document is good or toxic if any label row of its id says 1; null labels and labels of other ids say nothing.
    """
    bits = F.when(F.col("quality") == 1, 1).otherwise(0) + F.when(F.col("toxic") == 1, 2).otherwise(0)
    marks = labels.select(F.col(id_col).alias("id"), bits.alias("bits"))
    return interactions(failures(docs, conditions, id_col, text_col, part_col, marks), "".join(conditions) + COPY)
