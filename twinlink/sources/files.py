"""Entity tables, ground truths, candidate pairs and record texts on files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.functions.text import serialize_record
from twinlink.operators.pairs import group_candidates, records_of_interest
from twinlink.operators.rank import LIST_ROWS
from twinlink.sources.splitting import in_json_string, in_quoted_field, rejoined

ROW_POS = "row_pos"


def _file_position() -> Column:
    """Orders the rows of a scan as they stand in its files: by file, then split, then row."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_entities(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    sep: str = "|",
    with_position: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """A delimited entity table with a header; every column is read as a string and the first one is the id.

    The names are those of the header; ``columns`` that are not the header's, in its order, fail the query, in every
    file. Quoted values may hold separators and doubled quotes, and line breaks if ``multi_line`` is set; such a file
    is read by as many tasks as any other, and its lines are put together again.
    """
    reader = _delimited(spark, sep, multi_line)
    if columns is None:
        columns = reader.csv(path).columns
    if multi_line:
        return _quoted_lines(spark, path, columns, sep, with_position)
    return _named(reader.option("enforceSchema", False), path, columns, with_position)


def _quoted_lines(spark: SparkSession, path: str, columns: list[str], sep: str, with_position: bool) -> DataFrame:
    """Records of a delimited file in which quoted values may hold line breaks; the first of each file is its header."""
    records = rejoined(_pieces(spark, path, "\n"), ROW_POS, in_quoted_field(sep), "\n")
    records = records.withColumn("value", F.regexp_replace("value", r"\r$", "")).filter(F.trim("value") != "")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    parsed = records.select(F.from_csv("value", schema, options).alias("record"), ROW_POS, "value")
    is_header = (F.col(f"{ROW_POS}.start") == 0) & (F.col(f"{ROW_POS}.row") == 1)
    # One column more than wanted shows a header that is too long.
    header = F.from_csv("value", f"{schema}, _more string", options)
    given = F.array(*[header.getField(c) for c in [*columns, "_more"]])
    same = F.lower(F.to_json(given)) == F.lower(F.to_json(F.array(*[F.lit(c) for c in [*columns, None]])))
    message = F.concat(F.lit(f"the header is not {columns}: "), F.substring("value", 1, 200))
    rows = parsed.filter(F.when(is_header & ~F.coalesce(same, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(~is_header))
    return rows.select("record.*", *([ROW_POS] if with_position else []))


def _delimited(spark: SparkSession, sep: str, multi_line: bool) -> DataFrameReader:
    return spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def _named(reader: DataFrameReader, path: str, columns: list[str], with_position: bool) -> DataFrame:
    df = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    return df.withColumn(ROW_POS, _file_position()) if with_position else df


def attribute_columns(entities: DataFrame) -> list[str]:
    """All columns but the first, which holds the id."""
    return [c for c in entities.columns[1:] if c != ROW_POS]


def scan_ground_truth(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Two columns as ``(d1_id, d2_id)``, whatever their header; of several rows for a d1 the last one in the file counts.

    A file with another number of columns fails.
    """
    reader = _delimited(spark, sep, multi_line=False)
    header = reader.csv(path).columns
    if len(header) != 2:
        raise ValueError(f"a ground truth has two columns, not {header}")
    table = _named(reader.option("enforceSchema", False), path, header, with_position=False)
    ids = [F.col(f"`{c}`").alias(name) for c, name in zip(header, ("d1_id", "d2_id"))]
    at = [F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    file = F.col("_metadata.file_path").alias("file")
    # The rows are sorted to be grouped: each carries the number of its file instead of the name.
    files = table.select(file).distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")))
    rows = table.select(*ids, file, *at).join(F.broadcast(files), "file", "left").select("d1_id", "d2_id", F.struct("file_no", "start", "row").alias(ROW_POS))
    return rows.groupBy("d1_id").agg(F.max_by("d2_id", ROW_POS).alias("d2_id"))


# Where a JSON object that maps ids to lists or texts may be cut so that each piece holds one entry:
# "entries" has one entry per line, the others are one-line objects as a JSON writer emits them. A list ends wherever a
# bracket stands outside the quotes, however the object is laid out.
PAIR_CUTS = {"entries": "\n", "compact": "]"}
RECORD_CUTS = {"entries": "\n", "compact": '", "'}


def _pieces(spark: SparkSession, path: str, cut: str) -> DataFrame:
    return spark.read.option("lineSep", cut).text(path).withColumn(ROW_POS, _file_position())


def _entries(spark: SparkSession, path: str, cut: str) -> DataFrame:
    """Pieces of an object without the punctuation between entries."""
    return _bare(_pieces(spark, path, cut))


def _bare(pieces: DataFrame) -> DataFrame:
    piece = F.regexp_replace(F.regexp_replace("value", r"^[\s{,]+", ""), r"[\s,}]+$", "")
    return pieces.select(piece.alias("piece"), ROW_POS).filter(F.col("piece") != "")


def _list_entries(spark: SparkSession, path: str, cut: str) -> DataFrame:
    """Entries of an object of lists in any layout: what stands between two brackets that close outside the quotes."""
    # An escape never holds a bracket, so none is cut in two.
    return _bare(rejoined(_pieces(spark, path, cut), ROW_POS, in_json_string, cut))


def _text_entries(spark: SparkSession, path: str, cut: str) -> DataFrame:
    """Pieces of a one-line object of texts, with the quotes back that the cut took.

    A cut-off text may end in anything, so only the object's own braces are removed: the first piece alone starts
    with one, the last alone has one behind an unescaped quote.
    """
    value = F.regexp_replace("value", r'^\{(?=")', "")
    ended = F.regexp_replace(value, r'(?<!\\)((?:\\\\)*)"\s*\}\s*$', '$1"')
    # A brace right behind the quote that opens the text belongs to the text.
    body = F.when(value.rlike(r'^"?(?:[^"\\]|\\.)*": "\s*\}\s*$'), value).otherwise(ended)
    opened = F.when(F.col("body").startswith('"'), F.col("body")).otherwise(F.concat(F.lit('"'), "body"))
    # Closed are texts that end in an unescaped quote which is not the one that opens an empty text.
    closed = F.col("piece").rlike(r'(?<!\\)(?:\\\\)*"$') & ~F.col("piece").rlike(r'^"(?:[^"\\]|\\.)*": "$')
    piece = F.when(closed, F.col("piece")).otherwise(F.concat("piece", F.lit('"')))
    rows = _pieces(spark, path, cut).select(body.alias("body")).filter(~F.col("body").isin("", "{}"))
    return rows.select(opened.alias("piece")).select(piece.alias("piece"))


def _parsed(piece: Column, kind: str) -> Column:
    """An entry as a map; one that is no such entry fails the query, as a wrong layout would lose it otherwise."""
    value = F.from_json(F.concat(F.lit("{"), piece, F.lit("}")), kind)
    message = F.concat(F.lit("not an entry of this layout: "), F.substring(piece, 1, 80))
    return F.coalesce(value, F.raise_error(message).cast(kind))


def scan_pairs_json(spark: SparkSession, path: str, layout: str = "entries") -> DataFrame:
    """An object ``{d1: [d2, ...]}`` as ``(d1_id, pos, d2_id)``.

    The file is cut at entry ends, so a single large object is read by many tasks and never held in one. In the
    "entries" layout a list may go on in a later entry of the same d1, and its positions go on with it. The "compact"
    layout reads an object on one line, or on any lines; brackets, quotes and commas in ids are no ends.
    """
    read = _list_entries if layout == "compact" else _entries
    pieces = read(spark, path, PAIR_CUTS[layout])
    closed = F.when(F.col("piece").endswith("]"), F.col("piece")).otherwise(F.concat("piece", F.lit("]")))
    lists = pieces.select(F.explode(_parsed(closed, "map<string,array<string>>")).alias("d1_id", "d2_ids"), ROW_POS)
    if layout == "entries":
        lists = lists.join(_later_starts(lists), ["d1_id", ROW_POS], "left")
    else:
        lists = lists.withColumn("start", F.lit(0))
    rows = lists.select("d1_id", "start", F.posexplode("d2_ids").alias("at", "d2_id"))
    return rows.select("d1_id", (F.coalesce("start", F.lit(0)) + F.col("at")).cast("long").alias("pos"), "d2_id")


def _later_starts(lists: DataFrame) -> DataFrame:
    """Where the entries of a d1 with several of them start; only their sizes are ordered."""
    sizes = lists.select("d1_id", ROW_POS, F.size("d2_ids").alias("n"))
    several = sizes.groupBy("d1_id").agg(F.count("*").alias("entries")).filter("entries > 1").select("d1_id")
    earlier = Window.partitionBy("d1_id").orderBy(ROW_POS).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(several, "d1_id", "left_semi").withColumn("start", F.sum("n").over(earlier))
    return starts.select("d1_id", ROW_POS, "start")


def scan_records_json(spark: SparkSession, path: str, layout: str = "entries") -> DataFrame:
    """An object ``{id: text}`` as ``(record_id, text)``, cut at entry ends."""
    read = _text_entries if layout == "compact" else _entries
    piece = read(spark, path, RECORD_CUTS[layout])
    return piece.select(F.explode(_parsed(F.col("piece"), "map<string,string>")).alias("record_id", "text"))


def _write_object(entries: DataFrame, path: str) -> None:
    """Every part file becomes one valid JSON object with an entry per line."""

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = "{"
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                out = [opener + lines[0]] + [", " + line for line in lines[1:]]
                opener = ", "
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if opener == "{" else "}"])], names=["value"])

    entries.mapInArrow(frame, "value string").write.mode("overwrite").text(path)


def _entry(key: str, value: Column) -> Column:
    """``"key": value`` with the key quoted by the JSON writer."""
    return F.regexp_replace(F.to_json(F.create_map(F.col(key), value)), r"^\{|\}$", "")


def sink_pairs(pairs: DataFrame, path: str, list_rows: int = LIST_ROWS) -> None:
    """Write ``{d1: [d2, ...]}``, one entry for each d1; lists are in ``pos`` order.

    A very long list is put together from pieces of ``list_rows``, all in the one task that writes its entry.
    """
    lists = group_candidates(pairs, list_rows)
    lists = lists.repartitionByRange("d1_id").sortWithinPartitions("d1_id", "part")
    pieces = lists.select("d1_id", _entry("d1_id", F.col("d2_ids")).alias("value"), F.to_json("d2_ids").alias("ids"))
    _write_object(pieces.mapInArrow(_joined, "value string"), path)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each key from its pieces, which come one after the other."""
    key, held = None, []
    for batch in batches:
        out = []
        for d1_id, value, ids in zip(*(batch.column(c).to_pylist() for c in ("d1_id", "value", "ids"))):
            if held and d1_id == key:
                held.append(ids[1:-1])
                continue
            if held:
                out.append(", ".join(held) + "]")
            key, held = d1_id, [value.removesuffix("]")]
        yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string())], names=["value"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([", ".join(held) + "]"])], names=["value"])


def sink_records(entities: DataFrame, ids: DataFrame, path: str, null_token: str = "nan") -> None:
    """Write ``{id: text}`` of the wanted records; ``entities`` carries its row positions."""
    _write_object(record_texts(entities, ids, null_token).select(_entry("record_id", F.col("text")).alias("value")), path)


def record_texts(entities: DataFrame, ids: DataFrame, null_token: str = "nan") -> DataFrame:
    """``(record_id, text)`` of the wanted records, serialised from all attributes."""
    id_col = entities.columns[0]
    rows = records_of_interest(entities, ids, id_col, ROW_POS)
    text = serialize_record(attribute_columns(entities), null_token)
    return rows.select(F.col(id_col).alias("record_id"), text.alias("text"))


def dataset_from_path(path: Column | str) -> Column:
    """The data set named by the last path element that starts with D."""
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(F.lit("D"), F.regexp_extract(path, r"^.*/D([^/]*)", 1))
