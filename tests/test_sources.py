import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlink.operators import embed
from twinlink.plans.blocking import run_blocking
from twinlink.plans.evaluation import write_report
from twinlink.session import scratch_path
from twinlink.sources import files, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


RECORDS = {"1": 'plain "quoted", text', "2": "ends in a quote\"", "3": "a } brace, and\nline", "4": "", "5": "back\\slash", "6": "ends\\",
           "7": "{open, ", "8": "close\"}", "9": "}", "10": "colon: "}
PAIRS = {"1": [12, 15], "2": [3], "30": [1, 2, 3]}


@pytest.mark.parametrize("layout, indent", [("entries", 4), ("compact", None)])
def test_record_objects(spark, tmp_path, layout, indent):
    path = tmp_path / "records.json"
    path.write_text(json.dumps(RECORDS, indent=indent))
    assert rows(files.scan_records_json(spark, str(path), layout)) == sorted(RECORDS.items())


def test_compact_pair_object(spark, tmp_path):
    path = tmp_path / "pairs.json"
    path.write_text(json.dumps(PAIRS))
    want = sorted((d1, i, str(d2)) for d1, ids in PAIRS.items() for i, d2 in enumerate(ids))
    assert rows(files.scan_pairs_json(spark, str(path), "compact")) == want


@pytest.mark.parametrize("list_rows", [1000, 2])
def test_pairs_through_a_file(spark, list_rows):
    want = sorted((d1, i, str(d2)) for d1, ids in PAIRS.items() for i, d2 in enumerate(ids))
    df = spark.createDataFrame(want, "d1_id string, pos long, d2_id string").repartition(3)
    path = scratch_path(spark, "pairs.json")
    files.sink_pairs(df, path, list_rows)
    assert rows(files.scan_pairs_json(spark, path)) == want


def test_written_objects_are_valid_json(spark, tmp_path):
    df = spark.createDataFrame(sorted(RECORDS.items()), "id string, text string").withColumn("row_pos", F.lit(1))
    path = str(tmp_path / "out")
    files.sink_records(df, df.select("id"), path)
    got = {}
    for part in (tmp_path / "out").glob("part-*"):
        got.update(json.loads(part.read_text()))
    assert got == RECORDS


def test_last_ground_truth_row_counts(spark, tmp_path):
    path = tmp_path / "gt.csv"
    path.write_text("D1|D2\n1|a\n2|b\n1|c\n")
    assert rows(files.scan_ground_truth(spark, str(path))) == [("1", "c"), ("2", "b")]


def test_entities_and_their_texts(spark, tmp_path):
    path = tmp_path / "D3" / "amazonclean.csv"
    path.parent.mkdir()
    path.write_text("id#title#price\n7#first#1.50\n7#second#2\n8##3\n9#x#4\n")
    df = files.scan_entities(spark, str(path), ["id", "title", "price"], "#", with_position=True)
    assert files.attribute_columns(df) == ["title", "price"]
    ids = spark.createDataFrame([("7",), ("8",), ("100",)], "id string")
    assert rows(files.record_texts(df, ids)) == [("7", "first 1.50"), ("8", "nan 3")]
    assert df.select(files.dataset_from_path(F.col("row_pos.file"))).first()[0] == "D3"


def test_required_columns_are_checked(spark):
    path = scratch_path(spark, "embeddings")
    tables.embeddings_table(spark, path)
    bad = spark.createDataFrame([(None, "d1", [1.0], "m")], "record_id string, dataset string, embeddings array<float>, model string")
    with pytest.raises(Exception, match="record_id must not be null"):
        tables.embeddings_append(bad.withColumn("created_at", F.current_timestamp()), path)


def texts(spark, items):
    return spark.createDataFrame(items, "record_id string, text string")


def test_embedding_resumes(spark):
    path = scratch_path(spark, "embeddings")
    done = tables.embeddings_table(spark, path)
    part = texts(spark, [("1", "one two"), ("2", "")])
    full = texts(spark, [("1", "one two"), ("2", ""), ("3", "three")])
    for records, total in ((part, 2), (full, 3), (full, 3)):
        rows_ = embed.embed_records(records, "d1", "words", embed.hashed_words, tables.scan_embeddings(spark, path))
        tables.embeddings_append(rows_, path)
        done = tables.scan_embeddings(spark, path)
        assert done.count() == total
    sums = {r.record_id: sum(r.embeddings) for r in done.collect()}
    assert sums == {"1": 2.0, "2": 0.0, "3": 1.0}


def test_task_embedding_resumes(spark):
    path = scratch_path(spark, "task")
    tables.task_embeddings_table(spark, path)
    pairs = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b"), ("2", 0, "a")], "d1_id string, pos long, d2_id string")
    d1, d2 = texts(spark, [("1", "x"), ("2", "y")]), texts(spark, [("a", "A"), ("b", "B")])
    for todo, total in ((pairs.filter("d1_id = '1'"), 3), (pairs, 5), (pairs, 5)):
        made = embed.embed_with_task(todo, d1, d2, "words", embed.hashed_words, tables.scan_task_embeddings(spark, path))
        tables.task_embeddings_append(made, path)
        assert tables.scan_task_embeddings(spark, path).count() == total


def test_encoder_is_made_once_per_task(spark, tmp_path):
    made = tmp_path / "made"

    def factory():
        with open(made, "a") as f:
            f.write("x")
        return lambda items: np.ones((len(items), 2))

    df = texts(spark, [(str(i), "t") for i in range(50)]).coalesce(1)
    assert embed.encode(df, factory, batch_rows=7).count() == 50
    assert made.read_text() == "x"


def test_unknown_loader_family(spark):
    with pytest.raises(ValueError, match="unsupported model"):
        embed.loader_family("google/Gemma-Embeddings-v1.0")


def test_blocking_from_files(spark, tmp_path):
    """Two small shops: the same goods under other ids are each other's nearest."""
    goods = ["red garden chair", "blue kitchen table", "green desk lamp", "small steel spoon"]
    for name, sep_rows in (("buy", enumerate(goods)), ("abt", enumerate(reversed(goods)))):
        (tmp_path / f"{name}.csv").write_text("id|title\n" + "".join(f"{i}|{g}\n" for i, g in sep_rows))
    d1, d2 = (files.scan_entities(spark, str(tmp_path / f"{n}.csv"), ["id", "title"], with_position=True) for n in ("buy", "abt"))
    out = run_blocking(d1, d2, embed.hashed_words, scratch_path(spark, "D2"), k=1)
    assert rows(files.scan_pairs_json(spark, out.pairs_path)) == [(str(i), 0, str(3 - i)) for i in range(4)]
    assert dict(rows(files.scan_records_json(spark, out.d1_records_path))) == {str(i): g for i, g in enumerate(goods)}


def test_report_file(spark):
    log = spark.createDataFrame(
        [("1", "a", "m", "P", "r"), ("2", None, "m", "P", "r"), ("2", None, "m", "P", "silent")],
        "d1_id string, result string, model string, prompt_type string, run_id string",
    ).withColumn("inserted_at", F.current_timestamp())
    gt = spark.createDataFrame([("1", "a"), ("2", "b")], "d1_id string, d2_id string")
    path = scratch_path(spark, "report")
    write_report(log, gt, path)
    got = {r["Run ID"]: r for r in spark.read.option("header", True).csv(path).collect()}
    assert got["r"]["F1"].startswith("66.66") and got["silent"]["F1"] == "0.0"
    assert list(got["r"].asDict())[:3] == ["Model", "Prompt Type", "Run ID"]


def test_quoted_entity_values(spark, tmp_path):
    """Separators, doubled quotes and line breaks inside quotes belong to the value."""
    path = tmp_path / "quoted.csv"
    path.write_text('id|title|price\n1|"Sony 17"" monitor|x"|9\n2|"two\nlines"|8\n')
    df = files.scan_entities(spark, str(path), ["id", "title", "price"], multi_line=True)
    assert sorted(map(tuple, df.collect())) == [("1", 'Sony 17" monitor|x', "9"), ("2", "two\nlines", "8")]


def test_another_layout_fails(spark, tmp_path):
    pairs, records = tmp_path / "pairs.json", tmp_path / "records.json"
    pairs.write_text('{\n  "a": [\n    "x",\n    "y"\n  ]\n}\n')
    records.write_text('{\n  "a": "one",\n  "b": "two"\n}\n')
    with pytest.raises(Exception, match="not an entry"):
        files.scan_pairs_json(spark, str(pairs), "entries").collect()
    with pytest.raises(Exception, match="not an entry"):
        files.scan_records_json(spark, str(records), "compact").collect()


def test_names_are_those_of_the_header(spark, tmp_path):
    path = tmp_path / "buy.csv"
    path.write_text("id|title|price\n1|a|2\n2|b|3\n")
    assert files.scan_entities(spark, str(path)).columns == ["id", "title", "price"]
    assert files.attribute_columns(files.scan_entities(spark, str(path), with_position=True)) == ["title", "price"]
    assert rows(files.scan_entities(spark, str(path), ["id", "title", "price"])) == [("1", "a", "2"), ("2", "b", "3")]
    for wrong in (["title", "id", "price"], ["id", "name", "price"], ["id", "title"], ["id", "title", "price", "more"]):
        with pytest.raises(Exception, match="(?i)header|schema"):
            files.scan_entities(spark, str(path), wrong).collect()


def test_every_file_has_the_header(spark, tmp_path):
    folder = tmp_path / "buy"
    folder.mkdir()
    (folder / "a.csv").write_text("id|title\n1|a\n")
    (folder / "b.csv").write_text("title|id\nb|2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.scan_entities(spark, str(folder), ["id", "title"]).collect()


def test_a_ground_truth_has_two_columns(spark, tmp_path):
    path = tmp_path / "gt.csv"
    path.write_text("left|right|score\n1|a|0.5\n")
    with pytest.raises(ValueError):
        files.scan_ground_truth(spark, str(path))


def test_one_run_is_dropped(spark):
    """Also where its names need escaping in a path; a run that is not there drops nothing."""
    path = scratch_path(spark, "log")
    tables.results_table(spark, path)
    runs = [("org/a b%3A", "r=1"), ("org/a b%3A", "r=1 "), ("org", "r=1"), ("é:x", "*")]
    for model, run_id in runs:
        row = spark.range(2).select(
            F.col("id").cast("string").alias("d1_id"), F.array(F.lit("b")).alias("d2_candidates_id"), F.lit("b").alias("result"),
            F.lit("VALID").alias("request_status"), F.current_timestamp().alias("inserted_at"), F.lit("P").alias("prompt_type"),
            F.lit("G").alias("prompt_group"), F.lit(model).alias("model"), F.lit(run_id).alias("run_id"),
        )
        tables.results_append(row, path)
    left = list(runs)
    for gone in [("org", "none"), ("org/a b%3A", "r=1"), ("é:x", "*")]:
        tables.drop_run(spark, path, *gone)
        left = [r for r in left if r != gone]
        got = tables.scan_results(spark, path).groupBy("model", "run_id").count().collect()
        assert sorted(map(tuple, got)) == sorted((*r, 2) for r in left)


def test_ground_truth_rows_are_grouped_without_their_file_names(spark, tmp_path):
    for name, rows in (("b", "x|1\ny|2"), ("a", "x|3\nz|4")):
        (tmp_path / f"{name}.csv").write_text(f"D1|D2\n{rows}\n")
    gt = files.scan_ground_truth(spark, str(tmp_path))
    assert {tuple(r) for r in gt.collect()} == {("x", "1"), ("y", "2"), ("z", "4")}
    grouped = gt._jdf.queryExecution().optimizedPlan().child().schema().json()
    assert "file_no" in grouped and '"file"' not in grouped
