"""Readers and writers."""

import datetime as dt
import json

import pytest

from answerrec.errors import InputDataError, InvalidTag
from answerrec.sources import tables

ANSWERS = [
    {"answer_id": "1", "user_id": "5", "question_id": "9", "text": "<p>a</p>", "date": "2020-02-23T10:41:38.677", "score": "0"},
    {"answer_id": "2", "user_id": "5", "question_id": "8", "text": "b", "date": "2020-02-23T11:08:28", "score": "-3"},
    {"answer_id": "3", "user_id": "x", "question_id": "8", "text": "c", "date": "bad", "score": "1"},
]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "answers.json"
    path.write_text("\n".join(map(json.dumps, ANSWERS)))
    df = tables.read_json_lines(spark, str(path), "answers")
    rows = {r.answer_id: r for r in df.collect()}
    assert (len(rows), len(df.columns)) == (3, 6)
    assert rows[1].date == dt.datetime(2020, 2, 23, 10, 41, 38, 677000)
    assert rows[2].score == -3 and rows[3].user_id is None and rows[3].date is None


def test_missing_input(spark, tmp_path):
    with pytest.raises(InputDataError):
        tables.read_json_lines(spark, str(tmp_path / "none.json"), "answers")
    with pytest.raises(InputDataError):
        tables.read_json_lines(spark, str(tmp_path), "nothing")
    with pytest.raises(InputDataError):
        tables.read_csv(spark, str(tmp_path / "none.csv"), "a int")


def test_csv_keeps_quotes_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a", b', [1, 2])], "id long, t string, users array<long>")
    path = tables.write_table(df, str(tmp_path / "out"), "csv")
    row = tables.read_csv(spark, path, "id long, t string, users string").first()
    assert (row.id, row.t, json.loads(row.users)) == (1, 'say "a", b', [1, 2])


def test_delimited(spark, tmp_path):
    path = tmp_path / "books.csv"
    path.write_bytes("ISBN;Book-Author\n1;René\n2;B;extra\n".encode() + b"3;Zo\xe9\n")
    rows = tables.read_delimited(spark, str(path), ["ISBN", "Book-Author"]).collect()
    assert [(r["ISBN"], r["Book-Author"]) for r in rows] == [("1", "René"), ("2", "B"), ("3", "Zo")]


def test_writers_check_their_input(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(InvalidTag):
        tables.write_table(df, str(tmp_path / "a"), "pkl")
    with pytest.raises(ValueError):
        tables.write_table({"a": 1}, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        tables.write_values(spark, df, str(tmp_path / "a"))
    path = tables.write_values(spark, {"auc": 0.5}, str(tmp_path / "v"))
    assert json.loads(spark.read.text(path).first().value) == {"auc": 0.5}


def test_latest_run_ignores_unfinished(spark, tmp_path):
    root = str(tmp_path / "runs")
    with pytest.raises(InputDataError):
        tables.read_latest_run(spark, root)
    tables.write_run(spark.range(1), root, "1")
    tables.write_run(spark.range(2), root, "2")
    (tmp_path / "runs" / "run_id=3").mkdir()
    latest = tables.read_latest_run(spark, root)
    assert latest.count() == 2 and latest.first().run_id == "2"


def test_predictions(spark, tmp_path):
    ranked = spark.createDataFrame([(1, [4, 2])], "question_id long, user_ids array<long>")
    path = tables.write_predictions(ranked, str(tmp_path))
    assert spark.read.parquet(path).first().user_ids == [4, 2]
