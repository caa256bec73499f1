"""Invariants of the split, on the given tables and on a table with one huge question."""

import pytest
from pyspark.sql import functions as F

from answerrec.errors import InvalidTag, MissingAttribute
from answerrec.operators import prep, split
from answerrec.plans import views
from answerrec.plans.split_queries import written


@pytest.fixture(scope="module")
def assembled(spark, sf_dir):
    return split.split_datasets(written(spark, sf_dir)).cache()


def test_no_leak_and_no_loss(spark, sf_dir, assembled):
    assert split.leaked_answers(assembled).count() == 0
    assert assembled.count() == assembled.select("answer_id").distinct().count() == written(spark, sf_dir).count()


def test_warm_questions_stay_in_training(assembled):
    data = split.as_datasets(assembled)
    warm = assembled.where("data_type = 'warm_start'").select("question_id").distinct()
    assert warm.count() > 0
    assert warm.join(data.training, "question_id", "left_anti").count() == 0


def test_cells_hold_out_whole_questions(spark, sf_dir):
    rows = written(spark, sf_dir)
    assert split.leave_last(rows, rate_of="cells").count() == rows.count()
    with pytest.raises(InvalidTag):
        split.leave_last(rows, rate_of="columns")


def test_sizes_and_seed(spark, sf_dir):
    rows = written(spark, sf_dir)
    questions = rows.select("question_id").distinct().count()
    cold = split.cold_questions(rows)
    held = -(-questions * 75 // 1000)
    assert cold.count() == held
    assert cold.where("split = 'validation'").count() == -(-held // 2)
    again = split.cold_questions(rows.repartition(3))
    assert again.exceptAll(cold).count() == 0
    assert split.cold_questions(rows, seed=1).exceptAll(cold).count() > 0


def test_leave_last_on_one_huge_question(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("answer_id"),
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("question_id"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 977 as int), 0)").alias("date"),
    )
    kept = split.leave_last(rows, 0.3)
    huge = rows.where("question_id = 1")
    mine = {r.answer_id for r in kept.where("question_id = 1").collect()}
    expected = sorted(((r.date, r.answer_id) for r in huge.collect()), reverse=True)
    assert mine == {i for _, i in expected[: -(-len(expected) * 3 // 10)]}
    assert kept.where("question_id <> 1").count() == rows.where("question_id <> 1").count()


def test_reduce_training_and_samples(spark):
    rows = spark.range(100).selectExpr("id as answer_id", "if(id < 80, 'Low', 'High') as question_label")
    kept = split.reduce_training(rows, keep=0.5)
    counts = {r.question_label: r["count"] for r in kept.groupBy("question_label").count().collect()}
    assert counts == {"Low": 40, "High": 10}
    assert split.reduce_training(rows, 0) is rows
    assert split.sample_fraction(rows, "answer_id", 0.25, 1).count() == 25


def test_missing_columns(spark, sf_dir):
    answers = views.answers(spark, sf_dir)
    with pytest.raises(MissingAttribute):
        prep.positive_interactions(answers)
    with pytest.raises(MissingAttribute):
        prep.label_questions(answers, "nothing")
    with pytest.raises(ValueError):
        prep.label_questions(answers, "score", high=0.5, medium=0.9)


def test_null_scores_are_negative(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, 5, 0), (3, None, 1)], "answer_id long, score int, is_accepted_answer int")
    assert {r.answer_id for r in prep.positive_interactions(rows).collect()} == {2, 3}
    assert {r.answer_id for r in prep.negative_interactions(rows).collect()} == {1}
