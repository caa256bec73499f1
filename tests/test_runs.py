"""Saved models, resumed training, and flows that start from the newest runs."""

import os
import random

import pytest

from answerrec.errors import InputDataError
from answerrec.operators import model
from answerrec.operators.features import entity_features
from answerrec.plans import runs
from answerrec.session import discard, materialize
from answerrec.sources import models, tables


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(9)
    pairs = {(q, 3 * rng.randrange(6) + q % 3) for q in range(30) for _ in range(4)}
    train = spark.createDataFrame([(q, u, 1.0) for q, u in sorted(pairs)], "question_id long, user_id long, weight double").cache()
    questions, users = spark.range(30).withColumnRenamed("id", "question_id"), spark.range(18)
    options = model.Options(components=3, loss="bpr", epochs=2, batches=2)
    return train, model.new_model(entity_features(questions, "question_id"), entity_features(users, "id"), options)


def values(trained):
    return {r.feature: [round(x, 9) for x in [*r.vector, *r.squares]] for r in trained.factors.collect()}


def test_a_loaded_model_is_the_saved_one_and_goes_on(spark, small, tmp_path):
    train, start = small
    root = str(tmp_path)
    with pytest.raises(InputDataError):
        models.load_model(spark, root)
    once = model.fit(start, train, epochs=1)
    name = models.save_model(once, root, epochs=1)
    loaded = models.load_model(spark, root)
    assert (loaded.run_id, loaded.epochs, loaded.model.options) == (name, 1, start.options)
    assert values(loaded.model) == values(once)
    resumed = models.resume(spark, root, train, epochs=1)
    assert resumed.epochs == 2 and values(resumed.model) == values(model.fit(start, train, epochs=2))
    assert models.load_model(spark, root, name).epochs == 1
    with pytest.raises(InputDataError):
        models.load_model(spark, root, "none")
    with pytest.raises(InputDataError):
        models.save_model(once, root, run_id=name)


def test_a_killed_run_leaves_the_version_before_it(spark, small, tmp_path, monkeypatch):
    _, start = small
    root = str(tmp_path)
    for name in "abc":
        models.save_model(start, root, epochs=ord(name), run_id=name)
    monkeypatch.setattr(models, "write_values", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        models.save_model(start, root, run_id="bb")
    with pytest.raises(ZeroDivisionError):
        models.save_model(start, root, run_id="d")
    monkeypatch.undo()
    assert models.versions(spark, root) == ["a", "b", "c"] and models.load_model(spark, root).epochs == ord("c")
    assert models.drop_versions(spark, root, keep=1) == ["a", "b", "bb"]  # the run after the newest may still be writing
    assert models.versions(spark, root) == ["c"] and sorted(os.listdir(root)) == ["run_id=c", "run_id=d"]
    with pytest.raises(ValueError):
        models.drop_versions(spark, root, keep=0)


def test_training_leaves_few_tables(spark, small, tmp_path):
    train, start = small
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    trained = model.fit(start, train)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"factors"} and len(set(os.listdir(folder)) - before) == 1
    assert start.factors.count() == trained.factors.count()
    best, trace = model.fit_tracked(start, train, train)
    assert trace.count() == 4 and best.factors.count() == start.factors.count()
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("factors")]) <= 3


def test_discard(spark):
    stored = materialize(spark.range(3), "three")
    path = stored.stored_at
    assert os.path.exists(path)
    discard(spark.range(1), stored, stored)
    assert not os.path.exists(path)


def test_flows_start_from_the_newest_runs(spark, tmp_path):
    rng = random.Random(10)
    root = str(tmp_path)
    rows = [(i, rng.randrange(12), rng.randrange(25), f"text {i}", None, rng.choice([0, 1, 2])) for i in range(400)]
    answers = spark.createDataFrame(rows, "answer_id long, user_id long, question_id long, text string, date timestamp, score int")
    answers = answers.selectExpr("answer_id", "user_id", "question_id", "timestamp'2024-01-01' + make_interval(0,0,0,cast(answer_id as int)) as date", "score")
    words = "table join window shuffle filter sort merge hash scan plan".split()
    questions = spark.createDataFrame([(q, " ".join(rng.choices(words, k=6)), None, None) for q in range(25)], "question_id long, title string, owner_user_id long, accepted_answer_id long")
    users = spark.createDataFrame([(u, u, 1, 2, 3, "x", " ".join(rng.choices(words, k=9)) if u % 3 else None) for u in range(12)], "id long, reputation long, up_votes long, down_votes long, views long, location string, about_me string")
    with pytest.raises(InputDataError):
        runs.run_training(spark, root)
    runs.run_split(answers.where("answer_id < 200"), questions, root)
    runs.run_split(answers, questions, root)
    runs.run_text(users, questions, root)
    newest = runs.latest(spark, root, "datasets")
    assert newest.count() > 200
    options = model.Options(components=2, epochs=1, batches=1)
    name, result = runs.run_training(spark, root, options=options)
    assert models.load_model(spark, f"{root}/models/{result.best}").run_id == name
    assert tables.read_latest_run(spark, f"{root}/reports").count() == result.report.count()
    predicted = tables.read_latest_run(spark, f"{root}/predictions").collect()
    assert predicted and all(len(set(r.user_ids)) == len(r.user_ids) <= 20 for r in predicted)
