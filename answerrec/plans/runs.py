"""Flows as runs: each reads the newest finished run of those before it and writes its own.

Below a root folder lie `datasets`, `users`, `questions`, `models/<name>`, `reports` and
`predictions`; every one holds a run per folder. A run that fails leaves nothing that a
reader would take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerrec.operators.keyrank import Keybert
from answerrec.operators.tfidf import Tfidf
from answerrec.plans.flows import TrainingResult, split_flow, text_flow, training_flow
from answerrec.session import materialize
from answerrec.sources.models import save_model
from answerrec.sources.tables import read_latest_run, run_name, write_run


def run_split(answers: DataFrame, questions: DataFrame, root: str, **options) -> str:
    """Run the split flow; returns the run's name."""
    run_id = run_name()
    write_run(split_flow(answers, questions, **options), f"{root}/datasets", run_id)
    return run_id


def run_text(
    users: DataFrame, questions: DataFrame, root: str, options: Tfidf | Keybert | None = None, extractor: str = "keybert"
) -> str:
    """Run the text flow; users and questions with tags are written under one name."""
    run_id = run_name()
    with_tags, titled = text_flow(users, questions, options, extractor)
    write_run(with_tags, f"{root}/users", run_id)
    write_run(titled, f"{root}/questions", run_id)
    return run_id


def latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_latest_run(spark, f"{root}/{name}").drop("run_id")


def run_training(spark: SparkSession, root: str, **options) -> tuple[str, TrainingResult]:
    """Train on the newest runs of the other two flows; models, report and predictions are saved."""
    run_id = run_name()
    inputs = {name: materialize(latest(spark, root, name), name) for name in ("datasets", "questions", "users")}
    result = training_flow(inputs["datasets"], inputs["questions"], inputs["users"], **options)
    for name, trained in result.models.items():
        save_model(trained, f"{root}/models/{name}", trained.options.epochs, run_id)
    write_run(result.report, f"{root}/reports", run_id)
    write_run(result.predictions, f"{root}/predictions", run_id)
    return run_id, result
