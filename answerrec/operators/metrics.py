"""Ranking metrics from the positions of held-out users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerrec.errors import BadEvaluationMetric

METRICS = ("precision", "recall", "auc")


def need_metrics(names: Sequence[str]) -> list[str]:
    for name in names:
        if name not in METRICS:
            raise BadEvaluationMetric(name, METRICS)
    return list(names)


def question_metrics(positions: DataFrame, k: int = 10) -> DataFrame:
    """Rows `(question_id, auc, precision, recall)`, one per question with held-out users.

    The AUC counts a tie as one half. It needs no user pairs: the mean position of the
    held-out users among all candidates determines it. Without a negative it is 0.5.
    """
    held = F.count(F.lit(1))
    negatives = F.max("candidates") - held
    middle = F.sum(F.col("below") + (F.col("equal") + 1) / 2)
    auc = (middle - held * (held + 1) / 2) / (held * negatives)
    hits = F.count_if(F.col("ahead") < k)
    return positions.groupBy("question_id").agg(
        F.when(negatives > 0, auc).otherwise(F.lit(0.5)).alias("auc"),
        (hits / F.lit(k)).alias("precision"),
        (hits / held).alias("recall"),
    )


def mean_metrics(per_question: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Rows `(metric, value)`: means over questions."""
    names = need_metrics(metrics)
    return per_question.agg(*[F.avg(n).alias(n) for n in names]).unpivot([], names, "metric", "value")


def metrics_by_segment(per_question: DataFrame, segments: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Rows `(data_type, metric, value)` for each segment and for all questions.

    `segments` has one row per question with its `data_type`.
    """
    names = need_metrics(metrics)
    joined = per_question.join(segments.select("question_id", "data_type"), "question_id")
    parts = joined.groupBy("data_type").agg(*[F.avg(n).alias(n) for n in names])
    parts = parts.unpivot(["data_type"], names, "metric", "value")
    return parts.unionByName(mean_metrics(per_question, names).withColumn("data_type", F.lit("all")))


def best_model(results: DataFrame) -> DataFrame:
    """The `(model, auc)` row with the highest AUC; the first name wins a tie."""
    row = F.struct("model", "auc")
    return results.agg(F.min_by(row, F.struct(-F.col("auc"), F.col("model"))).alias("r")).select("r.*")


def best_epoch(trace: DataFrame, metric: str = "auc") -> DataFrame:
    """The earliest epoch with the highest validation metric: `(epoch, value)`."""
    need_metrics([metric])
    rows = trace.where((F.col("stage") == "validation") & (F.col("metric") == metric))
    row = F.struct("epoch", "value")
    return rows.agg(F.min_by(row, F.struct(-F.col("value"), F.col("epoch"))).alias("r")).select("r.*")


def last_value(trace: DataFrame, metric: str = "auc", stage: str = "validation") -> DataFrame:
    """The newest value of a metric: `(value)`."""
    need_metrics([metric])
    rows = trace.where((F.col("stage") == stage) & (F.col("metric") == metric))
    return rows.agg(F.max_by("value", "epoch").alias("value"))
