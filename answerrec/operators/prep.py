"""From answers and questions to labelled positive interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerrec.errors import need_columns
from answerrec.operators.skew import attach
from answerrec.session import materialize

ANSWER_COLUMNS = ["answer_id", "user_id", "question_id", "score", "date"]


def accepted_flag(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Add `accepted_answer_id` and `is_accepted_answer`: 1 if a question names the answer."""
    need_columns(answers.columns, "answer_id")
    need_columns(questions.columns, "accepted_answer_id")
    accepted = questions.select("accepted_answer_id").dropna().distinct()
    joined = answers.join(accepted, F.col("answer_id") == F.col("accepted_answer_id"), "left")
    return joined.withColumn("is_accepted_answer", F.col("accepted_answer_id").isNotNull().cast("int"))


def rows_per_key(df: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Non-null `counted` values per non-null key, e.g. answers per question."""
    need_columns(df.columns, key, counted)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(counted).alias(name))


def with_count(df: DataFrame, source: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Attach the count per key taken from `source`; rows with a null key drop out."""
    return attach(df, rows_per_key(source, key, counted, name), key, size=name)


def is_positive(threshold: int = 1, take_accepted: bool = True) -> Column:
    """Score reaches the threshold, or (optionally) the answer was accepted."""
    reached = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return reached | (F.col("is_accepted_answer") == 1) if take_accepted else reached


def positive_interactions(df: DataFrame, threshold: int = 1, take_accepted: bool = True) -> DataFrame:
    need_columns(df.columns, "answer_id", "score", *(["is_accepted_answer"] if take_accepted else []))
    return df.where(is_positive(threshold, take_accepted))


def negative_interactions(df: DataFrame, threshold: int = 1, take_accepted: bool = True) -> DataFrame:
    """Answers that are not positive; those without a score are among them."""
    need_columns(df.columns, "answer_id", "score", *(["is_accepted_answer"] if take_accepted else []))
    return df.where(~is_positive(threshold, take_accepted))


def class_thresholds(per_question: DataFrame, metric: str, high: float, medium: float) -> DataFrame:
    """One row `(high, medium)` of interpolated percentiles of a count over questions.

    Equal counts are merged first. Distinct counts k sum to at most the number of answers
    N, so at most sqrt(2·N) values reach the final percentile, however large N is.
    """
    merged = per_question.groupBy(metric).agg(F.count(F.lit(1)).alias("_freq"))
    pair = F.percentile(metric, F.array(F.lit(high), F.lit(medium)), F.col("_freq"))
    return merged.agg(pair.alias("_p")).select(F.col("_p")[0].alias("high"), F.col("_p")[1].alias("medium"))


def label_questions(
    per_question: DataFrame, metric: str = "number_answers_per_question", high: float = 0.99, medium: float = 0.7
) -> DataFrame:
    """Add `question_label` (High, Medium, Low) to a table with one row per question."""
    if not 0 <= medium <= high <= 1:
        raise ValueError("percentiles must satisfy 0 <= medium <= high <= 1")
    need_columns(per_question.columns, metric)
    limits = class_thresholds(per_question, metric, high, medium)
    label = (
        F.when(F.col(metric) >= limits.select("high").scalar(), "High")
        .when(F.col(metric) >= limits.select("medium").scalar(), "Medium")
        .otherwise("Low")
    )
    return per_question.withColumn("question_label", label)


def question_activity(
    answers: DataFrame, questions: DataFrame, threshold: int = 1, take_accepted: bool = True
) -> DataFrame:
    """One row per question with a positive answer: all its answers counted, its positive
    answers counted, and its label."""
    return flagged_activity(accepted_flag(answers.select(*ANSWER_COLUMNS), questions), threshold, take_accepted)


def flagged_activity(flagged: DataFrame, threshold: int = 1, take_accepted: bool = True) -> DataFrame:
    """`question_activity` of answers that have their accepted flag."""
    counted = (
        flagged.where(F.col("question_id").isNotNull())
        .groupBy("question_id")
        .agg(
            F.count("answer_id").alias("number_answers_per_question"),
            F.count_if(is_positive(threshold, take_accepted)).alias("positive_answers"),
        )
    )
    return label_questions(counted.where(F.col("positive_answers") > 0))


def preprocess(answers: DataFrame, questions: DataFrame, threshold: int = 1, take_accepted: bool = True) -> DataFrame:
    """Positive answers with their question's activity label, ready to be split.

    The answers meet their flag once: the flagged rows are written, since the counts and the
    result both read them, and so are the counts, which the join reads for its hot keys too.
    """
    need_columns(answers.columns, *ANSWER_COLUMNS)
    flagged = materialize(accepted_flag(answers.select(*ANSWER_COLUMNS), questions), "flagged")
    activity = materialize(flagged_activity(flagged, threshold, take_accepted), "activity")
    positive = positive_interactions(flagged, threshold, take_accepted)
    return attach(positive, activity, "question_id", size="positive_answers").drop("positive_answers")


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Keep one row per key, the first in `order`; partial results combine before the shuffle."""
    need_columns(df.columns, key, *order)
    row = F.struct(*df.columns)
    picked = df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in `keys`."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `keys`; a null key is kept, unlike with NOT IN."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def tag_columns(df: DataFrame, keywords: str = "keywords", top_n: int = 5) -> DataFrame:
    """Spread a keyword array over `tag1..tagN`, null where the array is shorter."""
    tags = [F.get(F.col(keywords), F.lit(i)).alias(f"tag{i + 1}") for i in range(top_n)]
    return df.select("*", *tags)


def distinct_values(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """Distinct non-null values over several columns, as strings."""
    stacked = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias(name))
    return stacked.where(F.col(name).isNotNull()).distinct()


def pair_weights(candidates: DataFrame, weights: DataFrame, weight: str = "weight") -> DataFrame:
    """Pairs of question and user with their known weight, 0 where none is known.

    `weights` has one row per pair, so no key of the join is hot.
    """
    keys = ["question_id", "user_id"]
    known = weights.select(*keys, weight)
    return candidates.join(known, keys, "left").withColumn(weight, F.coalesce(weight, F.lit(0.0)))


def unpivot_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Columns `model_<metric>_<stage>` to rows `(metric, stage, value)` with display names."""
    columns = [c for c in df.columns if c not in keys]
    long = df.unpivot(keys, columns, "name", "value")
    part = F.split("name", "_")
    return long.select(*keys, display_name(part[1]).alias("metric"), part[2].alias("stage"), "value")


def display_name(metric: Column) -> Column:
    return (
        F.when(metric == "auc", "ROC AUC")
        .when(metric.isin("precision", "prec"), "Precision")
        .when(metric.isin("recall", "rec"), "Recall")
        .otherwise(metric)
    )
