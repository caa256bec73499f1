"""Id dictionaries, interaction pairs and row-normalised feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerrec.errors import InputDataError, need_columns, need_option
from answerrec.operators.prep import distinct_values
from answerrec.operators.skew import rank_by_hash

USER_NUMBERS = ["reputation", "up_votes", "down_votes", "views"]


def dense_ids(entities: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Number distinct keys 0..n-1 in hash order, counted per bucket and not in one task."""
    need_columns(entities.columns, key)
    distinct = entities.select(key).where(F.col(key).isNotNull()).distinct()
    return rank_by_hash(distinct, 0, key).select(key, (F.col("_rank") - 1).alias(name))


def log_bucket(value: Column) -> Column:
    """Signed power-of-two bucket of a number, so that near values share a feature."""
    size = F.floor(F.log2(F.abs(value) + 1))
    return F.when(value < 0, -size).otherwise(size)


def feature_names(columns: Sequence[str], numbers: Sequence[str] = (), names: str = "qualified") -> list[Column]:
    """One feature name per column: `column=value`, numbers by bucket; or the raw value,
    where equal values of different columns are one feature."""
    need_option(names, ["qualified", "raw"])
    if names == "raw":
        return [F.col(c).cast("string") for c in columns]
    # all tag columns are one namespace: a keyword means the same at any position
    return [
        F.concat(F.lit(f"{c}="), log_bucket(F.col(c)).cast("string"))
        if c in numbers
        else F.concat(F.lit("tag=" if c.startswith("tag") else f"{c}="), F.col(c).cast("string"))
        for c in columns
    ]


def feature_vocabulary(entities: DataFrame, columns: Sequence[str], numbers: Sequence[str] = (), names: str = "qualified") -> DataFrame:
    """Distinct feature names of a table."""
    if not columns:
        raise ValueError("feature columns must be given")
    labels = feature_names(columns, numbers, names)
    named = entities.select(*[label.alias(f"f{i}") for i, label in enumerate(labels)])
    return distinct_values(named, named.columns, "feature")


def entity_features(
    entities: DataFrame,
    key: str,
    columns: Sequence[str] = (),
    numbers: Sequence[str] = (),
    names: str = "qualified",
    identity: bool = True,
) -> DataFrame:
    """Rows `(entity_id, feature, weight)`; the weights of an entity sum to 1.

    An entity's own id is a feature too; a feature that occurs twice weighs double. All
    values of an entity stand in one row, so no shuffle is needed.
    """
    need_columns(entities.columns, key, *columns)
    labels = list(feature_names(columns, numbers, names))
    if identity:
        labels.insert(0, F.concat(F.lit("id="), F.col(key).cast("string")))
    listed = F.filter(F.array(*labels), lambda f: f.isNotNull())
    rows = entities.where(F.col(key).isNotNull()).select(F.col(key).alias("entity_id"), listed.alias("_all"))
    rows = rows.select("entity_id", "_all", F.explode(F.array_distinct("_all")).alias("feature"))
    uses = F.size(F.filter("_all", lambda f: f == F.col("feature")))
    return rows.select("entity_id", "feature", (uses / F.size("_all")).alias("weight"))


def user_features(users: DataFrame, tags: Sequence[str] = (), names: str = "qualified") -> DataFrame:
    return entity_features(users, "id", [*tags, *USER_NUMBERS], USER_NUMBERS, names)


def question_features(questions: DataFrame, tags: Sequence[str], names: str = "qualified") -> DataFrame:
    if not tags:
        raise ValueError("question features need tag columns")
    return entity_features(questions, "question_id", tags, (), names)


def interactions(data: DataFrame, with_weights: bool = True, weight: str = "clamped") -> DataFrame:
    """One row `(question_id, user_id, weight)` per pair; a pair's weights add up.

    "clamped" counts an answer by its score but at least 1; "raw" takes the score as is.
    """
    need_option(weight, ["clamped", "raw"])
    need_columns(data.columns, "question_id", "user_id", *(["score"] if with_weights else []))
    if not with_weights:
        return data.select("question_id", "user_id").distinct().withColumn("weight", F.lit(1.0))
    value = F.greatest(F.col("score"), F.lit(1)) if weight == "clamped" else F.col("score")
    return data.groupBy("question_id", "user_id").agg(F.sum(value).cast("double").alias("weight"))


def unknown_ids(pairs: DataFrame, questions: DataFrame, users: DataFrame) -> DataFrame:
    """Ids of interactions that the entity tables do not know."""
    # distinct first: a hot id is combined before it is shuffled
    asked = pairs.select(F.col("question_id").alias("id")).distinct()
    answering = pairs.select(F.col("user_id").alias("id")).distinct()
    lost_questions = asked.join(questions.select(F.col("question_id").alias("id")), "id", "left_anti")
    lost_users = answering.join(users.select("id"), "id", "left_anti")
    return lost_questions.withColumn("side", F.lit("question")).unionByName(lost_users.withColumn("side", F.lit("user")))


def require_known_ids(pairs: DataFrame, questions: DataFrame, users: DataFrame) -> DataFrame:
    """Raise if any interaction names an unknown question or user."""
    lost = unknown_ids(pairs, questions, users).take(1)
    if lost:
        raise InputDataError(f"interactions name an unknown {lost[0].side}: {lost[0].id}")
    return pairs


def interactions_shape(questions: DataFrame, users: DataFrame) -> DataFrame:
    """Sizes of both id spaces: `(side, entities)`."""
    sides = [(questions, "question_id", "questions"), (users, "id", "users")]
    parts = [df.agg(F.count_distinct(key).alias("entities")).withColumn("side", F.lit(side)) for df, key, side in sides]
    return parts[0].unionByName(parts[1])


def sparsity(pairs: DataFrame, questions: DataFrame, users: DataFrame) -> DataFrame:
    """1 - known pairs / possible pairs."""
    filled = pairs.select("question_id", "user_id").distinct().agg(F.count(F.lit(1))).scalar()
    rows = questions.agg(F.count_distinct("question_id")).scalar()
    return users.agg((1 - filled / (rows.cast("double") * F.count_distinct("id"))).alias("sparsity"))
