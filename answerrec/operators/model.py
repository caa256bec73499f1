"""Factor models that rank users for questions.

A question or user is the weighted sum of the vectors of its features, and a score is the
product of two such sums plus the user's bias. Features, factors and pairs are tables; the
steps of the training are in `training.py`.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerrec.errors import need_columns, need_option
from answerrec.functions.vectors import dot, scale, vector_sum
from answerrec.operators import training
from answerrec.operators.features import dense_ids
from answerrec.operators.metrics import METRICS, mean_metrics, need_metrics, question_metrics
from answerrec.operators.prep import display_name
from answerrec.operators.scoring import held_out_positions, held_pairs, positions_of
from answerrec.operators.skew import attach, join_salted, salted, with_copies
from answerrec.session import discard, materialize

LOSSES = ("warp", "bpr")


@dataclass(frozen=True)
class Options:
    """Updates are applied once per batch, so the learning rate is larger than it would be
    for one update per pair."""

    components: int = 32
    loss: str = "warp"
    learning_rate: float = 0.3
    epochs: int = 10
    batches: int = 4
    max_sampled: int = 10
    seed: int = 42

    def __post_init__(self) -> None:
        need_option(self.loss, LOSSES)
        if min(self.components, self.epochs, self.batches, self.max_sampled) < 1:
            raise ValueError("components, epochs, batches and max_sampled must be positive")

    @property
    def size(self) -> int:
        """Vector length: the components and, last, the bias."""
        return self.components + 1


def hashed(digits: int, *parts: str | int | Column) -> Column:
    """A number from the first hex digits of md5 over the parts: the same on every engine."""
    texts = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.left(F.md5(F.concat_ws(":", *texts)), F.lit(digits)), 16, 10).cast("bigint")


def question_node(question: Column) -> Column:
    return question.cast("bigint") * 2


def user_node(user: Column) -> Column:
    return user.cast("bigint") * 2 + 1


def _is_user(node: str = "node") -> Column:
    return F.col(node) % 2 != 0


@dataclass(frozen=True)
class RankingModel:
    """Feature vectors `(feature, _copies, vector, squares)` and the features of all entities
    `(node, feature, weight, _salt)`; questions have even nodes and users odd ones. Salts
    are set once, so that no step has to look for frequent features again."""

    options: Options
    features: DataFrame = field(repr=False)
    factors: DataFrame = field(repr=False)

    def vectors(self) -> DataFrame:
        """Rows `(node, vector)`: the summed feature vectors. The last element is the bias
        for a user and 1 for a question, so that a product includes the user's bias."""
        known = join_salted(self.features, self.factors.select("feature", "_copies", "vector"), "feature")
        weighted = known.select("node", scale(F.col("vector"), F.col("weight")).alias("vector"))
        sums = weighted.groupBy("node").agg(vector_sum(F.col("vector"), self.options.size).alias("vector"))
        return sums.select("node", F.when(_is_user(), F.col("vector")).otherwise(self._with_last(1.0)).alias("vector"))

    def _with_last(self, last: float) -> Column:
        return F.concat(F.slice("vector", 1, self.options.components), F.array(F.lit(last)))

    def sides(self) -> tuple[DataFrame, DataFrame]:
        """Item representations of both sides, computed and written once:
        `(question_id, vector)` and `(user_id, vector, bias)`."""
        rows = materialize(self.vectors(), "representations")
        vector = F.slice("vector", 1, self.options.components).alias("vector")
        bias = F.get("vector", F.lit(self.options.components)).alias("bias")
        questions = rows.where(~_is_user()).select(F.shiftright("node", 1).alias("question_id"), vector)
        questions.stored_at = rows.stored_at
        return questions, rows.where(_is_user()).select(F.shiftright("node", 1).alias("user_id"), vector, bias)


def new_model(question_features: DataFrame, user_features: DataFrame, options: Options = Options()) -> RankingModel:
    """An untrained model over two `(entity_id, feature, weight)` tables.

    Start values are a hash of seed, feature and position: the same on every run, whatever
    the partitions.
    """
    for table in (question_features, user_features):
        need_columns(table.columns, "entity_id", "feature", "weight")

    def side(table: DataFrame, node: Column, prefix: str) -> DataFrame:
        return table.select(node.alias("node"), F.concat(F.lit(prefix), F.col("feature")).alias("feature"), "weight")

    entity = F.col("entity_id")
    both = side(question_features, question_node(entity), "q:").unionByName(side(user_features, user_node(entity), "u:"))
    uses = with_copies(both.groupBy("feature").agg(F.count(F.lit(1)).alias("uses")), "uses")
    uses = materialize(uses.drop("uses"), "feature-names")
    features = materialize(salted(both, uses, "feature"), "features")
    spread = 0.1 * 12**0.5  # a uniform value of this width has standard deviation 0.1

    def start(i: int) -> Column:
        return (hashed(5, options.seed, i, "feature") / 2.0**20 - 0.5) * spread

    values = F.array(*[start(i) for i in range(options.components)], F.lit(0.0))
    ones = F.array_repeat(F.lit(1.0), options.size)
    factors = uses.select("feature", "_copies", values.alias("vector"), ones.alias("squares"))
    return RankingModel(options, features, materialize(factors, "factors"))


def _pairs(model: RankingModel, interactions: DataFrame) -> DataFrame:
    need_columns(interactions.columns, "question_id", "user_id", "weight")
    return interactions.select(
        question_node(F.col("question_id")).alias("question"),
        user_node(F.col("user_id")).alias("user"),
        F.col("weight").cast("double").alias("weight"),
    )


def fit(model: RankingModel, interactions: DataFrame, epochs: int | None = None, first_epoch: int = 0) -> RankingModel:
    """Train all epochs. Starting from a trained model continues it; from `new_model`, it
    starts afresh. Tables of passed steps are deleted; those of the given model stay."""
    run = training.prepare(model, _pairs(model, interactions))
    state = training.state_of(run, model.factors)
    for epoch in range(first_epoch, first_epoch + (epochs or model.options.epochs)):
        state = training.epoch(run, state, epoch)
    model = replace(model, factors=training.factors_of(run, state))
    discard(state)
    run.close()
    return model


def positions(model: RankingModel, held: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Where the held-out users stand; see `held_out_positions`."""
    questions, users = model.sides()
    return held_out_positions(questions, users, held, seen)


def evaluate(
    model: RankingModel, held: DataFrame, seen: DataFrame | None = None, metrics: tuple[str, ...] = METRICS, k: int = 10
) -> DataFrame:
    """Rows `(metric, value)`: means over the questions with held-out pairs."""
    return mean_metrics(question_metrics(positions(model, held, seen), k), metrics)


def fit_tracked(
    model: RankingModel,
    interactions: DataFrame,
    validation: DataFrame | None,
    metrics: tuple[str, ...] = (),
    k: int = 10,
) -> tuple[RankingModel, DataFrame]:
    """Train and measure after each epoch; returns the model of the best epoch by
    validation AUC and the trace `(epoch, stage, metric, value)`."""
    if validation is None:
        raise ValueError("tracking needs validation interactions")
    names = need_metrics(list(dict.fromkeys([*metrics, "auc"])))
    run = training.prepare(model, _pairs(model, interactions))
    state = training.state_of(run, model.factors)
    # the pairs that are measured are the same after every epoch
    measured = {"train": held_pairs(interactions, None), "validation": held_pairs(validation, interactions)}
    measured = {stage: [t if t is None else materialize(t, "held-pairs") for t in tables] for stage, tables in measured.items()}
    trace: list[tuple[int, str, str, float]] = []
    best, best_auc = model, float("-inf")
    current = model
    for epoch in range(model.options.epochs):
        state = training.epoch(run, state, epoch)
        before, current = current, replace(model, factors=training.factors_of(run, state))
        questions, users = current.sides()
        for stage, (held, seen) in measured.items():
            # at most three values come back
            found = mean_metrics(question_metrics(positions_of(questions, users, held, seen), k), tuple(names)).collect()
            trace += [(epoch, stage, row.metric, row.value) for row in found]
        discard(questions)
        auc = next(v for e, stage, metric, v in trace if (e, stage, metric) == (epoch, "validation", "auc"))
        was_best = best
        if auc is not None and auc > best_auc:
            best, best_auc = current, auc
        for old in (was_best, before):  # the given model is the caller's; of the others the best and the last are needed
            if all(old.factors is not kept.factors for kept in (model, best, current)):
                discard(old.factors)
    discard(state, *[t for tables in measured.values() for t in tables])
    run.close()
    spark = interactions.sparkSession
    rows = spark.createDataFrame(trace, "epoch int, stage string, metric string, value double")
    return best, rows


def display_trace(trace: DataFrame) -> DataFrame:
    """The trace with metric names for display."""
    return trace.withColumn("metric", display_name(F.col("metric")))


def als_vectors(
    interactions: DataFrame, components: int = 32, iterations: int = 10, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Question and user vectors from Spark's implicit-feedback matrix factorisation, the
    built-in way to pure collaborative filtering; ready for scoring."""
    need_columns(interactions.columns, "question_id", "user_id", "weight")
    questions = materialize(dense_ids(interactions, "question_id"), "question-ids")
    users = materialize(dense_ids(interactions, "user_id"), "user-ids")
    coded = interactions.select("question_id", "user_id", "weight")
    for ids, key, name in ((questions, "question_id", "q"), (users, "user_id", "u")):
        sizes = interactions.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
        coded = attach(coded, ids.withColumnRenamed("idx", name).join(sizes, key), key, size="_rows").drop("_rows")
    coded = coded.select(F.col("q").cast("int"), F.col("u").cast("int"), F.col("weight").cast("float"))
    # one block for a million ids or so, and never fewer than the library's own number
    blocks = [max(10, -(-ids.count() // 1_000_000)) for ids in (questions, users)]
    als = ALS(
        numUserBlocks=blocks[0], numItemBlocks=blocks[1], rank=components, maxIter=iterations, implicitPrefs=True, userCol="q", itemCol="u", ratingCol="weight", seed=seed
    )
    found = als.fit(coded)
    vector = F.col("features").cast("array<double>").alias("vector")
    question_rows = found.userFactors.join(questions, F.col("id") == F.col("idx")).select("question_id", vector)
    user_rows = found.itemFactors.join(users, F.col("id") == F.col("idx"))
    return question_rows, user_rows.select("user_id", vector, F.lit(0.0).alias("bias"))


def sampled_pairs(interactions: DataFrame, per_positive: int = 1, seed: int = 42) -> DataFrame:
    """Rows `(question_id, user_id, label)`: the known pairs and as many random unknown ones of
    the same questions, times `per_positive`. Draws that hit a known pair are left out, and a pair that is
    drawn twice counts once."""
    need_columns(interactions.columns, "question_id", "user_id")
    known = materialize(interactions.select("question_id", "user_id").distinct(), "known-pairs")
    users = materialize(dense_ids(known, "user_id"), "user-numbers")
    draws = known.select("question_id", "user_id", F.explode(F.sequence(F.lit(1), F.lit(per_positive))).alias("draw"))
    number = F.pmod(hashed(15, seed, "question_id", "user_id", "draw"), F.lit(users.count()))
    drawn = draws.select("question_id", number.alias("idx")).join(users, "idx").select("question_id", "user_id").distinct()
    unknown = drawn.join(known, ["question_id", "user_id"], "left_anti")
    return known.withColumn("label", F.lit(1.0)).unionByName(unknown.withColumn("label", F.lit(0.0)))


def fm_vectors(
    question_features: DataFrame, user_features: DataFrame, interactions: DataFrame, components: int = 8, iterations: int = 60,
    buckets: int = 2**12, per_positive: int = 3, step: float = 0.05, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Question and user vectors of Spark's factorisation machine, trained on known pairs and
    random unknown ones; ready for scoring.

    Features of both sides are hashed into `buckets` each, which bounds what the driver holds:
    components + 1 numbers per bucket. A machine's score of a pair is the sum over its
    features of weights and products of vectors; what depends on the question alone cannot
    change the order of users, so the rest is a product of two vectors plus the user's bias.
    """
    for table in (question_features, user_features):
        need_columns(table.columns, "entity_id", "feature")

    def bucketed(table: DataFrame, first: int) -> DataFrame:
        place = F.pmod(F.xxhash64("feature"), F.lit(buckets)) + first
        return table.select("entity_id", place.cast("string").alias("place")).distinct()

    sides = {"question_id": bucketed(question_features, 0), "user_id": bucketed(user_features, buckets)}
    pairs = sampled_pairs(interactions, per_positive, seed)
    for key, places in sides.items():
        listed = places.groupBy(F.col("entity_id").alias(key)).agg(F.sort_array(F.collect_list("place")).alias(f"_{key}"))
        sizes = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        pairs = attach(pairs, listed.join(sizes, key), key, size="_n").drop("_n")
    rows = pairs.select("label", F.concat("_question_id", "_user_id").alias("places"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(2 * buckets)], inputCol="places", outputCol="features")
    machine = FMClassifier(factorSize=components, maxIter=iterations, stepSize=step, seed=seed)
    trained = machine.fit(materialize(counter.transform(rows).select("label", "features"), "fm-pairs"))
    factors, weights = trained.factors.toArray(), trained.linear.toArray()
    spark = interactions.sparkSession
    learned = pd.DataFrame({"place": [str(i) for i in range(2 * buckets)], "v": factors.tolist(), "w": weights})
    learned = materialize(spark.createDataFrame(learned, "place string, v array<double>, w double"), "fm-factors")

    def summed(key: str) -> DataFrame:
        known = sides[key].join(F.broadcast(learned), "place").withColumn("own", dot(F.col("v"), F.col("v")))  # a row per bucket
        return known.groupBy(F.col("entity_id").alias(key)).agg(vector_sum(F.col("v"), components).alias("vector"), F.sum("w").alias("w"), F.sum("own").alias("own"))

    users = summed("user_id")
    bias = F.col("w") + (dot(F.col("vector"), F.col("vector")) - F.col("own")) / 2
    return summed("question_id").select("question_id", "vector"), users.select("user_id", "vector", bias.alias("bias"))
