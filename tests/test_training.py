"""Steps of the training on packed rows."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from answerrec.operators import model, training
from answerrec.operators.features import entity_features


def start(spark, questions, users, options):
    sides = (entity_features(spark.range(n).withColumnRenamed("id", key), key) for n, key in ((questions, "question_id"), (users, "id")))
    return model.new_model(*sides, options)


def test_a_step_without_violations_changes_nothing(spark):
    options = model.Options(components=2, loss="warp", batches=1)
    begun = start(spark, 1, 3, options)
    far = F.when(F.col("feature") == "q:id=0", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    far = far.when(F.col("feature") == "u:id=0", F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array_repeat(F.lit(0.0), 3))
    begun = replace(begun, factors=begun.factors.withColumn("vector", far).localCheckpoint())
    pairs = spark.createDataFrame([(0, 0, 1.0)], "question_id long, user_id long, weight double")
    found = model.fit(begun, pairs, epochs=1).factors
    rows = lambda df: sorted((r.feature, tuple(r.vector), tuple(r.squares)) for r in df.collect())
    assert rows(found) == rows(begun.factors)


def test_a_hot_question_is_dealt_to_blocks_that_know_all_its_users(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK_PAIRS", 600)
    options = model.Options(components=2, loss="bpr", batches=1)
    begun = start(spark, 3, 4000, options)
    pairs = spark.range(3000).selectExpr("if(id % 10 < 9, 0, 1) as question_id", "id as user_id", "1.0D as weight")
    lost = spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (7, 1, 1.0), (1, 9000, 1.0)], "question_id long, user_id long, weight double")
    run = training.prepare(begun, model._pairs(begun, pairs.unionByName(lost)))
    blocks = run.blocks.collect()
    assert len({r.place for r in blocks}) == len(blocks) > 2  # parts have a thousand pairs at least
    found, sizes = set(), []
    for r in blocks:
        question, user, asked = (np.frombuffer(x, np.int64) for x in (r.a, r.b, r.c))
        found |= set(zip(question.tolist(), user.tolist()))
        sizes.append(len(question))
        known = np.frombuffer(r.f, np.int64)
        hot = np.unique(asked[question == 0])
        assert len(hot) == 0 or (known // run.user_count == hot[0]).sum() == 2700
    assert sum(sizes) == 3000 and max(sizes) < 1500
    assert found == {(2 * (0 if i % 10 < 9 else 1), 2 * i + 1) for i in range(3000)}


def test_vectors_of_few_draws_are_those_of_the_needed_users(spark):
    """With more users than draws a block asks for the users that it draws and no others."""
    options = model.Options(components=3, loss="warp", batches=2, max_sampled=2)
    begun = start(spark, 20, 500, options)
    pairs = spark.range(60).selectExpr("id % 20 as question_id", "id * 3 as user_id", "1.0D as weight")
    run = training.prepare(begun, model._pairs(begun, pairs))
    draws = training.draw(run, 0)
    for batch in range(2):
        mine, entries, _ = draws.of(batch)
        row, need = mine.first(), entries.first()
        pairs_of = {n: getattr(row, n) for n in "abcdef"}
        draw = training.drawer(options, run.user_count, 0, pairs_of)
        every = np.arange(len(np.frombuffer(row.a, np.int64)))
        users = np.unique(np.concatenate([np.frombuffer(row.d, np.int64), draw(every, 1), draw(every, 2)]))
        asked = np.unique(np.frombuffer(row.c, np.int64))
        assert np.frombuffer(need.a, np.int64).tolist() == users[users >= 0].tolist() + asked.tolist()
