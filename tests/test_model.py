"""Trained models must find planted structure; positions must match brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerrec.errors import BadEvaluationMetric, InvalidTag
from answerrec.operators import metrics, model, scoring
from answerrec.operators.features import entity_features


@pytest.fixture(scope="module")
def planted(spark):
    """Questions and users of 4 groups; most answers stay inside a group."""
    rng = random.Random(5)
    pairs = set()
    for question in range(120):
        for _ in range(8):
            same = rng.random() < 0.85
            pairs.add((question, 4 * rng.randrange(15) + (question % 4 if same else rng.randrange(4))))
    rows = [(q, u, 1.0, rng.random() < 0.25) for q, u in sorted(pairs)]
    df = spark.createDataFrame(rows, "question_id long, user_id long, weight double, held boolean").cache()
    questions = spark.range(120).selectExpr("id as question_id", "concat('g', id % 4) as tag1")
    users = spark.range(60).selectExpr("id", "concat('g', id % 4) as tag1")
    return df.where("not held"), df.where("held"), questions, users


def features(questions, users, columns):
    return entity_features(questions, "question_id", columns), entity_features(users, "id", columns)


@pytest.mark.parametrize("loss", ["bpr", "warp"])
def test_hybrid_learns_groups(planted, loss):
    train, test, questions, users = planted
    options = model.Options(components=8, loss=loss, epochs=6, batches=1)
    start = model.new_model(*features(questions, users, ["tag1"]), options)
    before = model.evaluate(start, test, train, ("auc",)).first().value
    after = model.evaluate(model.fit(start, train), test, train, ("auc",)).first().value
    assert after > 0.75 and after > before + 0.15


def test_tracking_keeps_the_best_epoch(planted):
    train, test, questions, users = planted
    options = model.Options(components=4, loss="bpr", epochs=2, batches=1)
    start = model.new_model(*features(questions, users, []), options)
    best, trace = model.fit_tracked(start, train, test, metrics=("precision",))
    rows = trace.collect()
    assert len(rows) == 2 * 2 * 2
    top = max(r.value for r in rows if r.stage == "validation" and r.metric == "auc")
    assert model.evaluate(best, test, train, ("auc",)).first().value == pytest.approx(top)


def test_als_vectors(planted):
    train, test, _, _ = planted
    questions, users = model.als_vectors(train, components=8, iterations=5)
    found = metrics.question_metrics(scoring.held_out_positions(questions, users, test, train))
    assert metrics.mean_metrics(found, ("auc",)).first().value > 0.65


def test_factorisation_machine(planted):
    train, test, questions, users = planted
    sides = model.fm_vectors(*features(questions, users, ["tag1"]), train, components=6, buckets=512)
    found = metrics.question_metrics(scoring.held_out_positions(*sides, test, train))
    assert metrics.mean_metrics(found, ("auc",)).first().value > 0.68
    pairs = model.sampled_pairs(train, per_positive=2).collect()
    known = {(r.question_id, r.user_id) for r in train.collect()}
    assert {(r.question_id, r.user_id) for r in pairs if r.label} == known
    unknown = [(r.question_id, r.user_id) for r in pairs if not r.label]
    assert len(unknown) == len(set(unknown)) > len(known) and not known & set(unknown)


def test_bad_options(planted):
    train, test, questions, users = planted
    with pytest.raises(InvalidTag):
        model.Options(loss="hinge")
    with pytest.raises(BadEvaluationMetric):
        metrics.need_metrics(["cnn"])
    start = model.new_model(*features(questions, users, []), model.Options(components=2))
    with pytest.raises(ValueError):
        model.fit_tracked(start, train, None)


def test_positions_match_brute_force(spark):
    rng = random.Random(3)
    questions = {q: [rng.randrange(3), rng.randrange(3)] for q in range(40)}
    users = {u: ([rng.randrange(4), rng.randrange(4)], rng.randrange(2)) for u in range(70)}
    everything = [(q, u) for q in questions for u in users]
    seen, held = set(rng.sample(everything, 300)), set(rng.sample(everything, 300))
    # question 0 holds most held-out pairs, so that it is split
    held |= {(0, u) for u in users}

    def score(q, u):
        return float(sum(a * b for a, b in zip(questions[q], users[u][0])) + users[u][1])

    expected = set()
    for q, u in held - seen:
        others = [(score(q, x), -x) for x in users if (q, x) not in seen]
        mine = score(q, u)
        expected.add((q, u, sum(s < mine for s, _ in others), sum(s == mine for s, _ in others),
                      sum(o > (mine, -u) for o in others), len(others)))
    q_df = spark.createDataFrame([(q, list(map(float, v))) for q, v in questions.items()], "question_id long, vector array<double>")
    u_df = spark.createDataFrame([(u, list(map(float, v)), float(b)) for u, (v, b) in users.items()],
                                 "user_id long, vector array<double>, bias double")
    pair = lambda rows: spark.createDataFrame(sorted(rows), "question_id long, user_id long")
    found = scoring.held_out_positions(q_df, u_df, pair(held), pair(seen), question_block=7, user_block=16, held_per_part=9)
    rows = {(r.question_id, r.user_id, r.below, r.equal, r.ahead, r.candidates) for r in found.collect()}
    assert rows == expected

    for strip in (1, 2, 16):
        best = scoring.top_users(q_df, u_df, 5, exclude_seen=pair(seen), question_block=7, user_block=8, strip=strip)
        lists = {r.question_id: list(r.user_ids) for r in scoring.ranked_lists(best).collect()}
        for q in questions:
            free = sorted((x for x in users if (q, x) not in seen), key=lambda x: (-score(q, x), x))
            assert lists[q] == free[:5]


def test_blocks_that_cannot_hold_better_users_are_skipped(spark):
    rng = random.Random(8)
    length = lambda i: 1.0 / (1 + i / 40)
    users = []
    for i in range(1600):
        v = [rng.gauss(0, 1) for _ in range(6)]
        size = sum(x * x for x in v) ** 0.5
        users.append((i, [x / size * length(i) for x in v], 0.0))
    questions = [(q, [rng.gauss(0, 1) for _ in range(6)]) for q in range(50)]
    q_df = spark.createDataFrame(questions, "question_id long, vector array<double>")
    u_df = spark.createDataFrame(users, "user_id long, vector array<double>, bias double").repartition(4)
    blocks = scoring.users_by_length(u_df, 100)
    sizes = [r["count"] for r in blocks.users.groupBy("ub").count().collect()]
    assert len(sizes) == len(blocks.longest) >= 16 and max(sizes) <= 110
    first = blocks.users.where("ub = 0").select(F.lit(0).alias("cell"), "*")
    top = scoring._meet(q_df.select("*", F.lit(float("-inf")).alias("floor"), F.lit(0).alias("cell")), first, None, 5)
    asked = scoring.visits(q_df, top, blocks, 5).collect()
    share = sum(r.ub for r in asked) / (len(asked) * len(blocks.longest))
    assert share < 0.5  # more than half of all blocks are skipped
    found = {}
    for r in scoring.top_users(q_df, u_df, 5, user_block=100, strip=3).orderBy("question_id", "rank").collect():
        found.setdefault(r.question_id, []).append(r.user_id)
    for q, v in questions:
        best = sorted(users, key=lambda u: (-float(np.float32(sum(a * b for a, b in zip(v, u[1])))), u[0]))
        assert found[q] == [u[0] for u in best[:5]]


def test_users_in_a_box_that_cannot_reach_are_left_out(monkeypatch):
    monkeypatch.setattr(scoring, "LEAF", 8)
    rng = np.random.default_rng(6)
    angles = rng.uniform(0, 2 * np.pi, 400)
    users = np.column_stack((np.cos(angles), np.sin(angles)))  # one length: no block can be skipped
    questions = rng.normal(size=(30, 2))
    rows = [(scoring.QUESTION, q, None, list(v), float("-inf"), None) for q, v in enumerate(questions)]
    rows += [(scoring.USER, None, u, list(v), 0.0, u // 100) for u, v in enumerate(users)]
    rows += [(scoring.SEEN, 3, u, None, None, None) for u in range(0, 400, 2)]
    cell = pd.DataFrame(rows, columns=["kind", "question_id", "user_id", "vector", "bias", "ub"])
    scored = []
    monkeypatch.setattr(scoring, "_exact", lambda s: scored.append(s.size) or s.astype(np.float32).astype(float))
    found = scoring._top_of_blocks(cell, 5).sort_values(["question_id", "score", "user_id"], ascending=[True, False, True])
    assert sum(scored) < 0.5 * 30 * 400
    for q, v in enumerate(questions):
        best = np.lexsort((np.arange(400), -(users @ v).astype(np.float32)))
        best = [u for u in best if q != 3 or u % 2][:5]
        assert found[found["question_id"] == q]["user_id"].tolist() == best
    leaves = scoring._leaves(users)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(400)) and max(map(len, leaves)) <= 8


def test_equal_lengths_and_few_users(spark):
    u_df = spark.createDataFrame([(i, [1.0, 0.0], 0.0) for i in range(90)], "user_id long, vector array<double>, bias double")
    q_df = spark.createDataFrame([(1, [2.0, 1.0]), (2, [-1.0, 0.0])], "question_id long, vector array<double>")
    top = scoring.top_users(q_df, u_df, 4, user_block=10)
    assert {r.question_id: list(r.user_ids) for r in scoring.ranked_lists(top).collect()} == {1: [0, 1, 2, 3], 2: [0, 1, 2, 3]}
    assert scoring.top_users(q_df, u_df.limit(2), 4).count() == 4
    assert scoring.top_users(q_df, u_df.limit(0), 4).count() == 0
    assert scoring.top_users(q_df.limit(0), u_df, 4).count() == 0


def test_one_sort_serves_all_held_out_users_of_a_question():
    rng = np.random.default_rng(1)
    for size in (0, 1, 40, 40):
        ids = np.sort(rng.choice(100, size, replace=False))
        scores = np.where(rng.random(size) < 0.3, np.nan, rng.integers(-3, 4, size).astype(float))
        users, mine = rng.integers(0, 100, 50), rng.integers(-4, 5, 50).astype(float)
        found = scoring._places(scores, int((~np.isnan(scores)).sum()), ids, users, mine)
        for user, own, row in zip(users, mine, found.tolist()):
            ahead = (scores > own).sum() + ((scores == own) & (ids < user)).sum()
            assert row == [(scores < own).sum(), (scores == own).sum(), ahead, (~np.isnan(scores)).sum()]


def test_held_out_pairs_of_few_questions_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(scoring, "HELD_PER_PART", 100)
    questions = spark.range(20).selectExpr("id as question_id", "0 as part", "array(1.0D) as vector")
    users = spark.range(80).selectExpr("id as user_id", "array(1.0D) as vector", "0.0D as bias")
    held = questions.crossJoin(users.selectExpr("user_id", "0.0D as score")).select("question_id", "user_id", "part", "score")
    cells = scoring._cells(questions, users, None, held, 2048, 8192).where(F.col("kind") == scoring.HELD)
    assert max(r["count"] for r in cells.groupBy("qb", "ub").count().collect()) < 800


def test_constant_scores_give_half(spark):
    vectors = spark.range(5).selectExpr("id as question_id", "array(0.0D) as vector")
    users = spark.range(20).selectExpr("id as user_id", "array(0.0D) as vector", "0.0D as bias")
    held = spark.range(5).selectExpr("id as question_id", "id + 3 as user_id")
    found = metrics.question_metrics(scoring.held_out_positions(vectors, users, held)).collect()
    assert [r.auc for r in found] == [0.5] * 5


def test_training_continues_and_repeats(planted):
    train, _, questions, users = planted
    start = model.new_model(*features(questions, users, []), model.Options(components=3, loss="bpr", batches=1))
    once = model.fit(start, train, epochs=1)
    again = model.fit(start, train.repartition(3), epochs=1)
    further = model.fit(once, train, epochs=1, first_epoch=1)

    def values(m):
        return {r.feature: [round(x, 9) for x in r.vector] for r in m.factors.collect()}

    assert values(once) == values(again)
    assert values(further) != values(once)
