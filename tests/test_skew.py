"""Helpers for hot keys against plain Python, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerrec.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, 7 if rng.random() < 0.6 else rng.randrange(40), rng.randrange(1000)) for i in range(3000)]
    return data, spark.createDataFrame(data, "id long, key long, value long").repartition(6).cache()


def test_rank_rows(rows):
    data, df = rows
    ranked = skew.rank_rows(df, ["key"], F.floor(F.col("value") / 100), [F.col("value"), F.col("id")]).collect()
    expected = {}
    for key in {k for _, k, _ in data}:
        inside = sorted((v, i) for i, k, v in data if k == key)
        expected |= {i: (pos + 1, len(inside)) for pos, (_, i) in enumerate(inside)}
    assert {r.id: (r["_rank"], r["_n"]) for r in ranked} == expected


def test_first_rows_keep_exact_quota(rows):
    data, df = rows
    kept = skew.first_rows(df, ["key"], F.floor(F.col("value") / 50), [F.col("value"), F.col("id")], lambda n: F.ceil(n * 0.3))
    expected = set()
    for key in {k for _, k, _ in data}:
        inside = sorted((v, i) for i, k, v in data if k == key)
        expected |= {i for _, i in inside[: -(-len(inside) * 3 // 10)]}
    assert {r.id for r in kept.collect()} == expected


def test_hash_sample_is_partition_independent(rows):
    _, df = rows
    pick = lambda d: {r.id for r in skew.first_by_hash(d, 3, ["id"], quota=lambda n: F.lit(100)).collect()}
    first = pick(df)
    assert len(first) == 100 and first == pick(df.repartition(1))


def test_attach_spreads_hot_keys(rows, spark):
    data, df = rows
    per_key = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sized = skew.with_copies(per_key, "n", rows_per_task=200)
    assert [r.key for r in sized.where("_copies > 1").collect()] == [7]
    salts = skew.salted(df, sized, "key").where("key = 7").groupBy("_salt").count().collect()
    hot = sum(k == 7 for _, k, _ in data)
    assert len(salts) == -(-hot // 200)
    assert max(r["count"] for r in salts) < 300
    joined = skew.attach(df, per_key, "key", size="n", rows_per_task=200)
    assert sorted((r.id, r.key, r.n) for r in joined.collect()) == sorted(
        (i, k, sum(1 for _, x, _ in data if x == k)) for i, k, _ in data
    )


@pytest.mark.parametrize("values", [list(range(101)), [5.0] * 9, [1.5], [0.0, 1e9, 1.0, 2.0, None], [3, 1, 2, 2, 2, 9]])
def test_quantiles(spark, values):
    probs = [0.0, 0.1, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    known = [v for v in values if v is not None]
    for bound in (1, 3, 100_000):
        found = {r.p: r.value for r in skew.quantiles(df, ["v"], probs, bound=bound, cuts=16).collect()}
        assert found == {p: pytest.approx(float(np.quantile(known, p))) for p in probs}


def test_quantiles_of_several_columns_with_an_outlier(spark, monkeypatch):
    rng = random.Random(6)
    data = [(rng.gauss(0, 1), float(rng.randrange(5)), 1000.0 + rng.random()) for _ in range(4000)]
    data[17] = (1e12, -3.0, None)
    df = spark.createDataFrame(data, "a double, b double, c double")
    largest = []
    real = spark.createDataFrame

    def watch(rows, schema=None, *more):
        if isinstance(schema, str) and schema.startswith("range int"):
            largest.append(max(r[5] for r in rows))
        return real(rows, schema, *more)

    monkeypatch.setattr(spark, "createDataFrame", watch)
    probs = [0.25, 0.5, 0.999]
    found = {(r.column, r.p): r.value for r in skew.quantiles(df, ["a", "b", "c"], probs, bound=50).collect()}
    monkeypatch.undo()
    columns = {c: [r[i] for r in data if r[i] is not None] for i, c in enumerate("abc")}
    assert found == {(c, p): pytest.approx(float(np.quantile(v, p))) for c, v in columns.items() for p in probs}
    assert largest[-1] <= 50 and len(largest) <= 4


def test_one_crowded_hour_is_opened(spark):
    rows = [(1 if i % 10 else 2, i * 3 % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "question_id long, answer_id long").withColumn("date", F.lit("2024-05-05 10:00:00").cast("timestamp"))
    quota = lambda n: F.ceil(n * 0.3)
    levels = [F.hour("date"), F.second("date")]
    kept = skew.first_rows(df, ["question_id"], levels, [F.desc("answer_id")], quota, last="answer_id", bound=20)
    expected = []
    for q in (1, 2):
        ids = sorted((a for k, a in rows if k == q), reverse=True)
        expected += ids[: -(-len(ids) * 3 // 10)]
    assert sorted(r.answer_id for r in kept.collect()) == sorted(expected)


def test_rows_of_frequent_keys_are_not_shuffled(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, F.lit(0)).when(F.col("id") < 990, F.col("id")).alias("key"))
    per_key = df.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.attach_stored(df, per_key, "key", "n", frequent_keys=10)
    assert sorted((r.id, r.key, r.n) for r in joined.collect()) == [(i, 0 if i < 900 else i, 900 if i < 900 else 1) for i in range(990)]
    assert skew.attach_stored(df, per_key.where("n < 0"), "key", "n").count() == 0
