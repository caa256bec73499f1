"""Rankings of scores far below one."""

from answerrec.operators.scoring import score_pairs, top_users


def test_small_scores_keep_their_order(spark):
    questions = spark.createDataFrame([(1, [1e-4])], "question_id long, vector array<double>")
    users = spark.createDataFrame([(i, [i * 1e-3], 0.0) for i in range(5)], "user_id long, vector array<double>, bias double")
    best = top_users(questions, users, 2).collect()
    assert [r["user_id"] for r in sorted(best, key=lambda r: r["rank"])] == [4, 3]
    pairs = spark.createDataFrame([(1, i) for i in range(5)], "question_id long, user_id long")
    scored = {r["user_id"]: r["score"] for r in score_pairs(pairs, questions, users).collect()}
    assert all(abs(scored[i] - i * 1e-7) < 1e-13 for i in range(5))
