"""Registered queries: interactions, labels and column shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.operators import prep
from answerrec.plans import views
from answerrec.plans.catalogue import register
from answerrec.plans.views import ANSWERS, EVENT_PAIRS, PREPROCESSED, QUESTIONS, USERS, sql_with

BASE = (ANSWERS, QUESTIONS)
PREP = (ANSWERS, QUESTIONS, PREPROCESSED)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.accepted_flag(views.answers(spark, sf_dir), views.questions(spark, sf_dir))


def preprocessed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.preprocess(views.answers(spark, sf_dir), views.questions(spark, sf_dir))


@register(sql_with(*PREP, select="select answer_id, question_id, is_accepted_answer from flagged"))
def accepted_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("answer_id", "question_id", "is_accepted_answer")


@register(sql_with(ANSWERS, select="select question_id, count(answer_id) as answers from answers group by 1"))
def answers_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.rows_per_key(views.answers(spark, sf_dir), "question_id", "answer_id", "answers")


@register(sql_with(ANSWERS, select="""
select answer_id, count(answer_id) over (partition by question_id) as question_answers,
       count(answer_id) over (partition by user_id) as user_answers from answers"""))
def answers_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.answers(spark, sf_dir)
    by_question = prep.with_count(rows, rows, "question_id", "answer_id", "question_answers")
    both = prep.with_count(by_question, rows, "user_id", "answer_id", "user_answers")
    return both.select("answer_id", "question_answers", "user_answers")


@register(sql_with(ANSWERS, select="select user_id, count(answer_id) as answers from answers group by 1"))
def answers_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.rows_per_key(views.answers(spark, sf_dir), "user_id", "answer_id", "answers")


@register(sql_with(*BASE, select="""
select owner_user_id, count(question_id) as questions from questions where owner_user_id is not null group by 1"""))
def questions_per_asker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.rows_per_key(views.questions(spark, sf_dir), "owner_user_id", "question_id", "questions")


INTERACTION = ["answer_id", "user_id", "question_id", "score"]
INTERACTION_SQL = "select answer_id, user_id, question_id, score from flagged where "


@register(sql_with(*PREP, select=INTERACTION_SQL + "score >= 1 or is_accepted_answer = 1"))
def positive_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.positive_interactions(flagged(spark, sf_dir)).select(*INTERACTION)


@register(sql_with(*PREP, select=INTERACTION_SQL + "score >= 2"))
def positive_score_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.answers(spark, sf_dir)
    return prep.positive_interactions(rows, threshold=2, take_accepted=False).select(*INTERACTION)


@register(sql_with(*PREP, select=INTERACTION_SQL + """answer_id not in (
  select answer_id from flagged where score >= 1 or is_accepted_answer = 1)"""))
def negative_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.negative_interactions(flagged(spark, sf_dir)).select(*INTERACTION)


@register(sql_with(*PREP, select="""
select question_id, min(number_answers_per_question) as number_answers_per_question,
       min(question_label) as question_label from preprocessed group by 1"""))
def question_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = prep.question_activity(views.answers(spark, sf_dir), views.questions(spark, sf_dir))
    return labelled.select("question_id", "number_answers_per_question", "question_label")


@register(sql_with(*PREP, select="select * from preprocessed"))
def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessed_rows(spark, sf_dir)


@register(sql_with(USERS, select="""
select case when about_me is null then 'without' else 'with' end as part, count(*) as users,
       min(id) as first_id, max(id) as last_id from users group by 1"""))
def text_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("about_me").isNull(), "without").otherwise("with")
    return (
        views.users(spark, sf_dir)
        .groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("users"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )


@register(sql_with(USERS, select="""
select id, reputation, coalesce(location, '') as location, md5(coalesce(about_me, '')) as about_md5 from users"""))
def users_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = views.users(spark, sf_dir).na.fill("")
    return filled.select("id", "reputation", "location", F.md5("about_me").alias("about_md5"))


@register(sql_with(USERS, select="""
select distinct unnest([cast(reputation as varchar), cast(up_votes as varchar), cast(down_votes as varchar),
                        cast(views as varchar)]) as value from users"""))
def unique_feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["reputation", "up_votes", "down_votes", "views"]
    return prep.distinct_values(views.users(spark, sf_dir), columns)


@register(sql_with(ANSWERS, select="""
select question_id, min(date) as date, arg_min(answer_id, (date, answer_id)) as answer_id,
       arg_min(user_id, (date, answer_id)) as user_id from answers group by 1"""))
def first_answer_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.answers(spark, sf_dir).select("question_id", "date", "answer_id", "user_id")
    return prep.first_per_key(rows, "question_id", "date", "answer_id")


@register(sql_with(ANSWERS, select="""
select o_orderkey as answer_id from orders where o_custkey not in (
  select user_id from answers where score >= 24 and user_id is not null)"""))
def answers_without_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership filters: the anti join keeps orders of users without a top-scored answer."""
    top = views.answers(spark, sf_dir).where("score >= 24")
    orders = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("answer_id"), F.col("o_custkey").alias("user_id")
    )
    return prep.drop_keys(orders, top, "user_id").select("answer_id")


@register(sql_with(ANSWERS, select="""
select o_orderkey as answer_id from orders where o_custkey in (select user_id from answers where score >= 24)"""))
def answers_of_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = views.answers(spark, sf_dir).where("score >= 24")
    orders = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("answer_id"), F.col("o_custkey").alias("user_id")
    )
    return prep.keep_keys(orders, top, "user_id").select("answer_id")


WIDE = """
wide as (
  select user_id, avg(case when event_type = 'click' then value end) as model_auc_train,
         avg(case when event_type = 'view' then value end) as model_precision_validation,
         avg(value) as model_recall_train from events group by 1)"""


@register(sql_with(WIDE, select="""
select user_id, 'ROC AUC' as metric, 'train' as stage, round(model_auc_train, 6) as value from wide
union all select user_id, 'Precision', 'validation', round(model_precision_validation, 6) from wide
union all select user_id, 'Recall', 'train', round(model_recall_train, 6) from wide"""))
def metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mean(kind: str) -> F.Column:
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    wide = (
        views.table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            mean("click").alias("model_auc_train"),
            mean("view").alias("model_precision_validation"),
            F.avg("value").alias("model_recall_train"),
        )
    )
    return prep.unpivot_metrics(wide, ["user_id"]).withColumn("value", F.round("value", 6))


@register(sql_with(ANSWERS, EVENT_PAIRS, select="""
select question_id, user_id, score from answers a
where not exists (select 1 from event_pairs e where e.question_id = a.question_id and e.user_id = a.user_id)"""))
def unseen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs that are not among the known interactions."""
    candidates = views.answers(spark, sf_dir).select("question_id", "user_id", "score")
    return candidates.join(views.event_pairs(spark, sf_dir), ["question_id", "user_id"], "left_anti")


@register(sql_with(ANSWERS, EVENT_PAIRS, select="""
select question_id, user_id, coalesce(weight, 0) as weight
from (select distinct question_id, user_id from answers union select question_id, user_id from event_pairs where weight > 1)
left join event_pairs using (question_id, user_id)"""))
def pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answered pairs and those of repeated events; pairs without an event weigh 0."""
    events = views.event_pairs(spark, sf_dir)
    pairs = views.answers(spark, sf_dir).select("question_id", "user_id")
    candidates = pairs.union(events.where("weight > 1").select("question_id", "user_id")).distinct()
    return prep.pair_weights(candidates, events)
