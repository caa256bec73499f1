"""Registered queries: scores, recommendations and ranking metrics.

The vectors are small whole numbers made from the ids, so scores have many ties and are
equal on every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.operators import metrics, scoring
from answerrec.operators.skew import hash_order
from answerrec.plans import views
from answerrec.plans.catalogue import register
from answerrec.plans.views import ANSWERS, EVENT_PAIRS, sql_with


def vector(*parts: F.Column) -> F.Column:
    return F.array(*[p.cast("double") for p in parts]).alias("vector")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("p_partkey")
    return views.table(spark, sf_dir, "part").select(q.alias("question_id"), vector(q % 7, q % 5 + 1))


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("c_custkey")
    bias = (u % 2).cast("double").alias("bias")
    return views.table(spark, sf_dir, "customer").select(u.alias("user_id"), vector(u % 3, u % 11), bias)



def score_sql(q: str, u: str) -> str:
    return f"cast(({q} % 7) * ({u} % 3) + ({q} % 5 + 1) * ({u} % 11) + {u} % 2 as double)"


@register(sql_with(ANSWERS, select=f"""
select answer_id, question_id, user_id, {score_sql('question_id', 'user_id')} as score from answers"""))
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.answers(spark, sf_dir).select("answer_id", "question_id", "user_id")
    return scoring.score_pairs(pairs, question_vectors(spark, sf_dir), user_vectors(spark, sf_dir))


TOP = f"""
top as (select * from (
  select p_partkey as question_id, c_custkey as user_id, {score_sql('p_partkey', 'c_custkey')} as score,
         row_number() over (partition by p_partkey order by {score_sql('p_partkey', 'c_custkey')} desc, c_custkey) as rank
  from part, customer) where rank <= 20)"""


@register(sql_with(TOP, select="""
select question_id, string_agg(cast(user_id as varchar), ',' order by rank) as user_ids from top group by 1"""))
def recommend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best users of every question, over all users."""
    top = scoring.top_users(question_vectors(spark, sf_dir), user_vectors(spark, sf_dir), k=20)
    lists = scoring.ranked_lists(top)
    return lists.select("question_id", F.array_join(F.transform("user_ids", lambda u: u.cast("string")), ",").alias("user_ids"))


@register(sql_with(ANSWERS, select=f"""
select question_id, user_id, score, rank from (
  select p_partkey as question_id, c_custkey as user_id, {score_sql('p_partkey', 'c_custkey')} as score,
         row_number() over (partition by p_partkey order by {score_sql('p_partkey', 'c_custkey')} desc, c_custkey) as rank
  from part, customer
  where not exists (select 1 from answers where question_id = p_partkey and user_id = c_custkey)) where rank <= 5"""))
def recommend_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best users who have not answered the question yet."""
    seen = views.answers(spark, sf_dir).select("question_id", "user_id")
    top = scoring.top_users(question_vectors(spark, sf_dir), user_vectors(spark, sf_dir), 5, exclude_seen=seen)
    return top.select("question_id", "user_id", "score", "rank")


def event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    users = views.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", vector(u % 3, u % 11), (u % 2).cast("double").alias("bias"))


def event_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question_id")
    return views.event_pairs(spark, sf_dir).select("question_id").distinct().select("question_id", vector(q % 7, q % 5 + 1))


def held_out() -> F.Column:
    """About one pair of five, by an order that has nothing to do with the classes of the ids."""
    return hash_order(5, "question_id", "user_id") < "3"


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.event_pairs(spark, sf_dir)
    return scoring.held_out_positions(
        event_questions(spark, sf_dir), event_users(spark, sf_dir), pairs.where(held_out()), pairs.where(~held_out())
    )


EVALUATED = (EVENT_PAIRS, """
cand as (select q.question_id, u.user_id, """ + score_sql("q.question_id", "u.user_id") + """ as score
         from (select distinct question_id from event_pairs) q, (select distinct user_id from event_pairs) u
         where not exists (select 1 from event_pairs e where e.question_id = q.question_id and e.user_id = u.user_id
                           and md5(concat('5:', e.question_id, ':', e.user_id)) >= '3'))""", """
test as (select question_id, user_id from event_pairs where md5(concat('5:', question_id, ':', user_id)) < '3')""", """
marked as (select c.*, t.user_id is not null as held,
                  row_number() over (partition by c.question_id order by score desc, c.user_id) as pos,
                  rank() over (partition by c.question_id order by score) as low,
                  count(*) over (partition by c.question_id, score) as ties
           from cand c left join test t on c.question_id = t.question_id and c.user_id = t.user_id)""", """
per_question as (
  select question_id,
         case when count_if(not held) = 0 then 0.5
              else (sum(case when held then low + (ties - 1) / 2.0::double end) - count_if(held) * (count_if(held) + 1) / 2.0::double)
                   / (count_if(held) * count_if(not held)) end as auc,
         count_if(held and pos <= 10) / 10.0::double as precision,
         count_if(held and pos <= 10) / count_if(held)::double as recall
  from marked group by 1 having count_if(held) > 0)""")


@register(sql_with(*EVALUATED, select="""
select question_id, user_id, score, pos - 1 as ahead, ties as equal from marked where held"""))
def held_out_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_positions(spark, sf_dir).select("question_id", "user_id", "score", "ahead", "equal")


def _metric(name: str):
    @register(sql_with(*EVALUATED, select=f"select question_id, round({name}, 6) as {name} from per_question"), name=f"{name}_per_question")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        per_question = metrics.question_metrics(event_positions(spark, sf_dir))
        return per_question.select("question_id", F.round(name, 6).alias(name))


for _name in metrics.METRICS:
    _metric(_name)


@register(sql_with(*EVALUATED, """
parts as (select case when question_id % 2 = 0 then 'cold_start' else 'warm_start' end as data_type, * from per_question
          union all select 'all', * from per_question)""", select="\nunion all ".join(
    f"select data_type, '{m}' as metric, round(avg({m}), 6) as value from parts group by 1" for m in metrics.METRICS)))
def metrics_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_question = metrics.question_metrics(event_positions(spark, sf_dir))
    kind = F.when(F.col("question_id") % 2 == 0, "cold_start").otherwise("warm_start")
    segments = event_questions(spark, sf_dir).select("question_id", kind.alias("data_type"))
    return metrics.metrics_by_segment(per_question, segments).withColumn("value", F.round("value", 6))


RESULTS = """
results as (select event_type as model, round(avg(value), 6) as auc from events group by 1)"""


@register(sql_with(RESULTS, select="select model, auc from results order by auc desc, model limit 1"))
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"))
    return metrics.best_model(means.agg(F.round(F.avg("value"), 6).alias("auc")))


TRACE = """
trace as (select cast(hour(ts) as integer) as epoch, round(avg(value), 2) as value from events group by 1)"""


def hourly_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of the events as a metric trace."""
    hourly = views.table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("epoch"))
    means = hourly.agg(F.round(F.avg("value"), 2).alias("value"))
    return means.withColumns({"stage": F.lit("validation"), "metric": F.lit("auc")})


@register(sql_with(TRACE, select="select epoch, value from trace order by value desc, epoch limit 1"))
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_epoch(hourly_trace(spark, sf_dir))


@register(sql_with(TRACE, select="select value from trace order by epoch desc limit 1"))
def last_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_value(hourly_trace(spark, sf_dir))
