"""Registered queries: exploratory statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.functions.text import strip_html
from answerrec.operators import prep, profile
from answerrec.plans import views
from answerrec.plans.catalogue import register
from answerrec.plans.prep_queries import flagged
from answerrec.plans.views import ANSWERS, PREPROCESSED, QUESTIONS, USERS, sql_with

# fixed values: frequent words of the given texts, left out of word counts
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "for", "with", "as", "was", "on", "be", "at", "by",
              "this", "are", "or", "an", "not", "from", "but"]
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"

NUMERIC = ["reputation", "up_votes", "down_votes", "views"]
PREP = (ANSWERS, QUESTIONS, PREPROCESSED)

STRIP_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)</?[A-Za-z!](?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')|=)*>', '', 'g')"""
for _entity, _char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"),
                       ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&hellip;", "…"),
                       ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")]:
    STRIP_SQL = f"replace({STRIP_SQL}, '{_entity}', '{_char}')"
TOKENS_SQL = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}_]{{2,}}')"


def describe_sql(source: str, columns: list[str], percentiles: list[float]) -> str:
    parts = []
    for c in columns:
        v = f"cast({c} as double)"
        stats = {"count": f"cast(count({c}) as double)", "mean": f"avg({v})", "std": f"stddev_samp({v})", "min": f"min({v})",
                 "max": f"max({v})"}
        stats |= {f"{round(p * 100)}%": f"quantile_cont({v}, {p})" for p in percentiles}
        parts += [f"select '{c}' as \"column\", '{k}' as statistic, round({e}, 4) as value from {source}" for k, e in stats.items()]
    return "\nunion all ".join(parts)


def rounded(described: DataFrame) -> DataFrame:
    return described.withColumn("value", F.round("value", 4))


@register(sql_with(USERS, select=describe_sql("users", NUMERIC, profile.DECILES)))
def describe_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.describe(views.users(spark, sf_dir), NUMERIC))


SCORE_POINTS = [0.05, 0.1, 0.5, 0.7, 0.8, 0.9, 0.92, 0.94, 0.96, 0.98, 1.0]


@register(sql_with(ANSWERS, select=describe_sql("answers", ["score"], SCORE_POINTS)))
def describe_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.describe(views.answers(spark, sf_dir), ["score"], SCORE_POINTS))


@register(describe_sql("orders", ["o_totalprice"], profile.DECILES))
def describe_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of almost only distinct values."""
    return rounded(profile.describe(views.table(spark, sf_dir, "orders"), ["o_totalprice"]))


@register(sql_with(ANSWERS, "per_user as (select count(answer_id) as answers from answers group by user_id)",
                   select=describe_sql("per_user", ["answers"], profile.DECILES)))
def describe_answers_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prep.rows_per_key(views.answers(spark, sf_dir), "user_id", "answer_id", "answers")
    return rounded(profile.describe(counts, ["answers"]))


USER_COLUMNS = ["id", *NUMERIC, "location", "about_me"]


@register(sql_with(USERS, select="\nunion all ".join(
    f"select '{c}' as \"column\", count({c}) as non_null, count(*) - count({c}) as nulls from users" for c in USER_COLUMNS)))
def nonnull_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.non_null_counts(views.users(spark, sf_dir).select(*USER_COLUMNS))


ID_COLUMNS = ["answer_id", "user_id", "question_id", "score"]


@register(sql_with(ANSWERS, select="\nunion all ".join(
    f"select '{c}' as \"column\", count(distinct {c}) as distinct_values from answers" for c in ID_COLUMNS)))
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(views.answers(spark, sf_dir), ID_COLUMNS)


@register(sql_with(USERS, select="\nunion all ".join(
    f"select '{c}' as \"column\", cast(floor(count_if({c} is null) * 100.0 / count(id)) as bigint) as percent from users"
    for c in ["location", "about_me"])))
def percent_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percent_missing(views.users(spark, sf_dir), ["location", "about_me"], "id")


@register(sql_with(ANSWERS, QUESTIONS, USERS, select="""
select 'answerers' as who, (select count(distinct user_id) from answers) * 100 // count(distinct id) as percent from users
union all
select 'askers', (select count(distinct owner_user_id) from questions) * 100 // count(distinct id) from users"""))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = views.users(spark, sf_dir)
    answerers = profile.coverage(views.answers(spark, sf_dir), "user_id", users, "id")
    askers = profile.coverage(views.questions(spark, sf_dir), "owner_user_id", users, "id")
    return answerers.withColumn("who", F.lit("answerers")).unionByName(askers.withColumn("who", F.lit("askers")))


@register(sql_with(*PREP, """left_rows as (
  select t as score, flagged.* exclude (score) from flagged, range(1, 11) s(t) where flagged.score >= t or is_accepted_answer = 1)""",
                   select="""
select cast(score as integer) as score, 'remaining_answers_%' as category,
       count(answer_id) * 100 // (select count(answer_id) from flagged) as percentage from left_rows group by score
union all
select cast(score as integer), 'remaining_users_%',
       count(distinct user_id) * 100 // (select count(distinct user_id) from flagged) from left_rows group by score
union all
select cast(score as integer), 'remaining_questions_%',
       count(distinct question_id) * 100 // (select count(distinct question_id) from flagged) from left_rows group by score"""))
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.threshold_sweep(flagged(spark, sf_dir))


def _distinct_sql(name: str, condition: str) -> str:
    return "\nunion all ".join(
        f"select '{name}' as condition, '{k}' as entity, count(distinct case when {condition} then {k} end) as entities from both_counts"
        for k in ["user_id", "question_id"])


@register(sql_with(*PREP, """both_counts as (
  select *, count(answer_id) over (partition by user_id) as user_answers,
         count(answer_id) over (partition by question_id) as question_answers from flagged)""",
                   select="\nunion all ".join([
                       _distinct_sql("users_2_answers", "user_answers >= 2"),
                       _distinct_sql("questions_3_answers", "question_answers >= 3"),
                       _distinct_sql("positive_at_2", "score >= 2 or is_accepted_answer = 1")])))
def conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    both = prep.with_count(rows, rows, "question_id", "answer_id", "question_answers")
    both = prep.with_count(both, rows, "user_id", "answer_id", "user_answers")
    return profile.conditional_distinct(both)


@register(sql_with(*PREP, select="select question_label, count(answer_id) as rows from preprocessed group by 1"))
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.preprocess(views.answers(spark, sf_dir), views.questions(spark, sf_dir))
    return profile.label_counts(rows, "question_label", "answer_id")


@register(sql_with(ANSWERS, select="""
select cast(least(floor(score + 10), 58) - 10 as bigint) as bin, count(*) as rows from answers
where score >= -10 and score <= 49 group by 1"""))
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(views.answers(spark, sf_dir), "score", -10, 50, 1)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their title, the document of the same number (null if there is none), and the accepted flag."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    questions = views.questions(spark, sf_dir).join(documents, F.col("question_id") == F.col("doc_id"), "left")
    return questions.select(
        "question_id",
        profile.word_length(F.col("title")).alias("title_len"),
        profile.word_length(strip_html(F.col("text"))).alias("text_len"),
        F.col("accepted_answer_id").isNotNull().cast("int").alias("is_accepted_answer"),
    )


TEXTS = f"""
texts as (
  select question_id, len(string_split(title, ' ')) as title_len,
         len(string_split({STRIP_SQL.format('text')}, ' ')) as text_len,
         case when accepted_answer_id is null then 0 else 1 end as is_accepted_answer
  from questions left join documents on question_id = doc_id)"""


@register(sql_with(ANSWERS, QUESTIONS, TEXTS, select="select * from texts"))
def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir)


@register(sql_with(ANSWERS, QUESTIONS, TEXTS, select="""
select is_accepted_answer, cast(least(text_len // 20, 98) * 20 as bigint) as bin, count(*) as rows from texts
where text_len between 0 and 1980 group by 1, 2"""))
def length_histogram_by_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(texts(spark, sf_dir), "text_len", 0, 2000, 20, by=["is_accepted_answer"])


@register(sql_with(USERS, select=f"""
select id, case when coalesce(about, '') = '' then 0 else len(string_split(about, ' ')) end as about_len
from (select id, {STRIP_SQL.format('about_me')} as about from users)"""))
def about_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = strip_html(F.col("about_me"))
    return views.users(spark, sf_dir).select("id", profile.word_length(about, empty_as_zero=True).alias("about_len"))


@register(f"""
select word, count(*) as occurrences from (select unnest({TOKENS_SQL.format('text')}) as word from documents)
where word not in {STOP_SQL} group by word order by occurrences desc, word limit 1000""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.word_frequency(views.table(spark, sf_dir, "documents"), "text", 1000, STOP_WORDS)


@register(sql_with(USERS, select="""
select location from users where location is not null order by location"""))
def sorted_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.users(spark, sf_dir).select("location").dropna().orderBy("location")
