"""Registered queries: id dictionaries, interactions and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.operators import features, prep
from answerrec.plans import views
from answerrec.plans.catalogue import register
from answerrec.plans.text_queries import TAGS, TITLE_KEPT, question_tags, tags_sql, tfidf_sql, top_sql
from answerrec.plans.views import ANSWERS, PREPROCESSED, QUESTIONS, USERS, sql_with

PREP = (ANSWERS, QUESTIONS, PREPROCESSED)
TAGGED = (ANSWERS, QUESTIONS, TITLE_KEPT, tfidf_sql("title_kept", "questions"), top_sql(),
          f"tagged as ({tags_sql('questions', 'question_id')})")


@register(sql_with(USERS, select="""
select 'user' as side, id, row_number() over (order by md5('0:' || id), id) - 1 as idx from users
union all
select 'question', p_partkey, row_number() over (order by md5('0:' || p_partkey), p_partkey) - 1 from part"""))
def id_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = features.dense_ids(views.users(spark, sf_dir), "id").withColumn("side", F.lit("user"))
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return users.unionByName(features.dense_ids(parts, "id").withColumn("side", F.lit("question")))


def _bucket_sql(c: str) -> str:
    size = f"cast(floor(log2(abs({c}) + 1)) as bigint)"
    return f"'{c}=' || (case when {c} < 0 then -{size} else {size} end)"


NUMBERS = ", ".join(map(_bucket_sql, features.USER_NUMBERS))
NORMALISE = """
select entity_id, feature, count(*) / sum(count(*)) over (partition by entity_id) as weight
from named where feature is not null group by entity_id, feature"""


@register(sql_with(USERS, f"named as (select id as entity_id, unnest(['id=' || id, {NUMBERS}]) as feature from users)",
                   select=NORMALISE))
def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.user_features(views.users(spark, sf_dir))


RAW = ", ".join(f"cast({c} as varchar)" for c in features.USER_NUMBERS)


@register(sql_with(USERS, f"named as (select id as entity_id, unnest(['id=' || id, {RAW}]) as feature from users)",
                   select=NORMALISE))
def user_features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.user_features(views.users(spark, sf_dir), names="raw")


TAG_NAMES = ", ".join(f"'tag=' || {t}" for t in TAGS)


@register(sql_with(*TAGGED, f"""named as (
  select question_id as entity_id, unnest(['id=' || question_id, {TAG_NAMES}]) as feature from tagged)""", select=NORMALISE))
def question_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.question_features(question_tags(spark, sf_dir), TAGS)


@register(sql_with(*TAGGED, f"""
named as (select unnest([{TAG_NAMES}]) as feature from tagged)""", select="""
select distinct feature from named where feature is not null"""))
def question_feature_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_vocabulary(question_tags(spark, sf_dir), TAGS)


@register("""
with named as (select p_partkey as entity_id, unnest(['id=' || p_partkey, 'p_brand=' || p_brand, 'p_type=' || p_type]) as feature
               from part)""" + NORMALISE)
def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attributes of an item as features, as with author and publisher of a book."""
    return features.entity_features(views.table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"])


def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = prep.accepted_flag(views.answers(spark, sf_dir), views.questions(spark, sf_dir))
    return features.interactions(prep.positive_interactions(flagged))


PAIRS = """
pairs as (select question_id, user_id, cast(sum(greatest(score, 1)) as double) as weight from positive group by 1, 2)"""


@register(sql_with(*PREP, PAIRS, select="select * from pairs"))
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive_pairs(spark, sf_dir)


@register(sql_with(*PREP, PAIRS, select="""
select round(1 - (select count(*) from pairs)::double / ((select count(*) from part)::double * (select count(*) from customer)), 9)
  as sparsity"""))
def sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = positive_pairs(spark, sf_dir)
    value = features.sparsity(pairs, views.questions(spark, sf_dir), views.users(spark, sf_dir))
    return value.select(F.round("sparsity", 9).alias("sparsity"))


@register("select 'questions' as side, count(*) as entities from part union all select 'users', count(*) from customer")
def interactions_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.interactions_shape(views.questions(spark, sf_dir), views.users(spark, sf_dir))


@register("""
select distinct 'user' as side, user_id as id from events where user_id not in (select c_custkey from customer)
union all
select distinct 'question', cast(regexp_extract(props, '([0-9]+)', 1) as bigint) from events
where cast(regexp_extract(props, '([0-9]+)', 1) as bigint) not in (select s_suppkey from supplier where s_nationkey < 20)""")
def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = views.table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("question_id"))
    users = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return features.unknown_ids(views.event_pairs(spark, sf_dir), known, users)
