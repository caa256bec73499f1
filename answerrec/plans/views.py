"""The three base relations (answers, questions, users) over the given tables.

Each view exists twice: as a DataFrame and, for the checks, as the text of a SQL
common table expression over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per (order, line number); quantity gives the score, the customer answers."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    merged = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("question_id"),
        F.max("l_quantity").alias("quantity"),
        F.max("l_shipdate").alias("date"),
    )
    return merged.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("answer_id"),
        F.col("o_custkey").alias("user_id"),
        "question_id",
        (F.floor("quantity") - 25).alias("score"),
        "date",
    )


ANSWERS = """
answers as (
  select l_orderkey * 8 + l_linenumber as answer_id, min(o_custkey) as user_id, min(l_partkey) as question_id,
         cast(floor(max(l_quantity)) as bigint) - 25 as score, max(l_shipdate) as date
  from lineitem join orders on l_orderkey = o_orderkey group by 1)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per part; its accepted answer is a low-scored one, null for some."""
    accepted = (
        answers(spark, sf_dir)
        .where((F.col("score") < 1) & (F.col("answer_id") % 5 == 0))
        .groupBy("question_id")
        .agg(F.min("answer_id").alias("accepted_answer_id"))
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"),
        F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 500).alias("owner_user_id"),
    )
    return parts.join(accepted, "question_id", "left")


QUESTIONS = """
accepted as (
  select question_id, min(answer_id) as accepted_answer_id from answers
  where score < 1 and answer_id % 5 = 0 group by question_id),
questions as (
  select p_partkey as question_id, p_name as title,
         case when p_partkey % 7 <> 0 then p_partkey % 500 end as owner_user_id, accepted_answer_id
  from part left join accepted on p_partkey = question_id)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer; the text about a user is the document of the same number."""
    about = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("about_me"))
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.floor("c_acctbal").alias("reputation"),
        (F.floor(F.abs("c_acctbal")) % 1000).alias("up_votes"),
        F.col("c_nationkey").cast("bigint").alias("down_votes"),
        (F.col("c_custkey") % 100).alias("views"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("location"),
    )
    return customers.join(about, F.col("id") == F.col("doc_id"), "left").drop("doc_id")


USERS = """
users as (
  select c_custkey as id, cast(floor(c_acctbal) as bigint) as reputation,
         cast(floor(abs(c_acctbal)) as bigint) % 1000 as up_votes, cast(c_nationkey as bigint) as down_votes,
         c_custkey % 100 as views, case when c_custkey % 2 = 0 then c_mktsegment end as location, text as about_me
  from customer left join documents on c_custkey = doc_id)"""


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense interactions from events: (question_id, user_id, weight), one row per pair."""
    events = table(spark, sf_dir, "events").select(
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("question_id"), "user_id"
    )
    return events.groupBy("question_id", "user_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))


EVENT_PAIRS = """
event_pairs as (
  select cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as question_id, user_id,
         cast(count(*) as double) as weight from events group by 1, 2)"""

# positive answers with counts and labels, as `preprocessed`
PREPROCESSED = """
flagged as (
  select a.*, n.accepted_answer_id, case when n.accepted_answer_id is null then 0 else 1 end as is_accepted_answer
  from answers a left join (select distinct accepted_answer_id from questions) n on answer_id = n.accepted_answer_id),
counted as (
  select *, count(answer_id) over (partition by question_id) as number_answers_per_question from flagged),
positive as (select * from counted where score >= 1 or is_accepted_answer = 1),
limits as (
  select quantile_cont(n, 0.99) as high, quantile_cont(n, 0.7) as medium
  from (select question_id, min(number_answers_per_question) as n from positive group by 1)),
preprocessed as (
  select p.*, case when number_answers_per_question >= high then 'High'
                   when number_answers_per_question >= medium then 'Medium' else 'Low' end as question_label
  from positive p, limits)"""


def sql_with(*parts: str, select: str) -> str:
    return "with " + ",".join(parts) + "\n" + select
