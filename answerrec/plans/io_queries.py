"""Registered queries: tables written in each format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.plans import views
from answerrec.plans.catalogue import register
from answerrec.plans.split_queries import ALL, COLD, PREP, WARM, assembled_rows
from answerrec.plans.views import ANSWERS, USERS, sql_with
from answerrec.session import shared_folder
from answerrec.sources import tables


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def texts_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All answers; the first line of an order carries the document of the order's number."""
    documents = views.table(spark, sf_dir, "documents").select((F.col("doc_id") * 8 + 1).alias("answer_id"), "text")
    return views.answers(spark, sf_dir).join(documents, "answer_id", "left")


TEXTS = """
texts as (select answers.*, text from answers left join documents on answer_id = doc_id * 8 + 1)"""


@register(sql_with(ANSWERS, TEXTS, select="select answer_id, user_id, question_id, text, cast(score as integer) as score, date from texts"))
def json_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as JSON lines of quoted values, read with their types."""
    rows = texts_of_answers(spark, sf_dir)
    quoted = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    path = tables.write_table(quoted, fresh(spark, "answers"), "json")
    return tables.read_json_lines(spark, path, "answers")


@register(sql_with(ANSWERS, TEXTS, select="select answer_id, user_id, question_id, text, score, date from texts"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts_of_answers(spark, sf_dir)
    path = tables.write_table(rows, fresh(spark, "answers"), "csv")
    return tables.read_csv(spark, path, rows.schema)


@register(sql_with(USERS, select="select cast(id as varchar) as id, location, cast(reputation as varchar) as reputation from users"))
def delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.users(spark, sf_dir).select("id", "location", "reputation")
    path = fresh(spark, "users")
    rows.write.csv(path, sep=";", header=True)
    return tables.read_delimited(spark, path, rows.columns)


@register(sql_with(*PREP, *COLD, *WARM, *ALL, select="""
select answer_id, question_id, split, data_type from assembled"""))
def split_bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_split(assembled_rows(spark, sf_dir), fresh(spark, "datasets"))
    rows = tables.read_split(spark, path)
    return rows.select("answer_id", "question_id", "split", "data_type")


@register(sql_with(ANSWERS, select="select question_id, count(*) as answers, '2' as run_id from answers group by 1"))
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh(spark, "runs")
    counts = views.answers(spark, sf_dir).groupBy("question_id").agg(F.count(F.lit(1)).alias("answers"))
    for number in ["1", "2"]:
        tables.write_run(counts if number == "2" else counts.where("answers > 1"), root, number)
    return tables.read_latest_run(spark, root)
