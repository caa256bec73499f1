"""Reading the base relations and reading or writing derived tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerrec.errors import InputDataError, need_columns, need_option

# the three base relations: column -> type. JSON files hold every value as quoted text.
RELATIONS = {
    "answers": {"answer_id": "bigint", "user_id": "bigint", "question_id": "bigint", "text": "string",
                "date": "timestamp_ntz", "score": "int"},
    "questions": {"question_id": "bigint", "title": "string", "text": "string", "owner_user_id": "bigint",
                  "accepted_answer_id": "bigint"},
    "users": {"id": "bigint", "reputation": "bigint", "up_votes": "bigint", "down_votes": "bigint", "views": "bigint",
              "location": "string", "about_me": "string"},
}
FORMATS = ("parquet", "csv", "json")


def read_json_lines(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """One JSON object per line, every field read as text and cast; what cannot be cast is
    null. A missing path raises at once, a broken line when rows are read."""
    if relation not in RELATIONS:
        raise InputDataError(f"unknown relation {relation!r}; known: {', '.join(RELATIONS)}")
    columns = RELATIONS[relation]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    try:
        raw = spark.read.schema(schema).json(path, mode="FAILFAST")
    except AnalysisException as error:
        raise InputDataError(f"cannot read {path}") from error
    return raw.select(*[F.expr(f"try_cast({name} as {kind})").alias(name) for name, kind in columns.items()])


def read_base(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three relations from `answers.json`, `questions.json` and `users.json`."""
    return {name: read_json_lines(spark, f"{folder}/{name}.json", name) for name in RELATIONS}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV table with header; the schema is given, so no pass is spent on guessing.

    Fields may hold line breaks, so a file is read by one task: write many files, not one.
    """
    try:
        return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", escape='"', multiLine=True)
    except AnalysisException as error:
        raise InputDataError(f"cannot read {path}") from error


def read_delimited(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """A `;`-separated file with header, all text; malformed rows do not stop the
    scan, and bytes that cannot be decoded are dropped."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    try:
        rows = spark.read.csv(path, sep=";", header=True, schema=schema, mode="PERMISSIVE", encoding=encoding)
        return rows.select(*[F.replace(F.col(f"`{name}`"), F.lit("\ufffd"), F.lit("")).alias(name) for name in columns])
    except AnalysisException as error:
        raise InputDataError(f"cannot read {path}") from error


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Write a frame; arrays become JSON text in CSV, which has no arrays."""
    need_option(fmt, FORMATS)
    if not isinstance(df, DataFrame):
        raise ValueError("only a DataFrame can be written")
    if fmt == "csv":
        arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
        df = df.select(*[F.to_json(c).alias(c) if c in arrays else F.col(c) for c in df.columns])
    writer = df.write.mode("overwrite").partitionBy(*partition_by).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.save(path)
    return path


def write_values(spark: SparkSession, values: dict, path: str) -> str:
    """Write a small dictionary (metrics, parameters) as one JSON row."""
    if not isinstance(values, dict):
        raise ValueError("only a dictionary can be written")
    spark.createDataFrame([(json.dumps(values, default=str),)], "value string").write.mode("overwrite").text(path)
    return path


def write_split(assembled: DataFrame, path: str) -> str:
    """The split datasets as one table, one folder per split and data type, so that a
    reader of one part opens only its files."""
    need_columns(assembled.columns, "split", "data_type")
    named = assembled.withColumn("data_type", F.coalesce("data_type", F.lit("none")))
    return write_table(named, path, partition_by=("split", "data_type"))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("data_type", F.when(F.col("data_type") != "none", F.col("data_type")))


def run_name() -> str:
    """A name that sorts by time."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def write_run(df: DataFrame, root: str, run_id: str | None = None) -> str:
    """Write one run of a table below `root`; a run counts once its _SUCCESS file exists."""
    return write_table(df, f"{root}/run_id={run_id or run_name()}")


def read_latest_run(spark: SparkSession, root: str) -> DataFrame:
    """The run that finished last, by the time of its success mark; of equal times the larger name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop.Path(f"{root}/run_id=*/_SUCCESS"))
    done = sorted((status.getModificationTime(), status.getPath().getParent().toString()) for status in found or [])
    runs = [path for _, path in done]
    if not runs:
        raise InputDataError(f"no finished run in {root}")
    return spark.read.parquet(runs[-1]).withColumn("run_id", F.lit(runs[-1].rsplit("run_id=", 1)[1]))


def write_predictions(predictions: DataFrame, folder: str, fmt: str = "parquet") -> str:
    """Ranked users per question in a folder named after the time."""
    need_columns(predictions.columns, "question_id", "user_ids")
    return write_table(predictions, f"{folder}/{run_name()}", fmt)
