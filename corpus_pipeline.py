"""From raw documents to tokens: quality, line dedup, near duplicates, decontamination, encoding.

Each stage reads what its predecessor kept, as a Parquet table in the folder that
spark.checkpoint.dir names, and its decisions take effect on the rows it returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.llm.base import table
from answerrec.llm.bpe import digest_texts
from answerrec.llm.decontam import decontaminate
from answerrec.llm.lines import dedup_lines
from answerrec.llm.neardup import keep_first, near_duplicates
from answerrec.llm.quality import score_quality, train_quality
from answerrec.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GOOD_FROM = 0.7
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7; a null text is scored as an empty one.

    A score depends on the text alone, so repeated rows stay or go together; long texts are
    scored whole, and a score of exactly 0.7 stays. An empty table gives an empty one.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model).where(F.col("score") >= GOOD_FROM).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds; a null text becomes empty."""
    clean = dedup_lines(docs.select(*COLUMNS)).drop("text").withColumnRenamed("kept", "text")
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id; rows without id go."""
    return keep_first(docs.select(*COLUMNS), near_duplicates(docs)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Every row is judged by its own whole text, however long: repeated rows stay or go together,
    null and empty texts stay. A text within the error budget goes, also at its very edge.
    """
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: number of tokens, and digests of the ids and of the decoded text.

    A null text counts as empty (no tokens); repeated rows give repeated results, long texts are
    encoded whole, an empty table gives an empty one.
    """
    return digest_texts(docs.select("doc_id", "text"), VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: SQL cannot express the classifier, the near duplicates or the encoding; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return docs
