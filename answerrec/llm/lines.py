"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerrec.llm.base import checkpoint, unused

SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends and with A-Z lowered; other letters stay."""
    bare = F.trim(line, F.lit(SPACES))
    plain = F.octet_length(bare) == F.char_length(bare)  # only ASCII: lower() touches A-Z alone
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, threshold: int = 2, min_chars: int = 10) -> DataFrame:
    """Every row of `docs` without the lines that occur in other documents.

    A line whose key (`line_key`) has at least `min_chars` code points and stands in at
    least `threshold` documents is dropped everywhere but in the smallest doc_id that holds
    it, where all its copies stay. Adds `n_lines`, `n_dropped` and `kept` (the remaining
    lines, joined by line breaks); the other columns stay.

    A null text counts as empty, and an empty text is one empty line. Rows without doc_id
    are not counted and keep all lines. Rows that share a doc_id are one document when
    lines are counted; each is returned. An empty table gives an empty table.

    Lines meet by 128 bits of hash; only ids, positions and hashes are shuffled for that,
    and each text once, to its dropped positions. Equal lines are counted map-side, and a
    line found everywhere is split by adaptive execution when it meets its count.
    """
    own, version, gone, whole, parts = unused(docs, "_id", "_version", "_gone", "_text", "_lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = (
        docs.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_version"), F.posexplode(text_lines(F.col("text"))).alias("_at", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_version", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("second"), "_key").alias("_h2"))
    )
    holders = lines.select("_id", "_h1", "_h2").groupBy("_h1", "_h2")
    if threshold == 2:  # two documents hold it exactly if the smallest and the largest id differ
        counted = holders.agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    else:
        counted = holders.agg(F.min("_id").alias("_first"), F.count_distinct("_id").alias("_docs")).where(F.col("_docs") >= threshold)
    # cut here: adaptive execution splits a hot line only if both sides of the join are plain shuffles
    counted = checkpoint(counted.select("_h1", "_h2", "_first"))
    dropped = (
        lines.join(counted, ["_h1", "_h2"])
        .where("_id > _first")
        .groupBy(F.col("_id").alias(own), F.col("_version").alias(version))
        .agg(F.collect_set("_at").alias(gone))
    )
    joined = docs.withColumn(whole, text).join(
        dropped, (F.col("doc_id") == F.col(own)) & (F.xxhash64(whole) == F.col(version)), "left"
    )
    places = F.sequence(F.lit(0), F.col("n_lines") - 1)
    left = F.array_except(places, gone)
    kept = F.array_join(F.transform(left, lambda at: F.get(parts, at)), "\n")
    return (
        joined.withColumn(parts, text_lines(F.col(whole)))
        .withColumn("n_lines", F.size(parts))
        .withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn("kept", F.when(F.col(gone).isNull(), F.col(whole)).otherwise(kept))
        .withColumn("n_lines", F.col("n_lines").cast("long"))
        .drop(own, version, gone, parts, whole)
    )
