"""What several corpus operators share: tables, checkpoints, bounded samples, one-task fits."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table at files in the folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder that decides whether a document is held out of training."""
    return F.crc32(doc_id.cast("string")) % parts


def labelled(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """`doc_id, text, label` of at most `limit` labelled documents outside the held-out fold.

    The documents are those whose ids come first in the order of a hash, so they depend on
    the data only. Ids with a null label are left out; of contradicting labels the larger
    counts. Only ids and labels of the sample (at most `limit` pairs) are broadcast.
    """
    ids = (
        labels.where((fold(F.col("doc_id"), 4) != 2) & F.col(target).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(target)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """Run `fit` over a sample of bounded size in one task and return what it learned.

    The rows reach `fit` in an order that depends on the data only.
    """
    columns = sample.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        rows = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=columns)
        if "doc_id" in rows:
            rows = rows.sort_values(["doc_id", "text"], ignore_index=True)
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows))]})

    found = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(pd.DataFrame(columns=columns))


def byte_slices(batch: pa.RecordBatch, column: int = 0, limit: int = 2**21) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have at most `limit` bytes together; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
