"""Centroid clustering with tables of squared differences.

Vectors of integers are stored in blocks, dictionary-encoded: for each dimension the values
that occur in the block, and the place of each vector's value among them. A round tabulates,
for each dimension, the squared difference of each occurring value to each centroid; the
distances of a block are then gathers from these tables, added up over the dimensions. Sums
per cluster come from the same dictionaries, as counts of places times values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerrec.llm.base import checkpoint
from answerrec.llm.dense import LONG, ROWS_AT_ONCE, integers, largest, long_or_none, sums, whole

BLOCK = pa.schema([("ids", pa.binary()), ("places", pa.binary()), ("values", pa.binary()), ("starts", pa.binary())])


def encode(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """A block: ids, places (uint16, dimension by dimension), occurring values, and where each dimension's begin."""
    values, places = zip(*(np.unique(column, return_inverse=True) for column in x.T)) if x.shape[1] else ((), ())
    starts = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64)))
    body = [ids, np.array(places, np.uint16), np.concatenate([np.empty(0, np.int64), *values]), starts]
    return pa.RecordBatch.from_arrays([pa.array([b.tobytes()]) for b in body], schema=BLOCK)


class Block:
    """A decoded block."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        ids, places, values, starts = (batch.column(i)[row].as_buffer() for i in range(4))
        self.ids = np.frombuffer(ids, np.int64)
        self.starts = np.frombuffer(starts, np.int64)
        self.values = np.frombuffer(values, np.int64)
        self.places = np.frombuffer(places, np.uint16).reshape(len(self.starts) - 1, len(self.ids))

    def occurring(self, dimension: int) -> np.ndarray:
        return self.values[self.starts[dimension] : self.starts[dimension + 1]]

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """The squared distance of each vector to each centroid, exact at any size."""
        reach = largest(self.values) + largest(centroids)
        kind = np.int64 if reach * reach * len(self.places) <= LONG.max else object
        total = np.zeros((len(self.ids), len(centroids)), kind)
        for d, places in enumerate(self.places):
            table = (self.occurring(d).astype(kind)[:, None] - centroids[None, :, d].astype(kind)) ** 2
            total += table[places]
        return total

    def cluster_sums(self, cluster: np.ndarray, count: int) -> np.ndarray:
        """The sum of each cluster's vectors, dimension by dimension, as integers of any size."""
        kind = np.int64 if largest(self.values) * len(self.ids) <= LONG.max else object
        out = np.zeros((count, len(self.places)), kind)
        for d, places in enumerate(self.places):
            occurring = self.occurring(d)
            number = np.bincount(cluster * len(occurring) + places, minlength=count * len(occurring))
            out[:, d] = number.reshape(count, -1).astype(kind) @ occurring.astype(kind)
        return out.astype(object)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row)


def stored(kept: DataFrame, scale: int) -> DataFrame:
    """The vectors as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                yield encode(some.column(0).to_numpy(zero_copy_only=False), integers(some.column(1), scale))

    return kept.select("vec_id", "embedding").mapInArrow(run, "ids binary, places binary, values binary, starts binary")


def start(kept: DataFrame, clusters: int, scale: int, seed: int) -> np.ndarray:
    """The integer vectors whose ids come first by hash; of one id's vectors the smaller first."""
    named = kept.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    ids = {r["vec_id"] for r in named.orderBy("h").select("vec_id").limit(clusters).collect()}
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")))
    first = named.where(F.col("vec_id").isin(*ids)).select("h", x.alias("x")).orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in first], object)


def centroid_clusters(vectors: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: int = 3) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid` of each vector.

    Vectors with exactly `size` components, none null or non-finite, become integers
    floor(scale * x); others, and rows without vec_id, are left out. The first centroids are
    the vectors with the smallest sha256 of `seed:vec_id` (repeated ids: the smaller vector
    first). A round assigns every vector to the nearest centroid (ties: the smaller number) and
    replaces each centroid that has vectors by the floor of their mean. After the rounds all are
    assigned once more. With fewer vectors than clusters there are as many clusters as vectors.
    Repeated rows are vectors of their own; an empty table gives an empty result; other columns
    play no part. All sums are exact; a distance or inertia that no long can hold is null.

    The vectors are read once and kept as encoded blocks in the checkpoint folder. A round is
    one job over the blocks; clusters x (size + 1) sums leave a task, and as many reach the
    driver. Nothing depends on how vectors fall into clusters, so a cluster that holds nearly
    all of them costs no more than even ones.
    """
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == size) & whole(F.col("embedding")))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = start(kept, clusters, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], result)
    table = checkpoint(stored(kept, scale))
    for _ in range(rounds):
        moved = means(table, centroids)
        if np.array_equal(moved, centroids):
            break  # so would all further rounds
        centroids = moved
    assigned = checkpoint(nearest(table, centroids))
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    long = lambda total: total if total is not None and total <= LONG.max else None
    own = {r["cluster"]: long(None if r["lost"] else int(r["own"])) for r in inertia}
    total = long(None if None in own.values() else sum(own.values()))
    rows = [(k, own[k], total, [int(c) for c in centroids[k]]) for k in own]
    facts = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # a row per cluster
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    count, size = centroids.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        number, total = np.zeros(count, np.int64), np.zeros((count, size), object)
        for block in blocks(batches):
            cluster = block.distances(centroids).argmin(axis=1)
            number += np.bincount(cluster, minlength=count)
            total += block.cluster_sums(cluster, count)
        for k in np.flatnonzero(number):
            yield int(k), size, int(number[k])
            yield from ((int(k), d, total[k, d]) for d in range(size))

    found = sums(table, ["cluster", "dimension"], part)
    moved = centroids.copy()
    for k in {k for k, _ in found}:
        moved[k] = [found[k, d] // found[k, size] for d in range(size)]
    return moved


def nearest(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            distance = block.distances(centroids)
            cluster = distance.argmin(axis=1)
            least = distance[np.arange(len(cluster)), cluster]
            columns = [pa.array(block.ids), pa.array(cluster.astype(np.int32)), long_or_none(least)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")
