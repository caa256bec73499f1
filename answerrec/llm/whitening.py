"""Whitening of embeddings: principal components by spectrum slicing, scaled to unit variance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerrec.llm.dense import LONG, ROWS_AT_ONCE, integers, largest, long_or_none, sums, wide, whole
from answerrec.llm.spectrum import EPS, leading

COMPONENTS = 32
NUMBER = -1  # the key of the number of vectors among the sums


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def gram(x: np.ndarray) -> np.ndarray:
    """The exact products x'x of integers: in floating point where that is exact, else in longs, else in any size."""
    bound = largest(x) ** 2 * len(x)
    if bound < 2**53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = wide(x, bound)
    return (y.T @ y).astype(object)


class Centre:
    """The exact mean of integer vectors: whole numbers near it, and what is left, times n."""

    def __init__(self, totals: list[int], n: int):
        self.n = n
        self.near = [(2 * t + n) // (2 * n) for t in totals]
        self.rest = [t - n * m for t, m in zip(totals, self.near)]  # n times mean minus near; at most n/2

    def around(self, x: np.ndarray) -> np.ndarray:
        """x minus the whole numbers next to the mean."""
        bound = largest(x) + max((abs(m) for m in self.near), default=0)
        return wide(x, bound) - np.array(self.near, np.int64 if bound <= LONG.max else object)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x minus the sums, exactly."""
        y = self.around(x)
        bound = self.n * (largest(y) + 1)
        return wide(y, bound * bound * max(1, x.shape[1])) * self.n - np.array(self.rest, np.int64 if bound <= LONG.max else object)


def covariance(kept: DataFrame, centre: Centre, size: int, scale: int) -> np.ndarray:
    """The covariance, every entry the double nearest to its exact value."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        total = np.zeros((size, size), object)
        for some in slices(batches):
            total += gram(centre.around(integers(some.column(0), scale, size)))
        yield from ((i, j, total[i, j]) for i in range(size) for j in range(i, size))

    found = sums(kept.select("embedding"), ["i", "j"], part)
    out, n = np.zeros((size, size)), centre.n
    for (i, j), total in found.items():
        out[i, j] = out[j, i] = (n * total - centre.rest[i] * centre.rest[j]) / (n * n)
    return out


def identity_error(kept: DataFrame, project, size: int, scale: int, n: int, count: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, total = np.zeros((count, count)), np.zeros(count)
        for some in slices(batches):
            y = project(integers(some.column(0), scale, size))[1]
            products += y.T @ y
            total += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([products.ravel()]), pa.array([total])], names=["products", "total"])

    parts = kept.select("embedding").mapInArrow(run, "products array<double>, total array<double>")

    def added(column: str, length: int) -> np.ndarray:
        out = np.zeros(length)
        for r in parts.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r["at"]] = r["x"] / n
        return out

    mean, square = added("total", count), added("products", count * count)
    return float(np.abs(square.reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error`: a row per vector and component.

    Vectors that are null or hold null or non-finite entries are left out; each other entry c
    becomes the integer x = floor(scale * c), and all of these are fitted. (A constant added
    to every x, as some callers ask for, moves the sums S alone: no column depends on it.)
    Vectors shorter than the longest have entries 0 in the dimensions they lack. Components are unit
    eigenvectors of the covariance (divisor n), numbered from 1 by falling eigenvalue, at most
    `components` of them; `whitened` is the centred vector's projection divided by the root of
    the eigenvalue, `explained` the eigenvalue's share of the trace. Directions without
    variance (eigenvalues below 1e-11 of the largest) have no component, so a single vector,
    equal vectors and an empty table give no rows. `deviation` is the exact sum of (n x - S)^2,
    null if no long can hold it. Rows without vec_id and repeated rows are vectors like any
    other; other columns play no part.

    Sums and products are exact integers: entries are centred by the whole number next to the
    mean before they are multiplied, and the rest of the mean is taken off exactly. Three
    passes over the vectors gather d, d^2 and components^2 sums from each task; the last one
    projects. Only a d x d matrix reaches the driver.
    """
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    kept = vectors.where(whole(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    size = kept.agg(F.max(F.size("embedding")).alias("size")).first()["size"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        number, total = 0, np.zeros(size, object)
        for some in slices(batches):
            x = integers(some.column(0), scale, size)
            number += len(x)
            total += wide(x, largest(x) * len(x)).sum(axis=0)
        yield NUMBER, number
        yield from enumerate(total)

    if not size:
        return spark.createDataFrame([], result)
    totals = sums(kept.select("embedding"), ["dimension"], part)
    n = totals[NUMBER,]
    centre = Centre([totals[d,] for d in range(size)], n)
    matrix = covariance(kept, centre, size, scale)
    values, axes = leading(matrix, components)
    there = values > max(1e-11, 8 * EPS * size) * max(values[0], 0)
    values, axes = values[there], axes[there]
    if not len(values):
        return spark.createDataFrame([], result)
    weights = (axes / np.sqrt(values)[:, None]).T

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = centre.deviations(x)
        return away, (away.astype(np.float64) / n) @ weights

    error = identity_error(kept, project, size, scale, n, len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            away, y = project(integers(some.column(1), scale, size))
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())
            yield pa.RecordBatch.from_arrays([some.column(0), long_or_none((away * away).sum(axis=1)), lists], names=["vec_id", "deviation", "y"])

    rows = kept.mapInArrow(run, "vec_id long, deviation long, y array<double>")
    shares = F.array(*[F.lit(float(e)) for e in values / math.fsum(np.diag(matrix))])
    rows = rows.select("vec_id", "deviation", F.posexplode("y").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
