"""Vectors as exact integers: columns of floats as matrices, and sums that never overflow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Context
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 4_096
LONG = np.iinfo(np.int64)
EXACT = Context(prec=38)
DIGITS = pa.decimal128(38, 0)


def whole(x: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor infinities nor NaN."""
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(column: pa.Array, scale: int, size: int | None = None) -> np.ndarray:
    """A row of floor(scale * x) per vector; vectors shorter than `size` get zeros at the end.

    Integers that no long can hold become the nearest long.
    """
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if size is None else size
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    values = np.clip(flat, LONG.min, LONG.max - 1023).astype(np.int64)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def largest(x: np.ndarray) -> int:
    """The largest magnitude in an array of integers."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def wide(x: np.ndarray, bound: int) -> np.ndarray:
    """The array as it is if `bound` fits a long, else with integers of any size."""
    return x if bound <= LONG.max else x.astype(object)


def long_or_none(x: np.ndarray) -> pa.Array:
    return pa.array([int(v) if v <= LONG.max else None for v in x], pa.int64()) if x.dtype == object else pa.array(x)


def sums(rows: DataFrame, keys: list[str], part: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[Any, ...]]]) -> dict[tuple[int, ...], int]:
    """The exact sums, by key, of what `part` yields for each partition: (key, ..., integer).

    `part` yields a row per key and partition, and there are as many keys as the caller's
    matrix has entries, whatever the number of vectors.
    """
    names = [*keys, "total"]
    schema = pa.schema([*[(k, pa.int32()) for k in keys], ("total", DIGITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(*k, EXACT.create_decimal(int(total))) for *k, total in part(batches)]
        columns = list(zip(*found)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = rows.mapInArrow(run, ", ".join(f"{k} int" for k in keys) + ", total decimal(38,0)")
    found = parts.groupBy(*keys).agg(F.sum("total").alias("total")).collect()
    return {tuple(r[k] for k in keys): int(r["total"]) for r in found}


