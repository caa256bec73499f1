"""Arithmetic on array columns.

Products run as loops over arrays: written out per element they compile to methods too
long for the JVM's compiler. Element-wise sums are separate aggregates, so partial sums
combine before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero. The length is bound once."""
    length = F.sqrt(dot(a, a))
    safe = F.transform(F.array(F.when(length > 0, length).otherwise(F.lit(1.0))), lambda n: F.transform(a, lambda x: x / n))
    return F.get(safe, F.lit(0))


def vector_sum(vector: Column, dim: int) -> Column:
    """Aggregate: element-wise sum."""
    return F.array(*[F.sum(F.get(vector, F.lit(i))) for i in range(dim)])


def mix(a: Column, b: Column, wa: float, wb: float) -> Column:
    """(wa·a + wb·b) / (wa + wb)"""
    return F.zip_with(a, b, lambda x, y: (x * wa + y * wb) / (wa + wb))
