"""Exact top-k by inner product over a pivot-distance index.

The largest inner product is the smallest distance once every vector gets one more
component that fills its squared length up to that of the longest: then
|q - v|^2 = |q|^2 + longest^2 - 2 q.v. So every vector is keyed by its nearest pivot and its
distance from it. A cell is one pivot and one ring of distances; by the triangle inequality
no vector of a cell is nearer to a query than the gap between the query's distance from the
pivot and the ring. Queries visit the cells in the order of that bound and stop when it
passes their k-th best distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerrec.llm.base import checkpoint

PIVOT_SAMPLE = 4_000  # vectors that the pivots are chosen from
FEWEST_PIVOTS, MOST_PIVOTS = 32, 1_024  # in between, an eighth of the root of the number of vectors
RINGS = 8
FLOAT_EXACT, LONG_EXACT = 2.0**52, 2.0**62  # squared lengths up to which products are exact in these types
CELL_ROWS = 2_048  # vectors of a cell that one task row group compares
QUERY_ROWS = 512


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with v the components as integers floor(scale * x).

    Vectors that are null, or hold null or non-finite components, and rows without id are
    left out.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def matrix(column: pd.Series, size: int, kind: type = np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind).reshape(len(column), size)


def exact_products(q: pd.Series, v: pd.Series, size: int, longest: float) -> np.ndarray:
    """All inner products of integer vectors, exact: in doubles or longs where these hold them, else in integers of any size."""
    kind = np.float64 if longest < FLOAT_EXACT else np.int64 if longest < LONG_EXACT else object
    return matrix(q, size, kind) @ matrix(v, size, kind).T


def best_of_row(score: np.ndarray, wanted: np.ndarray, k: int) -> list[int]:
    """The places of the k largest integers among the wanted, of equal ones the first."""
    return sorted(np.flatnonzero(wanted).tolist(), key=lambda i: -int(score[i]))[:k]


def pivot_count(rows: int) -> int:
    return min(MOST_PIVOTS, max(FEWEST_PIVOTS, int(rows**0.5 / 8)))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the sampled vector furthest from those chosen."""
    chosen = [0]
    gap = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    centres = sample[chosen]
    for _ in range(4):  # a few rounds of k-means move them into the middle of what is near
        nearest = distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all rows of x and of y."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def raised(x: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the component that fills their length up."""
    return np.concatenate((x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]), axis=1)


def top_inner_products(vectors: DataFrame, k: int = 20, queries: Column | None = None, scale: int = 64, audit: list[float] | None = None) -> DataFrame:
    """`query_id, rank, vec_id, score` of the k largest integer inner products of each query.

    Vectors are quantised to floor(scale * x). Queries are the rows where `queries` holds (by
    default a vec_id divisible by 20); a query is not its own candidate, by its id; ties go to
    the smaller vec_id. Every row is a candidate of its own, also one that repeats an id; rows
    that share a queried id are ranked together. With fewer than k candidates all are returned,
    for a single vector none. Vectors that are null or hold null or non-finite components take
    no part. Vectors of another length than the longest have zeros in the components they lack.
    Scores are exact at any size; one that no long can hold is null. An empty table gives an
    empty result.

    The pivots come from a sample of about PIVOT_SAMPLE vectors, drawn by a hash of the id;
    their number grows with the root of the table's rows. Every vector is indexed and the
    result is exact. Cells with more rows than a task should hold are cut by a number of the
    row, and so are the queries that visit one cell, so equal vectors or ids, however many, are
    spread. The only broadcasts are the pivots and one row of bounds per cell. `audit`, if
    given, gets the share of all pairs of queries and rows that were compared.
    """
    queries = F.col("vec_id") % 20 == 0 if queries is None else queries
    whole = quantised(vectors, scale)
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    stats = whole.agg(F.max(square).alias("longest"), F.max(F.size("v")).alias("size"), F.count("*").alias("rows")).first()
    longest, size, rows = float(stats["longest"] or 0), int(stats["size"] or 0), stats["rows"]
    result = "query_id long, rank int, vec_id long, score long"
    if not size:
        return spark.createDataFrame([], result)
    whole = whole.select("vec_id", F.when(F.size("v") == size, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v")))).alias("v"))
    order = F.xxhash64("vec_id", "v").alias("h")
    drawn = whole.where(F.pmod(order, F.lit(rows)) < PIVOT_SAMPLE).select(order, "v").limit(2 * PIVOT_SAMPLE).toPandas()
    drawn = drawn.sort_values("h", kind="stable") if len(drawn) else whole.limit(1).toPandas()
    pivots = spark.sparkContext.broadcast(spread_pivots(raised(matrix(drawn["v"], size), longest), pivot_count(rows)))

    @F.pandas_udf("pivot int, distance double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gap = distances(raised(matrix(batch, size), longest), pivots.value)
            nearest = gap.argmin(axis=1)
            yield pd.DataFrame({"pivot": nearest.astype(np.int32), "distance": gap[np.arange(len(gap)), nearest]})

    keyed = whole.withColumn("_p", place("v")).select("vec_id", "v", "_p.pivot", "_p.distance", F.monotonically_increasing_id().alias("row"))
    keyed = checkpoint(keyed)
    widest = keyed.agg(F.max("distance").alias("d")).first()["d"] or 1.0
    ring = F.least(F.floor(F.col("distance") / F.lit(max(widest, 1e-9) / RINGS)), F.lit(RINGS - 1)).cast("int")
    keyed = keyed.withColumn("ring", ring)
    # at most MOST_PIVOTS x RINGS rows
    cells = keyed.groupBy("pivot", "ring").agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count("*").alias("n")).orderBy("pivot", "ring").toPandas()
    cells["cell"] = np.arange(len(cells))
    cells["parts"] = -(-cells["n"] // CELL_ROWS)
    bounds = spark.sparkContext.broadcast(cells)
    cell_table = spark.createDataFrame(cells[["pivot", "ring", "cell", "parts"]].astype(int), "pivot int, ring int, cell int, parts int")
    stored = keyed.join(F.broadcast(cell_table), ["pivot", "ring"])
    stored = stored.select("cell", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")
    asked = keyed.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "row")
    blur = 1e-7 * longest**0.5 + 1e-6  # rounding errors of distances

    def plan(first: bool):
        """The cells a query visits: the nearest that surely hold k others, or those within its reach."""

        @F.pandas_udf("array<int>")
        def visits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            table = bounds.value
            pivot, lo, hi, n = (table[c].to_numpy() for c in ("pivot", "lo", "hi", "n"))
            for batch, worst in batches:
                q = raised_query(matrix(batch, size))
                gap = distances(q, pivots.value)[:, pivot]
                least = np.maximum(np.maximum(gap - hi, lo - gap), 0)
                order = np.argsort(least + gap * 1e-6, axis=1, kind="stable")  # of equal bounds the nearer pivot
                before = np.cumsum(n[order], axis=1) - n[order]
                home = np.zeros_like(least, dtype=bool)
                np.put_along_axis(home, order, before <= k, axis=1)
                if first:
                    yield pd.Series([np.flatnonzero(h).astype(np.int32) for h in home])
                    continue
                reach = np.sqrt(np.maximum((q * q).sum(1) + longest - 2 * worst.fillna(-np.inf).to_numpy(float), 0)) * (1 + 1e-9) + blur
                yield pd.Series([np.flatnonzero(r & ~h).astype(np.int32) for r, h in zip(least <= reach[:, None], home)])

        return visits

    def raised_query(q: np.ndarray) -> np.ndarray:
        return np.concatenate((q, np.zeros((len(q), 1))), axis=1)

    def compare(visit: DataFrame) -> DataFrame:
        """The best k of each query in each part of each cell it visits, none below its floor."""
        slices = visit.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("slices"))
        slices = slices.join(F.broadcast(cell_table.select("cell", "parts")), "cell")  # a row per cell
        left = visit.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = stored.join(F.broadcast(slices.select("cell", "slices")), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

        def best(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
            if not len(asking) or not len(there):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "near": []})
            there = there.sort_values("vec_id")
            ids = there["vec_id"].to_numpy()
            found = []
            for at in range(0, len(asking), QUERY_ROWS):
                some = asking.iloc[at : at + QUERY_ROWS]
                score = exact_products(some["q"], there["v"], size, longest)
                own, least = some["query_id"].to_numpy(), some["floor"].to_numpy(float)
                near = score.astype(float)
                near[own[:, None] == ids[None, :]] = -np.inf
                # a floor beyond 2^53 may be rounded up
                near[near < (least - np.where(np.isfinite(least), np.abs(least) * 1e-12, 0))[:, None]] = -np.inf
                if score.dtype == np.float64:
                    take = np.argsort(-near, axis=1, kind="stable")[:, :k]  # equal scores: smaller ids first
                    row, col = np.nonzero(np.isfinite(np.take_along_axis(near, take, axis=1)))
                    col = take[row, col]
                else:
                    chosen = [best_of_row(score[i], np.isfinite(near[i]), k) for i in range(len(some))]
                    row = np.repeat(np.arange(len(some)), [len(c) for c in chosen])
                    col = np.array([c for part in chosen for c in part], int)
                kept = [int(x) if abs(int(x)) < 2**63 else None for x in score[row, col]] if score.dtype == object else score[row, col].astype(np.int64)
                found.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "score": pd.array(kept, "Int64"), "near": near[row, col]}))
            return pd.concat(found)

        return left.select("cell", "part", "slice", "query_id", "q", "floor").groupBy("cell", "part", "slice").cogroup(
            right.select("cell", "part", "slice", "vec_id", "v").groupBy("cell", "part", "slice")
        ).applyInPandas(best, "query_id long, vec_id long, score long, near double")

    nothing = F.lit(float("-inf"))
    homes = asked.withColumn("floor", nothing).withColumn("cell", F.explode(plan(True)("q", "floor")))
    near = checkpoint(compare(homes))
    worst = ranked(near, k).where(F.col("rank") == k).select("query_id", F.col("near").alias("worst")).distinct()
    reach = asked.join(worst, "query_id", "left").withColumn("floor", F.coalesce("worst", nothing)).drop("worst")
    further = reach.withColumn("cell", F.explode(plan(False)("q", "floor")))
    if audit is not None:
        compared = homes.select("cell").unionAll(further.select("cell")).groupBy("cell").count().toPandas()  # a row per cell
        audit.append(float((compared["count"].to_numpy() * cells["n"].to_numpy()[compared["cell"]]).sum() / max(1, asked.count() * rows)))
    return ranked(reduce(DataFrame.unionByName, [near, compare(further)]), k).select("query_id", "rank", "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a query has a few candidates per cell, so its window is small."""
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k)
