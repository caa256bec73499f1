"""Exact ranking, selection, joining and quantiles that survive hot keys.

A plain window partitioned by a hot key sorts that whole key in one task. The ranking
here cuts every key into ordered buckets: bucket sizes are counted with map-side
combining, running sums over those counts give each bucket its offset, and rows are
sorted only inside one (key, bucket).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerrec.session import materialize

ROWS_PER_TASK = 1_000_000  # fact rows of one key that one task joins
FREQUENT_KEYS = 50_000  # keys, at most, that are broadcast because they have more than their share of the rows
RANGE_VALUES = 100_000  # distinct values of one range, or rows of one bucket, that one task sorts
NARROW = ("byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz")
HASH_PREFIX = 3  # hex digits of the md5 that form a bucket: 4096 even buckets


def hash_order(seed: int, *cols: str | Column) -> Column:
    """A seeded pseudo-random sort key: md5 of `seed:col:col…`, equal on every engine."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _offsets(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, bucket): its rows, the rows before it and rows of the whole key."""
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return sizes.select(
        *keys,
        "_bucket",
        "_size",
        (F.sum("_size").over(whole.orderBy("_bucket")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(whole).alias("_n"),
    )


def _rank(tagged: DataFrame, offsets: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.join(offsets.drop("_size"), [*keys, "_bucket"])
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


def rank_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column]) -> DataFrame:
    """Add `_rank` (1-based position within `keys`) and `_n` (rows of the key).

    `bucket` must rise with `order`: all rows of a lower bucket come first.
    """
    tagged = df.withColumn("_bucket", bucket)
    return _rank(tagged, _offsets(tagged, keys), keys, order)


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Column | Sequence[Column],
    order: Sequence[Column],
    quota: Callable[[Column], Column] | None = None,
    quotas: DataFrame | None = None,
    last: str | None = None,
    bound: int = RANGE_VALUES,
) -> DataFrame:
    """Keep the first rows of each key, exactly as many as its quota.

    The quota is `quota(n)` for a key of n rows, or column `_quota` of the table
    `quotas`, one row per key. `buckets` must rise with `order`, the coarse one first. Buckets
    that lie within the quota are kept and those behind it dropped without any sort; of each
    key only the bucket on the border is ranked. While such a bucket holds more than `bound`
    rows, it is opened by the next finer bucket, and after those by ranges of the number
    `last`, by which `order` ends, falling.
    """
    levels = [buckets] if isinstance(buckets, Column) else list(buckets)
    names = [*df.columns]
    kept: list[DataFrame] = []
    border, left, first = df, quotas, quota
    while True:
        if levels:
            tagged = border.withColumn("_bucket", levels.pop(0))
        else:
            tagged = _by_number(border, keys, last)
        offsets = _offsets(tagged, keys)
        if first is not None:
            offsets, first = offsets.withColumn("_quota", first(F.col("_n"))), None
        else:
            offsets = offsets.join(left, list(keys)) if keys else offsets.crossJoin(F.broadcast(left))
        offsets = materialize(offsets.where(F.col("_before") < F.col("_quota")), "offsets")
        within = F.col("_before") + F.col("_size") <= F.col("_quota")
        at = [*keys, "_bucket"]
        kept.append(tagged.join(offsets.where(within).select(*at), at, "left_semi").select(*names))
        cut = offsets.where(~within)
        border = tagged.join(cut.select(*at), at, "left_semi").select(*names)
        left = cut.select(*keys, (F.col("_quota") - F.col("_before")).alias("_quota"))
        largest = cut.agg(F.max("_size")).first()[0]
        if largest is None or largest <= bound or not (levels or last):
            break
    inside = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = border.withColumn("_rank", F.row_number().over(inside.orderBy(*order)))
    ranked = ranked.join(left, list(keys)) if keys else ranked.crossJoin(F.broadcast(left))
    kept.append(ranked.where(F.col("_rank") <= F.col("_quota")).select(*names))
    return reduce(DataFrame.unionByName, kept)


def _by_number(df: DataFrame, keys: Sequence[str], number: str, cuts: int = 4096) -> DataFrame:
    """Add `_bucket`: equal ranges of a number between its extremes in each key, falling."""
    ends = df.groupBy(*keys).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    joined = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))
    share = (F.col("_hi") - F.col(number)) / (F.col("_hi") - F.col("_lo") + 1)
    return joined.withColumn("_bucket", F.coalesce(F.floor(share * cuts), F.lit(0))).drop("_lo", "_hi")


def rank_by_hash(df: DataFrame, seed: int, *cols: str) -> DataFrame:
    """Add `_rank` and `_n` in seeded hash order over the whole table."""
    hashed = df.withColumn("_h", hash_order(seed, *cols))
    ranked = rank_rows(hashed, [], F.substring("_h", 1, HASH_PREFIX), [F.col("_h"), *map(F.col, cols)])
    return ranked.drop("_h")


def first_by_hash(
    df: DataFrame,
    seed: int,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    quota: Callable[[Column], Column] | None = None,
    quotas: DataFrame | None = None,
) -> DataFrame:
    """An exact random sample per key: the first rows in seeded hash order."""
    hashed = df.withColumn("_h", hash_order(seed, *cols))
    bucket = F.substring("_h", 1, HASH_PREFIX)
    finer = [bucket, F.substring("_h", 1, 2 * HASH_PREFIX), F.substring("_h", 1, 4 * HASH_PREFIX)]
    return first_rows(hashed, keys, finer, [F.col("_h"), *map(F.col, cols)], quota, quotas).drop("_h")


def with_copies(per_key: DataFrame, size: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `_copies` to a table with one row per key: into how many parts its rows are dealt.

    `size` is the number of fact rows of the key. No part is much larger than
    `rows_per_task`, and fewer keys than all rows / rows_per_task have several parts.
    """
    parts = F.ceil(F.col(size) / F.lit(rows_per_task))
    return per_key.withColumn("_copies", F.greatest(F.lit(1), parts.cast("int")))


def salted(facts: DataFrame, per_key: DataFrame, key: str, name: str = "_salt") -> DataFrame:
    """Add a salt to facts: rows of a hot key spread evenly, all others get 0.

    Only the hot keys are broadcast, at most one for every ROWS_PER_TASK fact rows. The salt
    comes from the other narrow columns, so that texts and vectors are not hashed for it.
    """
    hot = per_key.where(F.col("_copies") > 1).select(key, F.col("_copies").alias("_spread"))
    narrow = [f.name for f in facts.schema.fields if f.name != key and f.dataType.typeName() in NARROW] or facts.columns
    spread = F.pmod(F.xxhash64(*narrow), F.coalesce("_spread", F.lit(1))).cast("int")
    return facts.join(F.broadcast(hot), key, "left").withColumn(name, spread).drop("_spread")


def join_salted(facts: DataFrame, per_key: DataFrame, key: str, name: str = "_salt", how: str = "inner") -> DataFrame:
    """Join salted facts with the row of their key, copied once per salt of a hot key."""
    copied = per_key.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return facts.join(copied, [key, name], how).drop(name)


def attach(facts: DataFrame, per_key: DataFrame, key: str, size: str, how: str = "inner", **limits: int) -> DataFrame:
    """Join a table with one row per key onto facts in which some keys are hot.

    `size` is a column of `per_key` with the number of fact rows of the key; `limits` are
    those of `with_copies`.
    """
    per_key = with_copies(per_key, size, **limits)
    return join_salted(salted(facts, per_key, key), per_key, key, how=how)


def attach_stored(facts: DataFrame, per_key: DataFrame, key: str, size: str, frequent_keys: int = FREQUENT_KEYS) -> DataFrame:
    """An inner `attach` of written tables that leaves rows of frequent keys where they are.

    A key with more than one in `frequent_keys` of all rows is frequent, so there are fewer of
    them than that, and they are broadcast. Only rows of other keys are shuffled, none of
    which is hot. Both tables are read twice, so give none that is still to be computed.
    """
    total = per_key.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) * frequent_keys > F.lit(total)
    frequent = F.broadcast(per_key.where(often))
    rare = facts.join(frequent.select(key), key, "left_anti").join(per_key.where(~often), key)
    return facts.join(frequent, key).unionByName(rare)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], bound: int = RANGE_VALUES, cuts: int = 4096) -> DataFrame:
    """Exact linearly interpolated quantiles of several columns: rows `(column, p, value)`.

    Equal values of all columns are counted in one pass. Ranges of values, at first cut by
    magnitude and sign, hold the positions that are asked for; a range with more than `bound`
    distinct values is cut again between its own least and largest value, until none is so
    large. So neither outliers nor crowded values bring many rows to one task. Per round a few
    ranges for each column and probability reach the driver. Nulls and NaN are left out.
    """
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(named).alias("e")).select("e.column", (F.col("e.v") + 0.0).alias("v"))
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = materialize(long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c")), "value-counts")
    spark = df.sparkSession
    magnitude = F.floor(F.signum("v") * F.log2(F.abs("v") + 1) * 64).cast("long")
    tagged = counts.select("column", "v", "c", F.lit(0).alias("range"), F.lit(0).cast("long").alias("base"), magnitude.alias("sub"))
    sizes = counts.groupBy("column").agg(F.sum("c").alias("n"))
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    # positions are zero-based: p·(n-1) lies between its floor and its ceiling
    asked = sizes.select("column", F.explode(wanted).alias("p"), "n").withColumn("pos", F.col("p") * (F.col("n") - 1))
    asked = asked.select("column", "p", "pos", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("at"))
    schema = "range int, column string, lo double, hi double, base long, kinds long"
    while True:
        spans = tagged.groupBy("column", "range", "base", "sub").agg(
            F.sum("c").alias("size"), F.count(F.lit(1)).alias("kinds"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        inside = Window.partitionBy("column", "range").orderBy("lo")
        spans = spans.withColumn("base", F.col("base") + F.sum("size").over(inside) - F.col("size"))
        held = spans.join(asked, "column").where((F.col("at") >= F.col("base")) & (F.col("at") < F.col("base") + F.col("size")))
        found = held.select("column", "lo", "hi", "base", "kinds").distinct().collect()  # at most two per column and probability
        ranges = spark.createDataFrame([(i, r.column, r.lo, r.hi, r.base, r.kinds) for i, r in enumerate(found)], schema)
        there = (counts["column"] == ranges["column"]) & counts["v"].between(F.col("lo"), F.col("hi"))
        rows = counts.join(F.broadcast(ranges), there).select(counts["column"], "v", "c", "range", "base", "lo", "hi", "kinds")
        if all(r.kinds <= bound for r in found):
            break
        # halves first, as the whole width may be more than a double holds
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        sub = F.when((F.col("kinds") > bound) & (F.col("lo") < F.col("hi")), F.least(F.floor(share * cuts), F.lit(cuts - 1)))
        tagged = rows.withColumn("sub", F.coalesce(sub, F.lit(0)).cast("long"))
    inside = Window.partitionBy("range").orderBy("v")
    located = rows.select("column", "v", "c", (F.col("base") + F.sum("c").over(inside) - F.col("c")).alias("first"))
    hit = located.join(F.broadcast(asked), "column").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("c")))
    below, above = F.min("v"), F.max("v")
    part = F.first(F.col("pos") - F.floor("pos"))
    return hit.groupBy("column", "p").agg((below + (above - below) * part).alias("value"))
