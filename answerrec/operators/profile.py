"""Exploratory statistics: distributions, coverage, histograms, word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerrec.errors import need_columns, need_option
from answerrec.functions.text import stop_list, tokens
from answerrec.operators.skew import quantiles
from answerrec.session import spread

DECILES = [i / 10 for i in range(1, 10)]


def describe(
    df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = DECILES, method: str = "exact"
) -> DataFrame:
    """Rows `(column, statistic, value)`: count, mean, std, min, percentiles, max.

    One pass gives the moments of all columns, another the counts of their distinct values,
    from which the exact percentiles come; "approx" uses one sketch pass.
    """
    need_columns(df.columns, *columns)
    need_option(method, ["exact", "approx"])
    probs = sorted(set(percentiles))
    value = {c: F.col(c).cast("double") for c in columns}
    moments = {
        "count": lambda v: F.count(v).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
    }
    row = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("statistic"), f(v).alias("value")) for c, v in value.items() for k, f in moments.items()]
    whole = df.agg(F.array(*row).alias("_m")).select(F.inline("_m"))
    if method == "exact":
        points = quantiles(df.select(*dict.fromkeys(columns)), columns, probs)
    else:
        sketches = [F.struct(F.lit(c).alias("column"), F.percentile_approx(v, [float(p) for p in probs], 10000).alias("v")) for c, v in value.items()]
        points = df.agg(F.array(*sketches).alias("_s")).select(F.inline("_s"))
        zipped = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("v").alias("value"))
        points = points.select("column", F.inline(zipped))
    return whole.unionByName(points.select("column", percent_name(F.col("p")).alias("statistic"), "value"))


def percent_name(p: Column) -> Column:
    """0.25 becomes `25%`, 0.995 becomes `99.5%`."""
    digits = (p * 100).cast("decimal(20,6)").cast("string")
    return F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit("%"))


def non_null_counts(df: DataFrame) -> DataFrame:
    """Rows `(column, non_null, nulls)` of every column, in one pass."""
    total = F.count(F.lit(1))
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), (total - F.count(c)).alias("nulls"))
             for c in df.columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def distinct_counts(df: DataFrame, columns: Sequence[str], method: str = "exact") -> DataFrame:
    """Rows `(column, distinct_values)`; nulls are ignored."""
    need_option(method, ["exact", "approx"])
    count = F.count_distinct if method == "exact" else F.approx_count_distinct
    row = df.agg(*[count(c).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "distinct_values")


def percent_missing(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Rows `(column, percent)`: nulls per non-null key, cut to a whole percent."""
    share = [F.floor(F.count_if(F.col(c).isNull()) * 100 / F.count(key)).alias(c) for c in columns]
    return df.agg(*share).unpivot([], list(columns), "column", "percent")


def coverage(facts: DataFrame, fact_key: str, entities: DataFrame, entity_key: str) -> DataFrame:
    """Distinct keys of the facts per distinct entity, in whole percent."""
    some = facts.agg(F.count_distinct(fact_key)).scalar()
    return entities.agg(F.floor(some * 100 / F.count_distinct(entity_key)).alias("percent"))


def threshold_sweep(flagged: DataFrame, highest: int = 10) -> DataFrame:
    """Percent of answers, users and questions left for each score threshold 1..highest.

    Each answer, user or question is reduced to the highest threshold it survives. All three
    come from one pass: users and questions by their id, answers, of which an id stands in one
    row, by the threshold alone, so that no row is shuffled for a unique id.
    """
    need_columns(flagged.columns, "answer_id", "user_id", "question_id", "score", "is_accepted_answer")
    survives = F.when(F.col("is_accepted_answer") == 1, F.lit(highest)).otherwise(
        F.greatest(F.lit(0), F.least(F.coalesce("score", F.lit(0)), F.lit(highest)))
    )
    levels = flagged.select("answer_id", "user_id", "question_id", survives.cast("long").alias("level"))
    entry = lambda kind, key, there: F.struct(F.lit(kind).alias("kind"), F.when(F.col(there).isNotNull(), F.col(key)).cast("long").alias("key"), "level")
    entries = F.array(entry("answers", "level", "answer_id"), entry("users", "user_id", "user_id"), entry("questions", "question_id", "question_id"))
    rows = levels.select(F.explode(entries).alias("e")).select("e.*").where("key is not null")
    best = rows.groupBy("kind", "key").agg(F.max("level").alias("level"), F.count(F.lit(1)).alias("rows"))
    weight = F.when(F.col("kind") == "answers", F.col("rows")).otherwise(F.lit(1))
    counts = best.groupBy("kind", "level").agg(F.sum(weight).alias("n"))
    left = [F.struct(F.lit(t).alias("score"), F.floor(F.sum(F.when(F.col("level") >= t, F.col("n")).otherwise(0)) * 100 / F.sum("n")).alias("percentage"))
            for t in range(1, highest + 1)]
    shares = counts.groupBy("kind").agg(F.array(*left).alias("_l")).select("kind", F.inline("_l"))
    return shares.select("score", "percentage", F.concat(F.lit("remaining_"), "kind", F.lit("_%")).alias("category"))


def conditional_distinct(rows: DataFrame) -> DataFrame:
    """Users and questions left under the usual activity and score conditions."""
    need_columns(rows.columns, "user_answers", "question_answers", "score", "is_accepted_answer")
    conditions = {
        "users_2_answers": F.col("user_answers") >= 2,
        "questions_3_answers": F.col("question_answers") >= 3,
        "positive_at_2": (F.col("score") >= 2) | (F.col("is_accepted_answer") == 1),
    }
    # a first grouping per user (question) leaves one row each, so nothing is counted twice
    found = []
    for key in ["user_id", "question_id"]:
        flags = rows.groupBy(key).agg(*[F.max(c.cast("int")).alias(n) for n, c in conditions.items()])
        counts = flags.where(F.col(key).isNotNull()).agg(*[F.sum(n).alias(n) for n in conditions])
        found.append(counts.unpivot([], list(conditions), "condition", "entities").withColumn("entity", F.lit(key)))
    return found[0].unionByName(found[1])


def label_counts(df: DataFrame, label: str, counted: str) -> DataFrame:
    need_columns(df.columns, label, counted)
    return df.groupBy(label).agg(F.count(counted).alias("rows"))


def histogram(df: DataFrame, value: str, low: float, high: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin; bins start at `low`, the last one includes its right edge, values
    outside are dropped."""
    bins = int((high - low) // width) - (0 if (high - low) % width else 1)
    top = low + width * bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= top))
    number = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    return inside.groupBy(*by, (F.lit(low) + number * width).alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def word_length(text: Column, empty_as_zero: bool = False) -> Column:
    """Words between single spaces; optionally an empty or missing text has none."""
    length = F.size(F.split(text, " ", -1))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(length) if empty_as_zero else length


def word_frequency(df: DataFrame, text: str, max_words: int = 5000, stop_words: str | Sequence[str] = ()) -> DataFrame:
    """The most frequent words, ties in word order."""
    words = spread(df.select(text)).select(F.explode_outer(tokens(F.col(text))).alias("word"))
    words = words.where(F.col("word").isNotNull())
    if stop_words:
        words = words.where(~F.col("word").isin(*stop_list(stop_words)))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.orderBy(F.desc("occurrences"), "word").limit(max_words)
