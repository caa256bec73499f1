"""Scores of question and user vectors: given pairs, top users, exact positions.

All users are ranked for every question, but the pairs are never rows: questions and
users are cut into blocks, each pair of blocks is one task-sized matrix product, and only
the k best users (or one count per held-out pair) leave it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerrec.errors import need_columns
from answerrec.functions.vectors import dot
from answerrec.operators.skew import attach
from answerrec.session import discard, materialize

QUESTION_BLOCK = 2048
USER_BLOCK = 8192
HELD_PER_PART = 65_536  # held-out pairs of one question that travel together, and of a block on average
HELD_USER_BLOCK = 65_536  # users that held-out pairs meet at once
SEEN_PER_CELL = 500_000  # known pairs in a pair of blocks on average
FEW_HELD = 32  # held-out pairs of a question that are compared with every user without a sort
TOP_QUESTION_BLOCK = 8192  # questions that meet a user block at once; users travel once for each
STRIP = 16  # user blocks that one task visits
LEAF = 256  # users of a block that stand close together and are left out together
SLACK = 1e-6  # of bounds on scores, for rounding
ROWS_AT_ONCE = 256  # rows of a block multiplied at once: 256 x 8192 doubles are 16 MB
SCORES_AT_ONCE = ROWS_AT_ONCE * USER_BLOCK  # so are fewer rows of a larger block

# kinds of rows that meet in one pair of blocks
QUESTION, USER, SEEN, HELD = 0, 1, 2, 3


def exact(score: Column) -> Column:
    """Cut a score to single precision, so that every way to compute it finds the same ties.

    The cut is relative: small scores keep their order.
    """
    return score.cast("float").cast("double")


def _exact(scores: np.ndarray) -> np.ndarray:
    return scores.astype(np.float32).astype(float)


def score_pairs(pairs: DataFrame, questions: DataFrame, users: DataFrame) -> DataFrame:
    """Add `score` to `(question_id, user_id)` rows whose two ids have vectors.

    Question and user vectors are attached by joins that spread ids with very many pairs.
    """
    need_columns(pairs.columns, "question_id", "user_id")
    per_question = pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("_nq"))
    per_user = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_nu"))
    q = per_question.join(questions.select("question_id", F.col("vector").alias("_qv")), "question_id")
    u = per_user.join(users.select("user_id", F.col("vector").alias("_uv"), F.col("bias").alias("_ub")), "user_id")
    both = attach(attach(pairs, q, "question_id", size="_nq"), u, "user_id", size="_nu")
    score = exact(dot(F.col("_qv"), F.col("_uv")) + F.col("_ub"))
    return both.withColumn("score", score).drop("_nq", "_qv", "_nu", "_uv", "_ub")


def _blocks(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(1)).cast("int")


def _cells(
    questions: DataFrame,
    users: DataFrame,
    seen: DataFrame | None,
    held: DataFrame | None,
    question_block: int,
    user_block: int,
) -> DataFrame:
    """Rows of all block pairs: each question goes to every user block and each user to
    every question block; a known pair goes to the one block pair that scores it.

    Blocks are hash buckets of question parts and of users, so their sizes are even and no
    id list is collected. `questions`, `seen` and `held` carry the column `part`. There are so
    many blocks of questions that neither their held-out nor their known pairs grow with the
    tables, be the questions few or many.
    """
    rows = F.count(F.lit(1))
    u_blocks = _blocks(users.agg(rows).scalar(), user_block)
    q_blocks = _blocks(questions.agg(rows).scalar(), question_block)
    if held is not None:
        q_blocks = F.greatest(q_blocks, _blocks(held.agg(rows).scalar(), HELD_PER_PART))
    if seen is not None:
        q_blocks = F.greatest(q_blocks, _blocks(seen.agg(rows).scalar() / u_blocks, SEEN_PER_CELL))
    qb = F.pmod(F.xxhash64("question_id", "part"), q_blocks).cast("int")
    ub = F.pmod(F.xxhash64("user_id"), u_blocks).cast("int")
    every_q = F.explode(F.sequence(F.lit(0), q_blocks - 1))
    every_u = F.explode(F.sequence(F.lit(0), u_blocks - 1))
    no_id, no_vector = F.lit(None).cast("long"), F.lit(None).cast("array<double>")
    zero = F.lit(0.0)

    def shaped(df: DataFrame, kind: int, qb: Column, ub: Column, *values: Column) -> DataFrame:
        names = ["question_id", "user_id", "vector", "bias"]
        return df.select(
            qb.alias("qb"), ub.alias("ub"), F.lit(kind).alias("kind"), *[v.alias(n) for v, n in zip(values, names)]
        )

    question, user = F.col("question_id").cast("long"), F.col("user_id").cast("long")
    cells = shaped(questions, QUESTION, qb, every_u, question, no_id, F.col("vector"), zero)
    cells = cells.unionAll(shaped(users, USER, every_q, ub, no_id, user, F.col("vector"), F.col("bias")))
    if seen is not None:
        cells = cells.unionAll(shaped(seen, SEEN, qb, ub, question, user, no_vector, zero))
    if held is not None:
        # the held-out score travels in `bias` to all user blocks of its question
        cells = cells.unionAll(shaped(held, HELD, qb, every_u, question, user, no_vector, F.col("score")))
    return cells


def _score_block(cell: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, Callable[[int, int], np.ndarray]]:
    """Questions and user ids of a block pair, and a function that scores a few questions;
    known pairs score NaN. Users stand in id order."""
    questions = cell[cell["kind"] == QUESTION].drop_duplicates("question_id")
    questions = questions.sort_values("question_id", ignore_index=True)
    users = cell[cell["kind"] == USER].sort_values("user_id", ignore_index=True)
    if questions.empty or users.empty:
        return questions, np.empty(0, dtype=np.int64), lambda start, end: np.empty((end - start, 0))
    ids = users["user_id"].to_numpy(dtype=np.int64)
    question_ids = questions["question_id"].to_numpy(dtype=np.int64)
    left = np.array(questions["vector"].tolist(), dtype=float)
    right = np.array(users["vector"].tolist(), dtype=float).T
    bias = users["bias"].to_numpy(dtype=float)
    seen = cell[cell["kind"] == SEEN]
    rows = np.searchsorted(question_ids, seen["question_id"].to_numpy(dtype=np.int64))
    cols = np.searchsorted(ids, seen["user_id"].to_numpy(dtype=np.int64))
    real = (rows < len(question_ids)) & (cols < len(ids))
    seen_q, seen_u = seen["question_id"].to_numpy(dtype=np.int64)[real], seen["user_id"].to_numpy(dtype=np.int64)[real]
    rows, cols = rows[real], cols[real]
    real = (question_ids[rows] == seen_q) & (ids[cols] == seen_u)
    rows, cols = rows[real], cols[real]
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]

    def scores(start: int, end: int) -> np.ndarray:
        block = _exact(left[start:end] @ right + bias)
        mine = slice(*np.searchsorted(rows, [start, end]))
        block[rows[mine] - start, cols[mine]] = np.nan
        return block

    return questions, ids, scores


@dataclass(frozen=True)
class UserBlocks:
    """Users in blocks of falling vector length: `(user_id, vector, bias, ub)`, and for each
    block the longest vector in it or any later one."""

    users: DataFrame
    longest: np.ndarray


def _length(vector: Column, last: Column) -> Column:
    return F.sqrt(dot(vector, vector) + last * last)


def users_by_length(users: DataFrame, user_block: int = USER_BLOCK) -> UserBlocks:
    """Cut the users at quantiles of the length of their vector and bias. Where one length is
    so frequent that a block overflows, the block is split by a hash of the id."""
    sized = materialize(users.select("user_id", "vector", "bias", _length(F.col("vector"), F.col("bias")).alias("length")), "user-lengths")
    bands = max(1, -(-sized.count() // user_block))
    edges: list[float] = []
    if bands > 1:
        shares = F.array(*[F.lit(i / bands) for i in range(1, bands)])
        found = sized.agg(F.percentile_approx("length", shares, F.lit(max(10_000, 4 * bands))).alias("e")).first()["e"]
        edges = sorted(set(found or []))
    if edges:
        cuts = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="length", outputCol="band", handleInvalid="keep")
        banded = cuts.transform(sized)
    else:
        banded = sized.withColumn("band", F.lit(0.0))
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect()  # a row per block
    table, first = [], 0
    for row in counts:
        parts = max(1, -(-row.n // user_block))
        table.append((row.band, first, parts))
        first += parts
    places = users.sparkSession.createDataFrame(table, "band double, first int, parts int")
    blocked = banded.join(F.broadcast(places), "band")
    ub = F.col("first") + F.pmod(F.xxhash64("user_id"), F.col("parts")).cast("int")
    blocked = materialize(blocked.select("user_id", "vector", "bias", "length", ub.alias("ub")), "user-blocks")
    discard(sized)
    longest = np.zeros(first)
    for row in blocked.groupBy("ub").agg(F.max("length").alias("length")).collect():
        longest[row.ub] = row.length
    return UserBlocks(blocked, np.maximum.accumulate(longest[::-1])[::-1] if first else longest)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which of the flat candidates are among the k best of their row; ties go to the lower id."""
    order = np.lexsort((ids, -scores, rows))
    ordered = rows[order]
    place = np.arange(len(order)) - np.searchsorted(ordered, ordered, "left")
    return order[place < k]


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of up to LEAF points each, halved along the widest entry; each in rising order."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        part = open_.pop()
        if len(part) <= LEAF:
            done.append(np.sort(part))
            continue
        widest = int(np.ptp(points[part], axis=0).argmax())
        part = part[np.argsort(points[part, widest], kind="stable")]
        open_ += [part[: len(part) // 2], part[len(part) // 2 :]]
    return done


def _top_of_blocks(cell: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best users of each question of a cell, its user blocks visited by falling length.

    A question leaves out a block whose longest vector cannot reach its k-th best score so
    far, nor its floor, below which nothing is wanted; and of other blocks the users in a box
    whose best corner cannot.
    """
    questions = cell[cell["kind"] == QUESTION].drop_duplicates("question_id").sort_values("question_id", ignore_index=True)
    users = cell[cell["kind"] == USER]
    if questions.empty or users.empty:
        return pd.DataFrame({"question_id": [], "user_id": [], "score": []})
    question_ids = questions["question_id"].to_numpy(np.int64)
    left = np.array(questions["vector"].tolist(), float)
    reach = np.sqrt((left * left).sum(axis=1) + 1)
    floor = questions["bias"].to_numpy(float)  # of a question this column holds its floor
    seen = cell[cell["kind"] == SEEN]
    seen_row = np.searchsorted(question_ids, seen["question_id"].to_numpy(np.int64))
    there = seen_row < len(question_ids)
    there[there] = question_ids[seen_row[there]] == seen["question_id"].to_numpy(np.int64)[there]
    seen_row, seen_user = seen_row[there], seen["user_id"].to_numpy(np.int64)[there]
    rows, ids, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    with_bias = np.column_stack((left, np.ones(len(left))))
    for _, block in users.groupby("ub", sort=True):
        block = block.sort_values("user_id", ignore_index=True)
        block_ids = block["user_id"].to_numpy(np.int64)
        right, bias = np.array(block["vector"].tolist(), float), block["bias"].to_numpy(float)
        longest = np.sqrt((right * right).sum(axis=1) + bias * bias).max()
        points = np.column_stack((right, bias))
        leaves = _leaves(points)
        low, high = (np.array([f(points[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))
        column = np.searchsorted(block_ids, seen_user)
        hit = column < len(block_ids)
        hit[hit] = block_ids[column[hit]] == seen_user[hit]
        hit_row, hit_column = seen_row[hit], column[hit]
        order = np.argsort(hit_row, kind="stable")
        hit_row, hit_column = hit_row[order], hit_column[order]
        found = [(rows, ids, values)]
        active = np.flatnonzero(~(reach * longest * (1 + SLACK) + SLACK < floor))

        def take(some: np.ndarray, columns: np.ndarray) -> None:
            scores = _exact(left[some] @ right[columns].T + bias[columns])
            first, last = np.searchsorted(hit_row, some, "left"), np.searchsorted(hit_row, some, "right")
            for at in np.flatnonzero(last > first):
                known = hit_column[first[at] : last[at]]
                place = np.searchsorted(columns, known)
                there = place < len(columns)
                there[there] = columns[place[there]] == known[there]
                scores[at, place[there]] = -np.inf
            least = floor[some]
            if len(columns) > k:
                least = np.maximum(least, np.partition(scores, len(columns) - k, axis=1)[:, len(columns) - k])
            # of equal scores the lower ids stand first
            better, equal = scores > least[:, None], scores == least[:, None]
            equal &= np.cumsum(equal, axis=1) <= k - better.sum(axis=1)[:, None]
            row, col = np.nonzero((better | equal) & np.isfinite(scores))
            found.append((some[row], block_ids[columns[col]], scores[row, col]))

        for at in range(0, len(active), ROWS_AT_ONCE):
            some = active[at : at + ROWS_AT_ONCE]
            # no user of a leaf scores above the best corner of the box around it
            corner = np.maximum(with_bias[some], 0) @ high.T + np.minimum(with_bias[some], 0) @ low.T
            near = ~(corner + SLACK * (1 + reach[some] * longest)[:, None] < floor[some][:, None])
            if near.mean() > 0.5:
                take(some, np.arange(len(block_ids)))
                continue
            for leaf in np.flatnonzero(near.any(axis=0)):
                take(some[near[:, leaf]], leaves[leaf])
        rows, ids, values = (np.concatenate(parts) for parts in zip(*found))
        best = _best(rows, ids, values, k)
        rows, ids, values = rows[best], ids[best], values[best]
        full = np.bincount(rows, minlength=len(floor)) >= k
        worst = np.full(len(floor), np.inf)
        np.minimum.at(worst, rows, values)
        floor = np.where(full, np.maximum(floor, worst), floor)
    return pd.DataFrame({"question_id": question_ids[rows], "user_id": ids, "score": values})


def _shaped(df: DataFrame, kind: int, cell: Column, **values: Column) -> DataFrame:
    """Rows of a cell: the columns that a kind does not have are null."""
    types = {"question_id": "long", "user_id": "long", "vector": "array<double>", "bias": "double", "ub": "int"}
    return df.select(cell.alias("cell"), F.lit(kind).alias("kind"), *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def _meet(questions: DataFrame, users: DataFrame, seen: DataFrame | None, k: int) -> DataFrame:
    """The k best users per question and cell. All three tables carry `cell`; of questions
    `floor` is the score below which nothing is wanted."""
    vector = F.col("vector")
    rows = _shaped(questions, QUESTION, F.col("cell"), question_id=F.col("question_id"), vector=vector, bias=F.col("floor"))
    rows = rows.unionAll(_shaped(users, USER, F.col("cell"), user_id=F.col("user_id"), vector=vector, bias=F.col("bias"), ub=F.col("ub")))
    if seen is not None:
        rows = rows.unionAll(_shaped(seen, SEEN, F.col("cell"), question_id=F.col("question_id"), user_id=F.col("user_id")))
    return rows.groupBy("cell").applyInPandas(lambda cell: _top_of_blocks(cell, k), "question_id long, user_id long, score double")


def visits(questions: DataFrame, first: DataFrame, blocks: UserBlocks, k: int) -> DataFrame:
    """`(question_id, vector, floor, ub)`: after the first block, each question's k-th best
    score, and the number of blocks that may hold a better user, the first one included."""
    kth = first.groupBy("question_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    floor = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("-inf")))
    longest = blocks.longest

    @F.pandas_udf("int")
    def count(length: pd.Series, least: pd.Series) -> pd.Series:
        bound = (least.to_numpy(float) - SLACK) / (length.to_numpy(float) * (1 + SLACK))
        return pd.Series(np.searchsorted(-longest, -bound, "right"))

    asked = questions.select("question_id", "vector").join(kth, "question_id", "left").withColumn("floor", floor)
    return asked.select("question_id", "vector", "floor", count(_length(F.col("vector"), F.lit(1.0)), F.col("floor")).alias("ub"))


def top_users(
    questions: DataFrame,
    users: DataFrame,
    k: int = 20,
    exclude_seen: DataFrame | None = None,
    question_block: int = TOP_QUESTION_BLOCK,
    user_block: int = USER_BLOCK,
    strip: int = STRIP,
) -> DataFrame:
    """Rows `(question_id, user_id, score, rank)` of the k best users of each question.

    `exclude_seen` removes known pairs. Ties go to the lower user id.

    Users lie in blocks of falling vector length. All questions meet the first block; by
    Cauchy and Schwarz no user scores above the product of the lengths, so a question's k-th
    best score tells how many of the next blocks it has to see. Questions that need equally
    many strips of blocks share cells; a cell visits its blocks by falling length with a
    running k-th best, and gives at most k rows per question and strip.
    """
    blocks = users_by_length(users, user_block)
    count = questions.agg(F.count(F.lit(1))).scalar()
    q_blocks = _blocks(count, question_block)
    by_hash = F.pmod(F.xxhash64("question_id"), q_blocks).cast("int")
    seen = None
    if exclude_seen is not None:
        known = exclude_seen.select("question_id", "user_id").distinct()
        sizes = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).join(blocks.users.select("user_id", "ub"), "user_id")
        seen = materialize(attach(known, sizes, "user_id", size="_n").select("question_id", "user_id", "ub"), "seen")
    first_users = blocks.users.where("ub = 0").withColumn("cell", F.explode(F.sequence(F.lit(0), q_blocks - 1)))
    first_seen = None if seen is None else seen.where("ub = 0").withColumn("cell", by_hash)
    first = questions.withColumn("cell", by_hash).withColumn("floor", F.lit(float("-inf")))
    found = materialize(_meet(first, first_users, first_seen, k), "first-block")
    if len(blocks.longest) > 1:
        asked = visits(questions, found, blocks, k).where("ub > 1").withColumn("strips", F.ceil((F.col("ub") - 1) / strip).cast("int"))
        asked = materialize(asked, "visits")
        sizes = asked.groupBy("strips").agg(F.ceil(F.count(F.lit(1)) / question_block).cast("int").alias("parts"))  # a row per strip at most
        part = F.pmod(F.xxhash64("question_id"), F.col("parts")).cast("int").alias("part")
        asked = asked.join(F.broadcast(sizes), "strips").select("*", part)
        each = sizes.select("strips", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        each = each.select("*", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
        cells = each.select("strip", F.xxhash64("strips", "part", "strip").alias("cell"))
        of_strip = F.floor((F.col("ub") - 1) / strip).cast("int")
        later = blocks.users.where("ub > 0").withColumn("strip", of_strip).join(cells, "strip")
        rows = asked.withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
        rows = rows.withColumn("cell", F.xxhash64("strips", "part", "strip"))
        more_seen = None
        if seen is not None:
            more_seen = seen.where("ub > 0").withColumn("strip", of_strip).join(asked.select("question_id", "strips", "part"), "question_id")
            more_seen = more_seen.where("strip < strips").withColumn("cell", F.xxhash64("strips", "part", "strip"))
        found = found.unionByName(_meet(rows, later, more_seen, k))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "user_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_lists(top: DataFrame) -> DataFrame:
    """One row per question with its users in rank order; a list has at most k users."""
    lists = top.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "user_id"))).alias("_u"))
    return lists.select("question_id", F.transform("_u", lambda u: u["user_id"]).alias("user_ids"))


def _places(scores: np.ndarray, size: int, ids: np.ndarray, users: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Lower, equal and better scores and candidates of held-out users of one question; scores
    stand in id order, those of known pairs are NaN. One sort serves all its held-out users."""
    order = np.argsort(scores, kind="stable")[:size]  # NaN comes last, equal scores in id order
    ordered = scores[order]
    low, high = np.searchsorted(ordered, mine, "left"), np.searchsorted(ordered, mine, "right")
    # number of the score among the different ones, then the place of the id
    number = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
    width = len(ids) + 1
    keys = number * width + order
    there = high > low
    earlier = np.zeros(len(mine), np.int64)
    earlier[there] = np.searchsorted(keys, number[low[there]] * width + np.searchsorted(ids, users[there])) - low[there]
    return np.stack((low, high - low, size - high + earlier, np.full(len(mine), size)), axis=1)


def held_pairs(held: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Distinct held-out pairs that were not seen, and the seen pairs of their questions."""
    pairs = held.select("question_id", "user_id").distinct()
    if seen is None:
        return pairs, None
    # only pairs of held-out questions matter
    asked = pairs.select("question_id").distinct()
    seen = seen.select("question_id", "user_id").distinct().join(asked, "question_id", "left_semi")
    return pairs.join(seen, ["question_id", "user_id"], "left_anti"), seen


def held_out_positions(
    questions: DataFrame,
    users: DataFrame,
    held: DataFrame,
    seen: DataFrame | None = None,
    question_block: int = QUESTION_BLOCK,
    user_block: int = HELD_USER_BLOCK,
    held_per_part: int = HELD_PER_PART,
) -> DataFrame:
    """For each held-out pair, where its user stands among all users not seen with the
    question: `below` (lower scores), `equal` (same score, itself included), `ahead`
    (before it in score order, ties by id) and `candidates`.

    A pair that was also seen is no held-out pair.
    """
    return positions_of(questions, users, *held_pairs(held, seen), question_block, user_block, held_per_part)


def positions_of(
    questions: DataFrame,
    users: DataFrame,
    pairs: DataFrame,
    seen: DataFrame | None,
    question_block: int = QUESTION_BLOCK,
    user_block: int = HELD_USER_BLOCK,
    held_per_part: int = HELD_PER_PART,
) -> DataFrame:
    """`held_out_positions` of pairs from `held_pairs`."""
    # the scored pairs feed three branches below, so they are computed once
    scored = materialize(score_pairs(pairs, questions, users), "held-scores")
    # a question with very many held-out pairs is split into parts that meet all users each
    parts = scored.groupBy("question_id").agg(F.count(F.lit(1)).alias("_held"))
    parts = parts.withColumn("_parts", F.ceil(F.col("_held") / held_per_part).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    questions = questions.join(parts, "question_id").withColumn("part", every)
    one = F.pmod(F.xxhash64("user_id"), F.col("_parts")).cast("int")
    scored = attach(scored, parts, "question_id", size="_held").withColumn("part", one)
    if seen is not None:
        sizes = seen.groupBy("question_id").agg(F.count(F.lit(1)).alias("_seen")).join(parts, "question_id")
        seen = attach(seen, sizes, "question_id", size="_seen").withColumn("part", every)

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        found, ids, scores = _score_block(cell)
        wanted = cell[cell["kind"] == HELD].sort_values("question_id", ignore_index=True)
        question_ids = found["question_id"].to_numpy(dtype=np.int64)
        row_of = np.searchsorted(question_ids, wanted["question_id"].to_numpy(dtype=np.int64))
        held_user, held_score = wanted["user_id"].to_numpy(dtype=np.int64), wanted["bias"].to_numpy(dtype=float)
        counts = np.zeros((len(wanted), 4), dtype=np.int64)
        step = max(1, min(ROWS_AT_ONCE, SCORES_AT_ONCE // max(1, len(ids))))
        for start in range(0, len(found) if len(ids) else 0, step):
            end = min(start + step, len(found))
            block = scores(start, end)
            size = np.count_nonzero(~np.isnan(block), axis=1)
            edges = np.searchsorted(row_of, np.arange(start, end + 1))
            many = np.diff(edges) > FEW_HELD
            for row in np.flatnonzero(many):
                here = slice(edges[row], edges[row + 1])
                counts[here] = _places(block[row], size[row], ids, held_user[here], held_score[here])
            few = np.arange(edges[0], edges[-1])
            few = few[~many[row_of[few] - start]]
            for at in range(0, len(few), step):
                here = few[at : at + step]
                others, mine = block[row_of[here] - start], held_score[here, None]
                same = others == mine
                earlier = (same & (ids[None, :] < held_user[here, None])).sum(axis=1)
                counts[here] = np.stack(
                    ((others < mine).sum(axis=1), same.sum(axis=1), (others > mine).sum(axis=1) + earlier, size[row_of[here] - start]), axis=1
                )
        return pd.DataFrame(
            {"question_id": wanted["question_id"], "user_id": held_user, "score": held_score,
             "below": counts[:, 0], "equal": counts[:, 1], "ahead": counts[:, 2], "candidates": counts[:, 3]}
        )

    cells = _cells(questions, users, seen, scored, question_block, user_block)
    names = ["below", "equal", "ahead", "candidates"]
    schema = "question_id long, user_id long, score double, " + ", ".join(f"{n} long" for n in names)
    parts = cells.groupBy("qb", "ub").applyInPandas(count, schema)
    return parts.groupBy("question_id", "user_id", "score").agg(*[F.sum(n).alias(n) for n in names])
