"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerrec.llm.base import checkpoint, labelled

SAMPLE_ROWS = 20_000
LEARNED_TERMS = 400
CACHED_TOKENS = 300_000

INSULTS = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass loser losers pathetic worthless scum trash
garbage clown clowns disgusting filthy filth vermin pig pigs rat rats scumbag bastard bastards bitch bitches asshole
jerk jerks creep creeps freak freaks retard retarded imbecile cretin fool fools fuck fucking fucker shit shitty crap
damn hate hated hateful ugly fat sick kill die whore slut coward cowards liar liars useless parasite parasites
""".split()
PRONOUNS = set("you your yours yourself youre ur u du dich dir dein deine ihr euch tu te toi vous votre vos usted ustedes ti tus".split())
LEET = str.maketrans("013457@$!+|*", "oieastasitl ")
REPEATED = re.compile(r"(.)\1{2,}")
MIXED = re.compile(r"[^\W\d_][\d@$!*+|]+[^\W\d_]")

FEATURES = [
    "listed", "listed_log", "learned", "learned_log", "learned_top", "second_person", "near_second_person", "upper", "upper_words",
    "punctuation", "exclamation", "question", "symbols", "digits", "obfuscated", "stretched", "single_letters", "word_length", "words_log",
]

PUNCTUATION = np.zeros(128, bool)
PUNCTUATION[[ord(c) for c in ".,;:!?'\"()-"]] = True
SYMBOLS = np.zeros(128, bool)
SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[]^_`{|}~\\"]] = True


def plain(token: str) -> str:
    """A token in lower case without outer punctuation, spelling tricks undone."""
    bare = token.strip(".,;:?'\"()[]{}<>#%&-_")
    if not bare.isalpha():
        bare = bare.rstrip("!").translate(LEET).replace(" ", "")
    return REPEATED.sub(r"\1", bare)


def stems(word: str) -> set[str]:
    """What a learned lexicon may hold of a word: the word, and its first four and five letters."""
    return {word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)} if word.isalpha() and len(word) > 2 else set()


@dataclass
class Lexicon:
    """Words with their weights; learned ones may end in * for any ending."""

    listed: frozenset[str]
    learned: dict[str, float]

    def __post_init__(self):
        self.cache: dict[str, tuple[int, float, int, int, int]] = {}  # filled in a worker

    def look_up(self, token: str) -> tuple[int, float, int, int, int]:
        """(listed, learned weight, second person, obfuscated, stretched) of a token."""
        if len(self.cache) > CACHED_TOKENS:
            self.cache.clear()
        word, odd, stretched = token, 0, REPEATED.search(token) is not None
        if not token.isalpha():
            word, odd = plain(token), MIXED.search(token) is not None
        elif stretched:
            word = REPEATED.sub(r"\1", token)
        weight = 0.0
        if len(word) > 2 and word.isalpha():
            learned = self.learned.get
            weight = max(learned(word, 0.0), learned(word[:4] + "*", 0.0) if len(word) > 4 else 0.0, learned(word[:5] + "*", 0.0) if len(word) > 5 else 0.0)
        found = (int(word in self.listed), weight, int(word in PRONOUNS), int(odd), int(stretched))
        self.cache[token] = found = found if any(found) else NOTHING
        return found


NOTHING = (0, 0.0, 0, 0, 0)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text; all are 0 for an empty one."""
    lower = text.lower()
    tokens = lower.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    listed = second = odd = stretched = hits = 0
    learned = top = 0.0
    marked: set[str] = set()
    known, counted = lexicon.cache.get, Counter(tokens)
    for token, k in counted.items():
        found = known(token) or lexicon.look_up(token)
        if found is NOTHING:
            continue
        a, weight, you, mixed, long = found
        listed += a * k
        learned += weight * k
        hits += k if weight else 0
        top = max(top, weight)
        second += you * k
        odd += mixed * k
        stretched += long * k
        if a or weight:
            marked.add(token)
    letters = len("".join(tokens))
    single = sum(k for token, k in counted.items() if len(token) == 1) if letters < 3 * n else 0
    near = 0
    if marked and second:
        places = [i for i, t in enumerate(tokens) if t in marked]
        people = np.array([i for i, t in enumerate(tokens) if lexicon.look_up(t)[2]])
        at = np.searchsorted(people, places)
        before = np.abs(people[np.maximum(at - 1, 0)] - places)
        after = np.abs(people[np.minimum(at, len(people) - 1)] - places)
        near = int((np.minimum(before, after) <= 5).sum())
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    small = np.frombuffer(lower.encode("utf-32-le", "replace"), np.uint32)
    upper = int((codes != small).sum()) if len(codes) == len(small) else sum(map(str.isupper, text))
    ascii_codes = codes[codes < 128]
    counts = np.bincount(ascii_codes, minlength=128)
    size = len(codes)
    capital = sum(map(str.isupper, text.split())) if upper > 0.02 * size else 0
    return [
        listed / n, np.log1p(listed), learned / n, np.log1p(hits), top, second / n, near / n, upper / size, capital / n,
        counts[PUNCTUATION].sum() / size, counts[33] / size, counts[63] / size, counts[SYMBOLS].sum() / size, counts[48:58].sum() / size,
        odd / n, stretched / n, single / n, letters / n, np.log1p(n),
    ]


def with_features(docs: DataFrame, lexicon: Lexicon, out: str = "_features") -> DataFrame:
    """Adds the features as an array of doubles; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = shared.value
        for texts in batches:
            yield pd.Series([[float(x) for x in features(t or "", lexicon)] for t in texts], dtype=object)

    return docs.withColumn(out, compute("text"))


def learn_lexicon(sample: DataFrame, terms: int = LEARNED_TERMS) -> dict[str, float]:
    """The words and stems that mark label 1: at most `terms`, with weights up to 1.

    A term counts once per text. It is taken if it stands in at least 3 texts of label 1 and
    is at least 5 times as frequent there as in the others; the strongest `terms` are kept.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({s for t in set((x or "").lower().split()) for s in stems(plain(t))}) for x in texts], dtype=object)

    counts = (
        sample.select("label", F.explode(found("text")).alias("term"))
        .groupBy("term")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .where("bad >= 3")
    )
    sizes = sample.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    n_bad, n_good = sizes["bad"] or 0, sizes["good"] or 0
    if not n_bad or not n_good:
        return {}
    ratio = ((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1))
    best = counts.withColumn("ratio", ratio).where("ratio >= 5").withColumn("gain", F.col("bad") * F.log("ratio")).orderBy(F.desc("gain"), "term").limit(terms)
    return {r["term"]: min(1.0, float(np.log(r["ratio"])) / 6) for r in best.collect()}


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float  # the score without trees


def train_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", limit: int = SAMPLE_ROWS, trees: int = 20, depth: int = 3) -> Model:
    """Learn from at most `limit` labelled documents outside the held-out fold.

    The sample falls into three parts by a hash of the id: the lexicon is learned on one, the
    trees on the second, whose texts the lexicon has not seen, the calibration on the third.
    Without both labels in the tree part the score is the share of label 1.
    """
    sample = labelled(docs, labels, target, limit).withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10)))
    sample = checkpoint(sample.select("doc_id", "text", "label", "_part"))
    lexicon = Lexicon(frozenset(INSULTS), learn_lexicon(sample.where("_part < 4")))
    # a bounded number of rows: few partitions, so that each tree level is a small job
    rows = with_features(sample.where("_part >= 4"), lexicon).select("_part", F.col("label").cast("double").alias("label"), array_to_vector("_features").alias("features"))
    rows = checkpoint(rows.coalesce(6))
    seen = rows.agg(F.avg("label").alias("base"), F.count_distinct(F.when(F.col("_part") < 8, F.col("label"))).alias("kinds")).first()
    base = float(seen["base"] or 0.0)
    if seen["kinds"] < 2:
        return Model(lexicon, None, None, base)
    booster = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, checkpointInterval=-1)
    model = booster.fit(rows.where("_part < 8"))
    rated = model.transform(rows.where("_part >= 8")).select("label", vector_to_array("probability")[1].alias("raw"))
    if not rated.head(1):
        return Model(lexicon, model, None, base)
    # two rows at the ends keep the scale open where the calibration rows are pure
    ends = rows.sparkSession.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 1.0)], "label double, raw double, weight double")
    rated = rated.withColumn("weight", F.lit(1.0)).unionByName(ends)
    return Model(lexicon, model, IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(rated), base)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `score`, the calibrated probability of label 1 of the whole text.

    A null text counts as empty; an empty text has features of 0 and a score like any other.
    Only the text enters. Nothing is shuffled; equal texts get equal scores; an empty table
    stays empty. An existing column `score` is replaced.
    """
    kept = [c for c in docs.columns if c != "score"]
    if model.trees is None:
        return docs.select(*kept).withColumn("score", F.lit(model.base))
    rows = with_features(docs.select(F.struct(*kept).alias("_row"), "text"), model.lexicon).withColumn("_vector", array_to_vector("_features"))
    trees = model.trees.copy()
    trees.setFeaturesCol("_vector").setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    rated = trees.transform(rows).withColumn("_raw", vector_to_array("_probability")[1])
    if model.calibration is None:
        return rated.select("_row.*", F.col("_raw").alias("score"))
    calibration = model.calibration.copy()
    calibration.setFeaturesCol("_raw").setPredictionCol("_score")
    return calibration.transform(rated).select("_row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))).alias("score"))
