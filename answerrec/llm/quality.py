"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerrec.llm.base import fit_in_task, labelled
from answerrec.llm.grams import SOLID, STEP, mix, packs, word_hashes

SAMPLE_ROWS = 2_000
BITS = 14
BUCKETS = 2**BITS
CHARS = (2, 3, 4)


@dataclass
class Model:
    vectors: np.ndarray  # a row per bucket
    weights: np.ndarray  # vector size x 2
    bias: np.ndarray

    def direction(self) -> np.ndarray:
        """What one n-gram of each bucket adds to the log odds before averaging.

        Averaging and the output layer are linear, so the two may change places.
        """
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, first place of each part, index of its text) of all n-grams, in parts of bounded size.

    N-grams are single words, pairs of words (a word beside itself is one n-gram for all
    words) and 2 to 4 bytes of text. Case and punctuation stay. The bucket after the last
    one marks a place without n-gram.
    """
    for buffer, starts, owner in packs([t.encode("utf-8", "replace") for t in texts]):
        hashes, begin, _ = word_hashes(buffer, SOLID[buffer])
        first = np.searchsorted(begin, starts)
        pair = np.ones(len(hashes), np.uint64)  # beside itself
        pair[:-1] = np.where(hashes[1:] == hashes[:-1], pair[:-1], hashes[:-1] * STEP + hashes[1:])
        words = np.concatenate([bucket_of(hashes), np.full(1, BUCKETS, np.int32)])
        pairs = np.concatenate([bucket_of(mix(pair)), np.full(1, BUCKETS, np.int32)])
        pairs[np.append(first[1:], len(hashes)) - 1] = BUCKETS  # the last word of a part begins no pair
        for found in (words, pairs):
            yield found, first, owner
        zeros = np.flatnonzero(buffer == 0)
        packed = buffer.astype(np.uint32)
        for j in range(1, max(CHARS)):
            packed[: len(buffer) - j] |= buffer[j:].astype(np.uint32) << np.uint32(8 * j)
            if j + 1 in CHARS:
                found = (((packed + np.uint32(j)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
                for back in range(j + 1):
                    found[np.maximum(zeros - back, 0)] = BUCKETS
                yield found, starts, owner


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def totals(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at `first`; an empty stretch sums to nothing."""
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[np.append(first[1:], len(values))] - sums[first]


def score_texts(texts: list[str], direction: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1; a text without n-grams has the bias alone."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    values = np.append(direction, 0.0)
    for bucket, first, owner in grams(texts):
        np.add.at(total, owner, totals(values[bucket], first))
        np.add.at(count, owner, totals(bucket < BUCKETS, first))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def fit_quality(rows: pd.DataFrame, size: int = 8, epochs: int = 6, least_steps: int = 700, batch: int = 16, rate: float = 1.0) -> Model:
    """Stochastic gradient descent over averaged vectors, in `epochs` rounds or more until `least_steps` batches."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    weights, bias = np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    if not len(rows):
        return Model(vectors, weights, bias)
    label = rows["label"].to_numpy(np.int64)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for text in rows["text"].fillna(""):
        bucket = np.concatenate([b[b < BUCKETS] for b, _, _ in grams([text])])
        kinds, counts = np.unique(bucket, return_counts=True)
        bags.append((kinds.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    share = np.bincount(label, minlength=2) / len(label)
    bias = np.log(np.maximum(share, 1e-3)).astype(np.float32)
    weights = rng.normal(0, 0.5, (size, 2)).astype(np.float32)
    epochs = max(epochs, -(-least_steps * batch // len(rows)))  # few rows are seen more often
    steps, step = epochs * (len(rows) // batch + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = order[at : at + batch]
            now = rate * (1 - step / steps)
            step += 1
            index = np.concatenate([bags[i][0] for i in some])
            weight = np.concatenate([bags[i][1] for i in some])
            lengths = np.array([len(bags[i][0]) for i in some])
            doc = np.repeat(np.arange(len(some)), lengths)
            hidden = np.zeros((len(some), size), np.float32)
            np.add.at(hidden, doc, vectors[index] * weight[:, None])
            logits = hidden @ weights + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            error = chance
            error[np.arange(len(some)), label[some]] -= 1
            back = error @ weights.T
            weights -= now * (hidden.T @ error) / len(some)
            bias -= now * error.mean(0)
            # the averaging divides a vector's gradient by the length of its text; undo that scale
            np.subtract.at(vectors, index, (now * 30 / len(some)) * weight[:, None] * back[doc])
    return Model(vectors, weights, bias)


def train_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = SAMPLE_ROWS) -> Model:
    """Learn from at most `limit` labelled documents, as whole texts, outside the held-out fold.

    The sample is bounded, so one task holds it; its size does not grow with the table.
    """
    return fit_in_task(labelled(docs, labels, target, limit), fit_quality)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `score`, the probability of good quality of the whole text.

    A null text counts as empty; an empty text gets the score of the bias. Only the text
    enters a score. Rows are scored where they lie: no shuffle, ties and repeated rows get
    equal scores, an empty table stays empty. An existing column `score` is replaced.
    """
    direction, bias = model.direction(), float(model.bias[1] - model.bias[0])
    shared = docs.sparkSession.sparkContext.broadcast(direction)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            plain = texts.fillna("").tolist()
            yield pd.Series(np.concatenate([score_texts(plain[i : i + 64], shared.value, bias) for i in range(0, len(plain), 64)] or [np.empty(0)]))

    return docs.withColumn("score", score("text"))
