"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerrec.llm.base import fit_in_task, fold, unused
from answerrec.llm.grams import packs

SAMPLE_ROWS = 4_000
BROADCAST_LANGUAGES = 10_000
BITS = 12
BUCKETS = 2**BITS
UNKNOWN = "und"

#: Families of closely related languages by code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def letters_of(text: str) -> bytes:
    """The words of a text in lower case, letters only, with a space at both ends of each."""
    lower = text.lower()
    if not lower.replace(" ", "").isalpha():
        lower = "".join(c if c.isalpha() else " " for c in lower) if not lower.isascii() else lower.translate(NO_LETTERS)
    words = lower.split()
    return (" " + " ".join(words) + " ").encode("utf-8", "replace") if words else b""


NO_LETTERS = {c: " " for c in range(128) if not chr(c).isalpha()}


def profiles(texts: list[str]) -> np.ndarray:
    """A row per text: the square roots of the shares of its hashed 1- to 4-byte grams, of length 1."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for buffer, starts, owner in packs([letters_of(t) for t in texts]):
        zeros = np.flatnonzero(buffer == 0)
        packed = buffer.astype(np.uint32)
        for j in range(4):
            if j:
                packed[: len(buffer) - j] |= buffer[j:].astype(np.uint32) << np.uint32(8 * j)
            bucket = ((packed + np.uint32(j)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            keep = np.ones(len(buffer), bool)
            for back in range(j + 1):
                keep[np.maximum(zeros - back, 0)] = False
            for a, b, i in zip(starts, np.append(starts[1:], len(buffer)), owner):
                out[i] += np.bincount(bucket[a:b][keep[a:b]], minlength=BUCKETS)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, steps: int = 60, cost: float = 50.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps.

    y is +1 or -1; both sides weigh alike.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * cost
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    u, c, momentum = w, b, 1.0
    rate = 1 / (1 + 4 * cost)  # rows have length 1
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ u + c)).astype(np.float32) * y * weight
        new_w, new_b = u - rate * (u - 2 * (slack @ x)), c + rate * 2 * float(slack.sum())
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        u, c = new_w + (momentum - 1) / after * (new_w - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new_w, new_b, after
    return w, b


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    top: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)  # a family against the rest
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The family of the largest margin, then the language with the most won duels in it."""
        if not self.families:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        x = profiles(texts)
        empty = ~x.any(axis=1)
        chance = lambda m: 1 / (1 + np.exp(-4 * m))
        names = sorted(self.families)
        margins = np.stack([x @ self.top[f][0] + self.top[f][1] if f in self.top else np.ones(len(x)) for f in names])
        best = margins.argmax(axis=0)
        langs, scores = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        for k, family in enumerate(names):
            some = np.flatnonzero((best == k) & ~empty)
            members = self.families[family]
            votes = np.zeros((len(some), len(members)))
            worth = np.zeros((len(some), len(members)))
            for a, b in combinations(range(len(members)), 2):
                w, c = self.pairs[members[a], members[b]]
                won = chance(x[some] @ w + c)
                votes[:, a] += won >= 0.5
                votes[:, b] += won < 0.5
                worth[:, a] += won
                worth[:, b] += 1 - won
            rank = votes + worth / max(1, len(members))  # equal votes: the surer duels
            chosen = rank.argmax(axis=1)
            langs[some] = np.array(members, object)[chosen]
            sure = worth[np.arange(len(some)), chosen] / max(1, len(members) - 1) if len(members) > 1 else 1.0
            scores[some] = chance(margins[k, some]) * sure
        return langs.tolist(), np.clip(scores, 0, 1).tolist()


def fit_languages(rows: pd.DataFrame) -> Model:
    """One machine per family against the rest, and one per pair of languages of a family."""
    model = Model()
    texts = rows["text"].fillna("").tolist()
    lang = rows["lang"].to_numpy(object)
    for code in sorted(set(lang)):
        model.families.setdefault(FAMILY_OF.get(code, code), []).append(code)
    if not len(rows):
        return model
    x = profiles(texts)
    some = x.any(axis=1)
    x, lang = x[some], lang[some]
    family = np.array([FAMILY_OF.get(code, code) for code in lang], object)
    if len(model.families) > 1:
        for name in model.families:
            model.top[name] = machine(x, np.where(family == name, 1.0, -1.0).astype(np.float32))
    for members in model.families.values():
        for a, b in combinations(members, 2):
            both = (lang == a) | (lang == b)
            model.pairs[a, b] = machine(x[both], np.where(lang[both] == a, 1.0, -1.0).astype(np.float32))
    return model


def train_languages(docs: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """Learn from about `limit` documents with a language, outside the held-out fold.

    Every language gets an equal share of the sample; documents are chosen by a hash of their
    id, so rare languages are not lost and the sample does not grow with the table.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    counts = known.groupBy("lang").count().withColumnRenamed("count", "_rows").withColumnRenamed("lang", "_lang")
    langs = max(1, counts.count())
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.col("_rows")) < max(1, limit // langs)
    # a row per language; drawn where they lie, so texts are not shuffled by language
    counts = F.broadcast(counts) if langs <= BROADCAST_LANGUAGES else counts
    sample = known.join(counts, F.col("lang") == F.col("_lang")).where(drawn).select("doc_id", "text", "lang")
    return fit_in_task(sample, fit_languages)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `lang_pred` and `score` (0 to 1) for the whole text.

    A null text, and one without any letter, is `und` with score 0. Only the text enters.
    Nothing is shuffled; equal texts get equal results; an empty table stays empty. Columns
    with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            plain = texts.fillna("").tolist()
            found = [shared.value.predict(plain[i : i + 64]) for i in range(0, len(plain), 64)]
            yield pd.DataFrame({"lang": [x for f in found for x in f[0]], "score": [x for f in found for x in f[1]]})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    (found,) = unused(docs, "_found")
    out = F.col(f"{found}.lang").alias("lang_pred"), F.col(f"{found}.score").alias("score")
    return docs.select(*kept, predict("text").alias(found)).select(*kept, *out)
