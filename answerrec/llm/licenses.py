"""License scans: n-gram logistic regression names the family of a stretch, its templates confirm it.

The classifier knows the families, licences of other families (`unknown`), and texts that are
no licence. What it takes for a family counts only if the stretch holds most of one of that
family's templates; what it takes for a licence otherwise is reported as unknown.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerrec.llm.base import fit_in_task
from answerrec.llm.grams import WORD, mix, pack, packs, shingles, word_hashes

BITS = 14
BUCKETS = 2**BITS
NONE, UNKNOWN = "none", "unknown"
SAMPLE_DOCUMENTS = 400  # about as many documents give examples of lines that are no licence
SAMPLE_LINES = 2_000  # of which so many enter the fit
CONFIRMED_FROM, PARTLY_FROM = 0.6, 0.3
WINDOWS = (6, 16, 48)  # words; one begins after every third of its length
AROUND = 60  # words on both sides of a candidate that are compared with the templates as well
UNIT, SHARED = 2**16, 2000  # letters of a paragraph that are classified at once, and how many of them twice

#: Notices by family; the wording is fixed by the licences. The versions in braces vary.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "Released under the GPL, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "public_domain": ["This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."],
    "proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. No part of this work may be reproduced without the prior written permission of the owner."],
}
PLAIN = [
    "The license plate of the car was lost in the public garden.", "She has a driving license and works under pressure.", "Permission to enter was granted by the general.",
    "Version 2.0 of the story was released on Monday.", "The software is described in the next chapter.", "Copies of the list are distributed in the class.",
    "Conditions of work are free of charge in the library.", "The above list of persons is complete.", "A warranty is included with the machine.",
    "He attributes his success to creative work in common with others.", "The foundation published a paper about free speech.", "We released the results under difficult conditions.",
]
BREAK = re.compile(r"\r\n?|\n")
MARK = re.compile(r"^[ \t]*(?:dnl|REM)\b")  # comment marks that look like words


def paragraphs(lines: list[str]) -> list[tuple[int, int]]:
    """The first line and the one after the last of each stretch of lines that hold a letter or digit."""
    out: list[tuple[int, int]] = []
    for i, line in enumerate(lines):
        if re.search(r"\w", line):
            if out and out[-1][1] == i:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of all single words, pairs and triples."""
    buckets, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for buffer, starts, owner in packs([t.lower().encode("utf-8", "replace") for t in texts]):
        hashes, begin, _ = word_hashes(buffer, WORD[buffer])
        part = np.searchsorted(starts, begin, "right") - 1
        for n in (1, 2, 3):
            h, who = shingles(hashes, part, n)
            buckets.append((mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[who])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    names: list[str]  # no licence, licences of other families, the families
    weights: np.ndarray  # bucket x class
    bias: np.ndarray
    heat: float  # the logits are divided by it, so that probabilities match frequencies

    def logits(self, texts: list[str]) -> np.ndarray:
        """Sparse scores: the mean weight of the n-grams of each text, times the root of their number."""
        bucket, owner = grams(texts)
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        total = np.stack([np.bincount(owner, w[bucket], len(texts)) for w in self.weights.T], axis=1)
        return total / np.sqrt(count)[:, None] + self.bias

    def chances(self, texts: list[str]) -> np.ndarray:
        """Probabilities by class."""
        return softmax(self.logits(texts) / self.heat) if texts else np.empty((0, len(self.names)))

    def windows(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Probabilities of the windows from word `begin` to before word `end`, as those of texts of their own."""
        total, count = np.zeros((len(begin), len(self.names))), np.zeros(len(begin))
        for n in (1, 2, 3):
            h, _ = shingles(hashes, np.zeros(len(hashes), np.int8), n)
            bucket = (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
            sums = np.concatenate((np.zeros((1, len(self.names))), np.cumsum(self.weights[bucket], axis=0)))
            last = np.maximum(end - n + 1, begin)
            some = last > begin
            total[some] += sums[last[some]] - sums[begin[some]]
            count += last - begin
        return softmax((total / np.sqrt(np.maximum(count, 1))[:, None] + self.bias) / self.heat)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def variants(text: str, rng: np.random.Generator) -> Iterator[str]:
    """A notice as it may be met: as it is, with a few words lost, inside other words."""
    words = text.split()
    yield text
    yield text.upper()
    for _ in range(3):
        keep = rng.random(len(words)) > 0.08
        yield " ".join(w for w, k in zip(words, keep) if k)
    yield "# " + text
    yield "Copyright (c) 2021 The Authors. " + text


def cut(line: str, kind: int, rng: np.random.Generator) -> str:
    """The line, or a window of its words."""
    words = line.split()
    size = (len(words), *WINDOWS)[kind]
    at = rng.integers(0, max(len(words) - size, 0) + 1)
    return " ".join(words[at : at + size]) if kind else line


#: Names by family and ways to name a licence, long and short.
NAMES = {
    "apache": ("Apache", "Apache"), "mit": ("MIT", "MIT"), "bsd": ("BSD", "BSD"), "gpl": ("GNU General Public", "GPL"), "lgpl": ("GNU Lesser General Public", "LGPL"),
    "agpl": ("GNU Affero General Public", "AGPL"), "mpl": ("Mozilla Public", "MPL"), "cc": ("Creative Commons Attribution", "CC BY"), "isc": ("ISC", "ISC"),
}
FORMS = [
    "Licensed under the {n} License, Version {v}.", "Released under the {n} License.", "This work is licensed under the {n} Licence, version {v}.",
    "SPDX-License-Identifier: {a}-{v}", "Distributed under the {n} Software License, Version {v}.", "Licensed under the {a}.", "Licensed under the {n}.",
    "You may use this file under the terms of the {n} License.", "This program is licensed under the {a}, version {v}.", "Released under the {a} {v}.",
    "This project is licensed under the {n} Public License.", "The {n} License applies to this software and its documentation.",
]
VERSIONS = ["1.0", "1.2", "2.0", "2.1", "3.0", "4"]


def named(family: str, rng: np.random.Generator) -> Iterator[str]:
    """The family's names in the forms that licences of any name take, so that the name decides."""
    if family in NAMES:
        n, a = NAMES[family]
        for form in FORMS:
            yield form.format(n=n, a=a, v=rng.choice(VERSIONS))


def strange(rng: np.random.Generator, count: int = 30) -> Iterator[str]:
    """Notices of licences with invented names."""
    syllable = lambda: "".join(rng.choice(list(part)) for part in ("bcdfgklmnprstvz", "aeiou"))
    for i in range(count):
        words = ["".join(syllable() for _ in range(rng.integers(2, 4))).capitalize() for _ in range(rng.integers(1, 4))]
        short = "".join(rng.choice(list("BCDEFKLNOPSTUVWXYZ")) for _ in range(rng.integers(3, 5)))
        for k in range(i, i + 6):
            yield FORMS[k % len(FORMS)].format(n=" ".join(words), a=short, v=rng.choice(VERSIONS))


@dataclass
class Examples:
    """Labelled texts as buckets of n-grams, sorted by text."""

    bucket: np.ndarray
    first: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, texts: list[str], label: list[int]) -> Examples:
        bucket, owner = grams(texts)
        order = np.argsort(owner, kind="stable")
        return cls(bucket[order], np.searchsorted(owner[order], np.arange(len(texts) + 1)), np.array(label))

    def root(self, i: int) -> float:
        return max(self.first[i + 1] - self.first[i], 1) ** 0.5

    def logits(self, weights: np.ndarray, bias: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.stack([weights[self.bucket[self.first[i] : self.first[i + 1]]].sum(axis=0) / self.root(i) + bias for i in some])

    def descend(self, some: np.ndarray, classes: int, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases by gradient descent over the given examples; rare classes step wider."""
        weights, bias = np.zeros((BUCKETS, classes)), np.zeros(classes)
        share = 1 / np.sqrt(np.maximum(np.bincount(self.label[some], minlength=classes), 1))
        for epoch in range(epochs):
            for i in rng.permutation(some):
                mine, root = self.bucket[self.first[i] : self.first[i + 1]], self.root(i)
                chance = softmax((weights[mine].sum(axis=0) / root + bias)[None])[0]
                chance[self.label[i]] -= 1
                step = 5.0 * share[self.label[i]] * (1 - epoch / epochs) * chance
                np.subtract.at(weights, mine, step / root)
                bias -= 0.1 * step
        return weights, bias


def fit_licenses(rows: pd.DataFrame, epochs: int = 30, epochs_without: int = 8) -> Model:
    """Logistic regression on notices, invented licences, plain sentences and lines of the corpus.

    Probabilities are calibrated on every fifth example, which the weights have not seen, and
    on each family as the classifier sees it when it was fitted without that family: there the
    right answer is `unknown`. A temperature and a shift of the unknown class are chosen for
    the least log loss on both.
    """
    rng = np.random.default_rng(11)
    names = [NONE, UNKNOWN, *sorted(TEMPLATES)]
    texts, label = [], []
    known = {" ".join(words_of(t)) for family in TEMPLATES.values() for t in family}
    for k, name in enumerate(names[2:], 2):
        for v in [v for template in TEMPLATES[name] for v in variants(template, rng)] + list(named(name, rng)):
            texts.append(v)
            label.append(k)
    others = list(strange(rng))
    texts += others
    label += [1] * len(others)
    lines = sorted({p for t in rows["text"].fillna("") for p in BREAK.split(t) if p.strip()}) if len(rows) else []
    lines = [p for p in lines if not re.search("licen[cs]e|copyright|permission", p, re.I) and " ".join(words_of(p)) not in known]
    lines = [cut(lines[i], k % 3, rng) for k, i in enumerate(rng.permutation(len(lines))[:SAMPLE_LINES])]
    plain = [*PLAIN * 2, *(cut(p, 1, rng) for p in PLAIN * 3), *lines]
    texts += plain
    label += [0] * len(plain)
    examples = Examples.of(texts, label)
    test = np.arange(len(label)) % 5 == 4
    train, unseen = np.flatnonzero(~test), np.flatnonzero(test)
    weights, bias = examples.descend(train, len(names), epochs, rng)
    logits, truth = [examples.logits(weights, bias, unseen)], [examples.label[unseen]]
    groups = [np.minimum(examples.label[unseen], 2)]
    for k in range(2, len(names)):
        rest = train[examples.label[train] != k]
        without = examples.logits(*examples.descend(rest, len(names), epochs_without, rng), np.flatnonzero(examples.label == k))
        without[:, k] = -1e9  # a family that it has never heard of
        logits.append(without)
        truth.append(np.ones(len(without), int))
        groups.append(np.full(len(without), 3))
    model = Model(names, weights, bias, 1.0)
    seen, right, group = np.concatenate(logits), np.concatenate(truth), np.concatenate(groups)
    share = 1 / np.bincount(group)[group] / len(np.unique(group))  # no licence, invented, known, left out: each counts alike

    def loss(setting: tuple[float, float]) -> float:
        heat, shift = setting
        moved = seen + shift * (np.arange(len(names)) == 1)
        return float(-(share * np.log(softmax(moved / heat)[np.arange(len(right)), right] + 1e-12)).sum())

    model.heat, shift = min(((h, b) for h in np.geomspace(0.1, 5, 30) for b in np.linspace(-2, 6, 33)), key=loss)
    model.bias = model.bias + shift * (np.arange(len(names)) == 1)
    return model


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


#: Word pairs and number of words of each template; the templates that hold a pair.
KNOWN = {(f, i): (pairs_of(words_of(t)), len(words_of(t))) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)}
HOLDERS: dict[tuple[str, str], list[tuple[str, int]]] = {}
for _name, (_pairs, _) in KNOWN.items():
    for _pair in _pairs:
        HOLDERS.setdefault(_pair, []).append(_name)


#: Word pairs of the forms that speak of a licence, whatever its name: one of them confirms an unknown one.
LICENCE_PAIRS = {
    pair for form in FORMS for part in re.split(r"\{\w\}", form) for pair in pairs_of(words_of(part))
    if any("licen" in w for w in pair) or pair[0] in ("released", "distributed")
}


@dataclass
class Place:
    share: float  # of the template's word pairs
    pairs: int
    family: str
    template: int
    start: int  # letters of the paragraph
    end: int


def places(text: str, offset: int) -> list[Place]:
    """Where stretches hold 30 % of a template's word pairs; a stretch is little longer than its template."""
    words = [(m.group(), m.start() + offset, m.end() + offset) for m in re.finditer(r"\w+", text)]
    hits: dict[tuple[str, int], list[int]] = {}
    for i in range(len(words) - 1):
        for name in HOLDERS.get((words[i][0], words[i + 1][0]), ()):
            hits.setdefault(name, []).append(i)
    out = []
    for name, at in hits.items():
        pairs, size = KNOWN[name]
        reach = size * 4 // 3 + 3
        held: dict[tuple[str, str], int] = {}
        first = 0
        for i in at:
            pair = words[i][0], words[i + 1][0]
            held[pair] = held.get(pair, 0) + 1
            while True:  # the first pair goes if it is too far away or stands in the stretch again
                head = words[at[first]][0], words[at[first] + 1][0]
                if i + 2 - at[first] <= reach and held[head] == 1:
                    break
                held[head] -= 1
                if not held[head]:
                    del held[head]
                first += 1
            if len(held) / len(pairs) >= PARTLY_FROM:
                out.append(Place(len(held) / len(pairs), len(held), *name, words[at[first]][1], words[i + 1][2]))
    return out


def units(blocks: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of bounded size: (number, offset, text) of paragraphs; long ones in parts that overlap."""
    held, size = [], 0
    for i, block in enumerate(blocks):
        at = 0
        while at < len(block):
            part = block[at : at + UNIT]
            if size + len(part) > 2 * UNIT and held:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
            at += UNIT - SHARED if at + UNIT < len(block) else len(block)
    if held:
        yield held


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, unit) of all windows of units with so many words."""
    begins, ends, owners = [], [], []
    for k, (first, n) in enumerate(zip(np.cumsum(counts) - counts, counts)):
        for size in WINDOWS:
            if not n:
                break
            begin = np.append(np.arange(0, max(n - size, 0), size // 3), max(n - size, 0))
            begins.append(begin + first)
            ends.append(np.minimum(begin + size, n) + first)
            owners.append(np.full(len(begin), k))
            if n <= size:
                break
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *x]).astype(np.int64) for x in (begins, ends, owners))


def free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether none of the sorted stretches, which do not overlap, has a letter of this one."""
    before = bisect_left(taken, (end,)) - 1
    return before < 0 or taken[before][1] <= start


@dataclass
class Region:
    """A stretch of a paragraph whose windows are candidates, with its surroundings."""

    start: int  # letters of the paragraph
    end: int
    chance: np.ndarray  # by class: the largest one, of `none` the smallest
    places: list[Place]
    strange: tuple[int, int]  # the window that looks most like an unknown licence


def regions(blocks: list[str], model: Model, least: float) -> Iterator[tuple[int, Region]]:
    """(paragraph, region) of all candidates."""
    for group in units(blocks):
        buffer, starts, _ = pack([(i, t.encode("utf-8", "replace")) for i, _, t in group])
        hashes, begin, end = word_hashes(buffer, WORD[buffer])
        owner = np.searchsorted(starts, begin, "right") - 1
        counts = np.bincount(owner, minlength=len(group))
        low, high, unit = spans(counts)
        if not len(low):
            continue
        chance = model.windows(hashes, low, high)
        picked = np.flatnonzero(chance[:, 0] < 1 - least)
        picked = picked[np.lexsort((low[picked], unit[picked]))]
        firsts = np.cumsum(counts) - counts
        joined: list[list] = []  # unit, first word, word after the last, windows
        for w in picked:
            k, a, b = int(unit[w]), int(low[w]), int(high[w])
            if joined and joined[-1][0] == k and a <= joined[-1][2]:
                joined[-1][2] = max(joined[-1][2], b)
                joined[-1][3].append(w)
            else:
                joined.append([k, a, b, [w]])
        for k, a, b, members in joined:
            a, b = max(a - AROUND, firsts[k]), min(b + AROUND, firsts[k] + counts[k])
            i, offset, _ = group[k]
            letters = lambda low, high: len(buffer[low:high].tobytes().decode())
            odd = members[int(chance[members, 1].argmax())]
            odd_start = offset + letters(starts[k], begin[low[odd]])
            window = odd_start, odd_start + letters(begin[low[odd]], end[high[odd] - 1])
            offset += letters(starts[k], begin[a])
            text = buffer[begin[a] : end[b - 1]].tobytes().decode()
            best = chance[members].max(axis=0)
            best[0] = chance[members, 0].min()
            yield i, Region(offset, offset + len(text), best, places(text, offset), window)


def scan(text: str, model: Model, least: float) -> list[dict]:
    """The places of a text that hold a license notice, in order."""
    lines = BREAK.split(text)
    ranges = paragraphs(lines)
    bare = [MARK.sub("", line).lower() for line in lines]
    blocks = ["\n".join(bare[a:b]) for a, b in ranges]
    by_block: dict[int, list[Region]] = {}
    for i, region in regions(blocks, model, least):
        by_block.setdefault(i, []).append(region)
    out = []
    for i, found in sorted(by_block.items()):
        first, last = ranges[i]
        begins = np.cumsum([0, *(len(line) + 1 for line in bare[first:last])]).tolist()

        def notice(start: int, end: int, family: str, chance: float, number: int, share: float, begins=begins, first=first, i=i) -> tuple[int, dict]:
            a, b = bisect_right(begins, start) - 1, bisect_right(begins, max(start, end - 1))
            return start, {"paragraph": i, "family": family, "probability": chance, "template": number, "overlap": share, "notice": "\n".join(lines[first + a : first + b])}

        taken: list[tuple[int, int]] = []
        rows: list[tuple[int, dict]] = []
        # the classifier names the family of each stretch that most of some template stands in ...
        stretches = [p for r in found for p in r.places if p.share >= CONFIRMED_FROM]
        chance = model.chances([blocks[i][p.start : p.end] for p in stretches])
        named = [(p, c, model.names[int(c.argmax())]) for p, c in zip(stretches, chance)]
        # ... and a template of that family has to confirm it; of several the one that fits best, then the longer
        confirmed = [(p, float(c.max())) for p, c, family in named if family == p.family]
        for p, share in sorted(confirmed, key=lambda x: (-x[0].share, -x[0].pairs, -x[1], x[0].template, x[0].start)):
            if free(taken, p.start, p.end):
                insort(taken, (p.start, p.end))
                rows.append(notice(p.start, p.end, p.family, share, p.template, p.share))
        for r in found:
            if r.chance[0] >= 0.5:
                continue
            # a licence, but of no family that a template confirms
            partly = max(r.places, key=lambda p: (p.share, p.pairs, -p.start), default=None)
            if partly and free(taken, partly.start, partly.end):
                start, end, share = partly.start, partly.end, partly.share
            elif r.chance[1] >= 0.5 and free(taken, *r.strange) and LICENCE_PAIRS & pairs_of(words_of(blocks[i][slice(*r.strange)])):
                (start, end), share = r.strange, 0.0
            else:
                continue
            c = model.chances([blocks[i][start:end]])[0]
            other = float(1 - c[0] - (c[2:].max() if c[2:].argmax() + 2 == c.argmax() else 0))
            if c[0] < 0.5:
                insort(taken, (start, end))
                rows.append(notice(start, end, UNKNOWN, min(max(other, 0.0), 1.0), -1, share))
        out += [row for _, row in sorted(rows, key=lambda x: x[0])]
    return out


FOUND = "struct<paragraph:int,family:string,probability:double,template:int,overlap:double,notice:string>"


def train_licenses(docs: DataFrame, limit: int = SAMPLE_DOCUMENTS) -> Model:
    """Learn from the notices and from lines of about `limit` documents, drawn where they lie by a hash of the id."""
    number = docs.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, number))) < limit
    return fit_in_task(docs.select("doc_id", "text").where(drawn).limit(2 * limit), fit_licenses)


def scan_licenses(docs: DataFrame, model: Model, least: float = 0.2) -> DataFrame:
    """Adds `licenses`: the places of the whole text that hold a license notice.

    A paragraph is a stretch of lines between lines without letters and digits (blank ones,
    or only comment marks), so a notice may run over its lines. Windows of 6, 16 and 48 words
    of a paragraph are candidates if the classifier gives them at least `least` of being any
    license; what else stands in the paragraph does not count. In the words around candidates,
    stretches that hold 60 % of a template's word pairs are given to the classifier: if it
    names the template's family, the stretch is a notice of it, with the probability of the
    family. Stretches that it takes for a license without that are reported as `unknown`, if
    30 % of a template stands there, or if the unknown class has at least one half and words
    such as "licensed under" stand there; their probability is that of a license that is not of the likeliest family. Notices do not overlap.
    `paragraph` counts from 0, `notice` is the lines the stretch touches. Null and empty texts,
    and texts without notices, give an empty array. Repeated rows give repeated results, an
    empty table an empty one; a column of that name is replaced. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.StructType.fromDDL(FOUND.removeprefix("struct<").removesuffix(">").replace(":", " "))))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([scan(t or "", shared.value, least) for t in texts], dtype=object)

    return docs.withColumn("licenses", find("text"))
