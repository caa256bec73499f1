"""Benchmark decontamination: exact hits of pieces, verified by Myers' bit-parallel distance.

An item is cut into pieces, pieces into groups of two or three. If a stretch of n pieces stands
in a text with fewer than n edits, then in one of its groups there are fewer edits than pieces,
so one piece of it stands unchanged. So the pieces are searched exactly, in one pass over each
text; where one is hit, its group is compared, and only where that fits as well the whole item,
its windows and its lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerrec.llm.base import checkpoint, unused
from answerrec.session import materialize

ERROR_RATE = 0.1
MIN_CHARS = 20
PIECE = 10  # letters of a piece, at most
WINDOW_SHARE, WINDOW_PIECES = 0.6, 16  # a window is this share of the item, or so many pieces if that is less
LINE_CHARS = 50  # a line of an item counts alone from here on
BLOCK_ITEMS = 20_000

SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
PLACE = "item_id bigint, distance int, start int, end int, letters int"
FOUND = f"array<struct<{PLACE}>>"


def normal(text: str) -> str:
    """Lower case; everything but letters and digits becomes one space."""
    lower = text.lower()
    if not lower.isascii():
        for c in set(lower):
            if c > "\x7f" and not c.isalnum():
                lower = lower.replace(c, " ")
    return b" ".join(lower.encode("utf-8", "replace").translate(SPACED).split()).decode()


def masks(pattern: str) -> dict[str, int]:
    """For each letter, the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of a pattern of length m in a text, the first of equal ones.

    Bit i of `up` and `down` says whether the edit distance grows or falls from row i to row
    i + 1 of a column; a column is advanced in a few operations on whole numbers. None if no
    place is within `most` edits.
    """
    everything, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = everything, 0, m
    best = (most + 1, -1)
    for at, c in enumerate(text):
        match = peq.get(c, 0) | down
        carry = ((((match & up) + up) ^ up) | match) & everything
        right, left = down | (everything & ~(carry | up)), up & carry
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        # a place may begin anywhere: the row above the first stays 0
        right, left = right << 1 & everything, left << 1 & everything
        up, down = left | (everything & ~((peq.get(c, 0) | down) | right)), right & (peq.get(c, 0) | down)
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= most else None


class Stretch:
    """A normalised text that is searched: an item or one of its lines, its pieces, groups and windows."""

    def __init__(self, item: int | None, text: str, rate: float, windows: bool):
        self.item, self.text, self.rate = item, text, rate
        size = len(text)
        parts = max(int(size * rate) + 1, size // PIECE)
        self.cuts = [size * i // parts for i in range(parts + 1)]
        self.groups = [(i, i + 2) for i in range(0, parts - 1, 2)] or [(0, 1)]
        self.groups[-1] = (self.groups[-1][0], parts)
        self.spans = [(0, len(self.groups))]  # of groups: the whole, then the windows
        wide = -(-min(int(parts * WINDOW_SHARE) + 1, WINDOW_PIECES) // 2)
        if windows and wide < len(self.groups):
            self.spans += [(g, g + wide) for g in range(len(self.groups) - wide + 1)]
        self.masks: dict[tuple[int, int], tuple[dict[str, int], dict[str, int]]] = {}

    def bounds(self, low: int, high: int) -> tuple[int, int]:
        """The letters of the groups from `low` to before `high`."""
        return self.cuts[self.groups[low][0]], self.cuts[self.groups[high - 1][1]]

    def find(self, text: str, low: int, high: int, begins: list[tuple[int, int]], most: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best place of these groups, if they may begin in the ranges."""
        a, b = self.bounds(low, high)
        m = b - a
        if (low, high) not in self.masks:
            self.masks[low, high] = masks(self.text[a:b]), masks(self.text[a:b][::-1])
        forward, backward = self.masks[low, high]
        best = None
        for first, last in merged(begins, most):
            start = max(0, first - most)
            window = text[start : last + m + most]
            if len(window) < m - most:
                continue
            found = best_match(forward, m, window, most)
            if found and (best is None or found[0] < best[0]):
                distance, stop = found
                # the start, from the end backwards
                back = best_match(backward, m, window[:stop][::-1], distance)
                best = (distance, start + stop - (back[1] if back else m), start + stop)
        return best

    def fits(self, text: str, at: int, piece: int, group: int) -> bool:
        """Whether the group of a piece that stands at `at` has fewer edits than pieces there."""
        low, high = self.groups[group]
        if high - low == 1:
            return True
        if high - low == 2:  # one edit: half of the other piece is unchanged
            other = low + high - 1 - piece
            a, b = self.cuts[other], self.cuts[other + 1]
            if other > piece:
                end = at + a - self.cuts[piece]
                near = text[end : end + b - a + 1]
            else:
                near = text[max(0, at - (b - a) - 1) : at]
            half = (a + b) // 2
            if self.text[a:half] not in near and self.text[half:b] not in near:
                return False
        begin = at - self.cuts[piece] + self.cuts[low]
        return self.find(text, group, group + 1, [(begin, begin)], high - low - 1) is not None

    def best(self, text: str, hits: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        """(distance, start, end, letters) of the whole, or else of its best window: the least distance, the first place.

        `hits` has the place where the whole would begin, and the group that fits there.
        """
        for part in (self.spans[:1], self.spans[1:]):
            found = []
            for low, high in part:
                a, b = self.bounds(low, high)
                if begins := sorted({(at + a, at + a) for at, g in hits if low <= g < high}):
                    pieces = self.groups[high - 1][1] - self.groups[low][0]
                    place = self.find(text, low, high, begins, min(int((b - a) * self.rate), pieces - 1))
                    if place:
                        found.append((*place, b - a))
            if found:
                return min(found)
        return None


@dataclass
class Items:
    """A block of items: its automaton of pieces is built once per worker."""

    texts: dict[int, list[str]]  # normalised, by key: the whole, then the lines that count alone
    short: dict[int, str] = field(default_factory=dict)  # normalised texts that are found only as they stand, by key
    rate: float = ERROR_RATE
    ids: dict[int, int | None] = field(default_factory=dict)  # item ids by key, where they differ
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"texts": self.texts, "short": self.short, "rate": self.rate, "ids": self.ids, "_ready": {}}

    def ready(self):
        if not self._ready:
            stretches = [Stretch(self.ids.get(key, key), t, self.rate, i == 0) for key, texts in self.texts.items() for i, t in enumerate(texts)]
            pieces: dict[str, list[tuple[int, int, int]]] = {}
            for s, stretch in enumerate(stretches):
                for g, (low, high) in enumerate(stretch.groups):
                    for i in range(low, high):
                        pieces.setdefault(stretch.text[stretch.cuts[i] : stretch.cuts[i + 1]], []).append((s, i, g))
            words: dict[str, list[int | None]] = {}
            for key, text in self.short.items():
                words.setdefault(f" {text} ", []).append(self.ids.get(key, key))
            self._ready = {"pieces": automaton(pieces), "words": automaton(words), "stretches": stretches}
        return self._ready

    def search(self, raw: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item, distance, start, end, letters) of the best place of each item found, in the normalised text."""
        if not raw or not (self.texts or self.short):
            return []
        ready = self.ready()
        stretches = ready["stretches"]
        text = normal(raw)
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in ready["pieces"].iter(text) if ready["pieces"] else ():
            at = end - size + 1
            for s, piece, group in places:
                if stretches[s].fits(text, at, piece, group):
                    hits.setdefault(s, []).append((at - stretches[s].cuts[piece], group))
        out: dict[int | None, tuple[int, int, int, int]] = {}
        for end, (size, items) in ready["words"].iter(f" {text} ") if ready["words"] else ():
            for item in items:  # the first place of the longest text of an item
                if item not in out or out[item][3] < size - 2:
                    out[item] = (0, end - size + 1, end - 1, size - 2)
        for s in sorted(hits):
            item = stretches[s].item
            if item in out and out[item][3] > len(stretches[s].text):
                continue
            found = stretches[s].best(text, hits[s])
            # the text or line of an item of which most is found, then the least distance, the first place
            if found and (item not in out or (-found[3], *found) < (-out[item][3], *out[item])):
                out[item] = found
        return sorted(((item, *found) for item, found in out.items()), key=lambda f: (f[0] is None, f[0] or 0))


def automaton(words: dict[str, list]):
    """Finds all words at once, each with its length and what it stands for; None if there are none."""
    found = ahocorasick.Automaton()
    for word, meaning in words.items():
        found.add_word(word, (len(word), meaning))
    if not words:
        return None
    found.make_automaton()
    return found


def stretches_of(raw: str, min_chars: int) -> list[str]:
    """The normalised item, then those of its lines that count alone; none if it is too short."""
    whole = normal(raw)
    lines = dict.fromkeys(normal(line) for line in raw.splitlines())
    return [whole, *(t for t in lines if max(LINE_CHARS, min_chars) <= len(t) < len(whole))] if len(whole) >= min_chars else []


def merged(begins: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """Ranges of possible starts; those closer than `reach` are searched together."""
    out: list[tuple[int, int]] = []
    for low, high in begins:
        if out and low - out[-1][1] <= 2 * reach + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def find_items(
    docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block: int = BLOCK_ITEMS, unnamed: bool = False, short: bool = True
) -> DataFrame:
    """Adds `found`: for each item of a benchmark that the text holds, its best place.

    Texts and items are compared in lower case, with everything but letters and digits as one
    space. An item is found if a stretch of the text is within floor(rate x length) edits of
    the whole item or, where that is not so, of one of its windows (60 % of the item in its
    pieces of at most 10 letters, at most 16 pieces; one begins every second piece) or of one
    of its lines of 50 letters or more, with their own length and fewer edits than pieces.
    `distance`, `start` and `end` (in the normalised text) describe the best place of the
    whole, or else of what is found of it; `letters` is how many letters of the item were
    compared. Items that normalise to fewer than `min_chars` letters are found only where they
    stand exactly, as whole words, and with `short=False` not at all; items without a letter
    or digit, and null ones, are never found. Of several texts with a common id each is searched,
    and the one of which most is found is described; texts without id are searched if
    `unnamed` is set, together as one item without id. Null and empty texts hold nothing;
    repeated rows are each searched; an empty table on either side gives no places. Other
    columns stay.

    Up to `block` items are broadcast at once, and the texts are not shuffled. A larger
    benchmark is searched block by block: each pass over the texts writes the places it finds,
    by a hash of the text, and has one block in its workers; the places join the texts at the
    end. The driver holds one block at a time.
    """
    some = F.col("text").isNotNull() if unnamed else F.col("item_id").isNotNull() & F.col("text").isNotNull()
    texts = items.where(some).select(F.col("item_id").cast("long"), "text").distinct()
    count = texts.count()
    blocks = max(1, -(-count // block))
    texts = checkpoint(texts.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))) if blocks > 1 else texts.withColumn("_block", F.lit(0))
    kept = [c for c in docs.columns if c != "found"]
    if blocks == 1:
        return docs.select(*kept, searcher(block_of(texts, 0, rate, min_chars, short))("text").alias("found"))
    h1, h2, places = unused(docs, "_h1", "_h2", "_places")
    key = F.xxhash64("text").alias(h1), F.xxhash64(F.lit("second"), "text").alias(h2)
    passes = []
    for k in range(blocks):
        shared = block_of(texts, k, rate, min_chars, short)
        hits = docs.select(*key, searcher(shared)("text").alias(places)).where(F.size(places) > 0).dropDuplicates([h1, h2])
        passes.append(materialize(hits, "places"))
        shared.unpersist()
    every = reduce(DataFrame.unionByName, passes).groupBy(h1, h2).agg(F.flatten(F.collect_list(places)).alias(places))
    joined = docs.select(*kept, *key).join(every, [h1, h2], "left")
    none = F.array().cast(FOUND)
    return joined.select(*kept, best_of_each(F.coalesce(F.col(places), none)).alias("found"))


def block_of(texts: DataFrame, k: int, rate: float, min_chars: int, short: bool):
    """The items of a block, as a broadcast."""
    rows = [(r["item_id"], r["text"]) for r in texts.where(F.col("_block") == k).select("item_id", "text").toLocalIterator()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    long = {key: t for key, (_, raw) in enumerate(rows) if (t := stretches_of(raw, min_chars))}
    words = {key: t for key, (_, raw) in enumerate(rows) if key not in long and (t := normal(raw))} if short else {}
    ids = {key: item for key, (item, _) in enumerate(rows)}
    return texts.sparkSession.sparkContext.broadcast(Items(long, words, rate, ids))


def best_of_each(found: Column) -> Column:
    """One place for each item, as a single block of items would give it."""
    ranked = F.sort_array(F.transform(found, lambda f: F.struct(f["item_id"].alias("item_id"), (-f["letters"]).alias("less"), f["distance"], f["start"], f["end"])))
    firsts = F.filter(ranked, lambda f, i: (i == 0) | ~F.get(ranked, i - 1)["item_id"].eqNullSafe(f["item_id"]))
    return F.transform(firsts, lambda f: F.struct(f["item_id"], f["distance"], f["start"], f["end"], -f["less"])).cast(FOUND)


def searcher(shared):
    place = T.StructType.fromDDL(PLACE)

    @F.pandas_udf(T.ArrayType(place))
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = shared.value
        for texts in batches:
            yield pd.Series([[dict(zip(place.names, f)) for f in items.search(t)] for t in texts], dtype=object)

    return search


def decontaminate(docs: DataFrame, items: DataFrame, short: bool = False, **options) -> DataFrame:
    """The rows of `docs` whose text holds no item of the benchmark, with or without id, with their columns.

    A text is not dropped for an item of a word or two (see `find_items`), unless `short` is set.
    """
    (before,) = unused(docs, "_found_before")
    hidden = docs.withColumnRenamed("found", before) if "found" in docs.columns else docs
    clean = find_items(hidden, items, unnamed=True, short=short, **options).where(F.size("found") == 0).drop("found")
    return clean.withColumnRenamed(before, "found") if "found" in docs.columns else clean
