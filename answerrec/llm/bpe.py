"""BPE by speculation: longest matches are proposed, adjacent pairs verified, failures merged exactly.

A sequence of tokens is what the merges give if and only if each two neighbours stay apart
when merged on their own. So a proposal needs only a check of its pairs, and that runs over
all pairs of a batch at once. Words whose proposal fails are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerrec.llm.base import byte_slices, unused
from answerrec.llm.grams import runs

CACHED = 300_000  # words and stretches whose ids a worker remembers, some 70 MB
SEGMENT = 2**20  # letters of a text that are split at once
_loaded: dict[bytes, "Vocabulary"] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


# Letters and lower-case forms that the library knows and Python's tables do not yet have.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{0x10D50 + i: 0x10D70 + i for i in range(22)},
    **{0x16EA0 + i: 0x16EBB + i for i in range(25)},
}
LOWER_FIRST = {**NEWER_LOWER, ord("Σ"): ord("σ")}  # the library lowers letter by letter, without a final sigma


def char_class(group: str) -> str:
    """The characters of a Unicode category group as ranges of a pattern.

    They come from Python's own tables, whose version is closest to that of the library.
    """
    member = np.array([unicodedata.category(chr(c))[0] == group for c in range(sys.maxunicode + 1)])
    for first, last in {"L": NEWER_LETTERS, "N": NEWER_DIGITS}.get(group, []):
        member[first : last + 1] = True
    starts, ends = runs(member)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(starts, ends))


class Vocabulary:
    """A word-level BPE file of the tokenizers library: lower case, white space dropped, word ends marked."""

    def __init__(self, text: bytes):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = np.array([""] * size, object)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in self.ids.items() if t.endswith(self.end)}
        self.longest = max(map(len, self.inner))
        self.letters = dict(enumerate(byte_letters()))
        letters, digits, spaces = char_class("L"), char_class("N"), r"\t-\r\x85" + char_class("Z")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = re.compile(split.replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{digits}]").replace("[^\\s\\p{L}\\p{N}]", f"[^{spaces}{letters}{digits}]"))
        self.spaces = re.compile(f"[{spaces}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.inner_ids = np.array([self.inner[self.letters[b]] for b in range(256)])
        self.final_ids = np.array([self.final[self.letters[b]] for b in range(256)])
        self.load_merges(model["merges"], size)
        self.cache: dict[str, bytes] = {}
        self.merged = 0  # words whose proposal failed

    def load_merges(self, merges: list[list[str]], size: int) -> None:
        """Ranks by pair, and how each token was made: `made` is its rank, -1 if it is a letter."""
        self.never = int(np.iinfo(np.int64).max)
        self.size = size
        self.rank_of: dict[int, int] = {}
        self.whole: list[int] = []
        self.left, self.right, self.made = (np.full(size, -1, np.int64) for _ in range(3))
        self.exact = True  # each token is made in one way, and after its parts
        for rank, (a, b) in enumerate(merges):
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank_of.setdefault(left * size + right, rank)
            self.whole.append(whole)
            self.exact &= self.made[whole] < 0 and rank > max(self.made[left], self.made[right])
            self.left[whole], self.right[whole], self.made[whole] = left, right, rank
        pairs = np.array([*self.rank_of], np.int64)
        self.wholes = np.array(self.whole, np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.pair_ranks = np.array([*self.rank_of.values()], np.int64)[order]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each two tokens; the largest integer if they never merge."""
        keys = a * self.size + b  # a part that is not there, -1, makes no key that exists
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.never)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the border between each two tokens alone.

        Walk back in time: undo, of the two tokens at the border, the one made later. What
        then stands at the border was there until that rank; a merge across the border with
        a smaller rank would have come first. Of equal ranks the one further left comes first,
        so a merge across loses to the left token's and wins over the right token's.
        """
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until = np.full(len(a), self.never, np.int64)  # a merge across needs a rank below this
        while len(live):
            broken = self.pair_rank(a, b) < until
            fine[live[broken]] = False
            made_a, made_b = self.made[a], self.made[b]
            more = ~broken & (np.maximum(made_a, made_b) >= 0)
            live, a, b, made_a, made_b = live[more], a[more], b[more], made_a[more], made_b[more]
            undo_b = made_b >= made_a
            until = np.where(undo_b, made_b + 1, made_a)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
        return fine

    def propose(self, word: str) -> list[int]:
        """The longest token from each place on."""
        found, at, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while at < n:
            whole = final.get(word[at:])
            if whole is not None:
                found.append(whole)
                break
            end = min(n - 1, at + longest)
            while (token := inner.get(word[at:end])) is None:
                end -= 1
            found.append(token)
            at = end
        return found

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The merges one by one, in all words at once: the smallest rank first, of equal ones the leftmost."""
        out: list[list[int]] = [[] for _ in words]
        lengths = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 16), (16, 32)):
            chosen = np.flatnonzero((lengths > low) & (lengths <= high))
            for start in range(0, len(chosen), 8192):
                some = chosen[start : start + 8192]
                for i, ids in zip(some, self.merge_rows([words[i] for i in some], lengths[some], high)):
                    out[i] = ids
        for i in np.flatnonzero(lengths > 32):
            out[i] = self.merge_long([*self.inner_ids[list(words[i][:-1])].tolist(), int(self.final_ids[words[i][-1]])])
        return out

    def merge_rows(self, words: list[bytes], lengths: np.ndarray, width: int) -> list[list[int]]:
        rows = len(words)
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(rows, width)
        columns = np.arange(width)
        parts = np.where(columns < lengths[:, None], self.inner_ids[letters], -1)
        parts[np.arange(rows), lengths - 1] = self.final_ids[letters[np.arange(rows), lengths - 1]]
        ranks = np.full((rows, width), self.never)
        ranks[:, :-1] = np.where(parts[:, 1:] >= 0, self.pair_rank(parts[:, :-1], parts[:, 1:]), self.never)
        live = np.arange(rows)
        done: list[list[int]] = [[] for _ in words]
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            best = ranks[row, at]
            over = best == self.never
            if over.any():
                for i, ids, n in zip(live[over], parts[over].tolist(), (parts[over] >= 0).sum(axis=1)):
                    done[i] = ids[:n]
                live, parts, ranks, at, best = live[~over], parts[~over], ranks[~over], at[~over], best[~over]
                row = np.arange(len(live))
                if not len(live):
                    break
            parts = np.take_along_axis(parts, np.minimum(columns + (columns > at[:, None]), width - 1), axis=1)
            parts[:, -1] = -1  # a row with a merge has one part less
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
            ranks[:, -1] = self.never
            parts[row, at] = self.wholes[best]
            for i in (at - 1, at):
                some = np.flatnonzero((i >= 0) & (i < width - 1))
                left, right = parts[some, i[some]], parts[some, i[some] + 1]
                ranks[some, i[some]] = np.where(right >= 0, self.pair_rank(left, right), self.never)
        return done

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs, for words of many letters."""
        n, size = len(parts), self.size
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.rank_of[a * size + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a * size + b in self.rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.whole[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0:
                    a, b = parts[x], parts[after[x]]
                    if (rank := self.rank_of.get(a * size + b)) is not None:
                        heapq.heappush(heap, (rank, x, a, b))
        return [p for p in parts if p >= 0]

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """The ids of words that are in no cache."""
        spelled = [w.encode() for w in words]
        found = [self.propose(s.decode("latin-1").translate(self.letters)) for s in spelled] if self.exact else [[] for _ in spelled]
        lengths = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(found)), lengths)
        inside = owner[1:] == owner[:-1]
        pairs, where = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        bad = lengths == 0
        bad[owner[1:][inside][~self.compatible(pairs // self.size, pairs % self.size)[where]]] = True
        failed = np.flatnonzero(bad)
        self.merged += len(failed)
        for i, ids in zip(failed, self.merge([spelled[i] for i in failed])):
            found[i] = ids
        return found

    def parts(self, chunk: str) -> list[str]:
        """The words of a stretch without white space; the usual shapes need no pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    def learn(self, chunks: list[str]) -> None:
        """Remember the packed ids of stretches without white space, and of their words."""
        split = [self.parts(c) for c in chunks]
        cache = self.cache
        words = list({w for part in split for w in part} - cache.keys())
        for word, ids in zip(words, self.ids_of(words)):
            cache[word] = struct.pack(f"<{len(ids)}I", *ids)
        for chunk, part in zip(chunks, split):
            if len(part) != 1 or part[0] != chunk:
                cache[chunk] = b"".join([cache[w] for w in part])

    def normal(self, text: str) -> list[str]:
        """The normalised text, cut at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).translate(LOWER_FIRST)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for Python alone
            return self.spaces.sub(" ", text).lower().split(" ")
        return text.lower().split()

    def chunks(self, text: str) -> list[str]:
        """What is encoded piece by piece; a special token is a piece that begins with a zero."""
        if not any(token in text for token in self.special):
            return self.normal(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            out += ["\0\0" + part] if i % 2 else self.normal(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text: little-endian unsigned 32-bit integers.

        What is remembered beyond CACHED entries is forgotten before the next stretch of texts;
        very long texts are taken in segments.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in segments(text):
                held.append((i, part))
                size += len(part)
                if size >= SEGMENT:
                    self.encode_parts(held, out)
                    held, size = [], 0
        self.encode_parts(held, out)
        return [b"".join(x) for x in out]

    def encode_parts(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        split = [self.chunks(part) for _, part in parts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        for token, i in self.special.items():
            self.cache["\0\0" + token] = np.array([i], "<u4").tobytes()
        new: set[str] = set()
        for part in split:
            new.update(part)
        self.learn(list(new - self.cache.keys()))
        get = self.cache.__getitem__
        for (i, _), part in zip(parts, split):
            out[i].append(b"".join(map(get, part)))

    def decode(self, packed: bytes) -> str:
        """The tokens joined by spaces, as the library does for a file without a decoder."""
        return " ".join(self.tokens[np.frombuffer(packed, "<u4")].tolist())


def segments(text: str) -> Iterator[str]:
    """A text cut at blanks after every SEGMENT letters; no word or special token spans one."""
    start = 0
    while len(text) - start > SEGMENT and (cut := text.find(" ", start + SEGMENT)) >= 0:
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def vocabulary(text: bytes) -> Vocabulary:
    """One vocabulary per Python worker."""
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Vocabulary(text)
    return _loaded[text]


def by_texts(docs: DataFrame, path: str, schema: pa.DataType, returns: str, work: Callable[[Vocabulary, list[str]], list[dict]]) -> Column:
    """The column `text` through `work`, some megabytes of texts at a time."""
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(shared.value)
        for batch in batches:
            parts = []
            for some in byte_slices(pa.RecordBatch.from_arrays([batch], names=["text"])):
                parts.append(pa.array(work(words, [t or "" for t in some.column(0).to_pylist()]), schema))
            yield pa.concat_arrays(parts) if parts else pa.array([], schema)

    return run("text")


def encode_texts(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """Adds `ids` (binary: token ids as little-endian unsigned 32-bit integers) and `n_tokens`.

    The ids are those of the tokenizers library with the vocabulary file at `path` on the
    driver and without added special tokens; special tokens written in a text are found. With
    `decode`, the ids are decoded again by the same worker, into `decoded`. A null text counts
    as empty and gives no ids. Repeated rows give repeated results, an empty table an empty
    one. Columns of these names are replaced, others stay. Whole texts are encoded, some
    megabytes at a time, and nothing is shuffled. The vocabulary travels once, as a broadcast
    of the size of its file.
    """
    schema = pa.struct([("ids", pa.binary()), *[("decoded", pa.string())] * decode])

    def work(words: Vocabulary, texts: list[str]) -> list[dict]:
        return [{"ids": ids, "decoded": words.decode(ids)} if decode else {"ids": ids} for ids in words.encode(texts)]

    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", *["decoded"] * decode)]
    (coded,) = unused(docs, "_c")
    new = [F.col(f"{coded}.ids").alias("ids"), (F.octet_length(f"{coded}.ids") / 4).cast("long").alias("n_tokens")]
    column = by_texts(docs, path, schema, "ids binary" + ", decoded string" * decode, work)
    return docs.select(*kept, column.alias(coded)).select(*kept, *new, *[F.col(f"{coded}.decoded").alias("decoded")] * decode)


def digest_texts(docs: DataFrame, path: str) -> DataFrame:
    """Adds `n_tokens`, `ids_sha256` and `decoded_sha256`, the digests of what `encode_texts` gives.

    Ids and decoded texts stay in the worker, so only the digests travel. Nulls, empty tables,
    repeats and columns of the same names are treated as there.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    schema = pa.struct([(names[0], pa.int64()), (names[1], pa.string()), (names[2], pa.string())])

    def work(words: Vocabulary, texts: list[str]) -> list[dict]:
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return [dict(zip(names, (len(x) // 4, digest(x), digest(words.decode(x).encode())))) for x in words.encode(texts)]

    kept = [c for c in docs.columns if c not in names]
    (coded,) = unused(docs, "_c")
    column = by_texts(docs, path, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
    return docs.select(*kept, column.alias(coded)).select(*kept, *[F.col(f"{coded}.{n}").alias(n) for n in names])


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null ids give an empty text."""
    with open(path, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(shared.value)
        for packed in batches:
            yield pa.array([words.decode(x.as_buffer()) if x.is_valid else "" for x in packed], pa.string())

    return df.withColumn(out, decode(ids))
