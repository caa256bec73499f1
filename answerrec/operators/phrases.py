"""Candidate phrases by patterns over parts of speech, and tags for words a lexicon does not know."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerrec.errors import KeywordExtractorError, need_columns
from answerrec.functions.text import clean_text, stop_list, tokens
from answerrec.operators.skew import attach_stored
from answerrec.session import materialize, spread

ELEMENT = re.compile(r"<([^<>\s/]+)>([*+?]|\{\d+(?:,\d*)?\})?|([()|])([*+?])?")
SUFFIXES = (4, 3, 2, 1)
DEFAULT_TAG = "NOUN"
FIRST_LETTER, MOST_TAGS = 0xE000, 1_000


def phrase_pattern(pattern: str, tags: Sequence[str]) -> re.Pattern[str]:
    """A pattern of tags such as `<J.*>*<N.*>+` as a pattern over one letter per word.

    An element in angle brackets is a pattern of one tag; elements may be repeated, grouped
    and joined by `|`. The letter of a tag is its place in `tags`, from the private letters.
    """
    out, at = "", 0
    pattern = "".join(pattern.split())
    try:
        while at < len(pattern):
            match = ELEMENT.match(pattern, at)
            if not match:
                raise KeywordExtractorError(f"cannot read {pattern[at:]!r} in the pattern {pattern!r}")
            tag, times, mark, group_times = match.groups()
            if tag:
                letters = "".join(letter(i) for i, t in enumerate(tags) if re.fullmatch(tag, t))
                out += (f"[{letters}]" if letters else r"(?!)") + (times or "")
            else:
                out += ("(?:" if mark == "(" else mark) + (group_times or "")
            at = match.end()
        return re.compile(out)
    except re.error as error:
        raise KeywordExtractorError(f"the pattern {pattern!r} is not one of tags") from error


def letter(place: int) -> str:
    return chr(FIRST_LETTER + place)


def guessed_tags(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`(term, pos)` of every distinct word: from the lexicon, or guessed from how words end.

    A word takes the tag that most lexicon words with its longest known ending (of at most
    four letters) have; of equally frequent tags the first in order. Words with an unknown
    last letter are nouns.
    """
    need_columns(words.columns, "term")
    need_columns(lexicon.columns, "token", "pos")
    # both are read several times, and the words of a lexicon may come from the same texts
    known = materialize(lexicon.groupBy(F.col("token").alias("term")).agg(F.min("pos").alias("pos")), "known-tags")
    distinct = materialize(words.select("term").distinct(), "distinct-words")
    endings = [F.struct(F.lit(n).alias("size"), F.right("term", F.lit(n)).alias("ending")) for n in SUFFIXES]
    long_enough = lambda e: F.length("term") >= e["size"]
    ends = lambda df: df.select("*", F.explode(F.filter(F.array(*endings), long_enough)).alias("e")).select(*df.columns, "e.*")
    counts = ends(known).groupBy("size", "ending", "pos").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("size", "ending").agg(F.min_by("pos", F.struct(-F.col("n"), F.col("pos"))).alias("guess"))
    unknown = distinct.join(known, "term", "left_anti")
    guessed = ends(unknown).join(best, ["size", "ending"]).groupBy("term").agg(F.max_by("guess", "size").alias("pos"))
    every = distinct.join(known.unionByName(guessed), "term", "left")
    return every.withColumn("pos", F.coalesce("pos", F.lit(DEFAULT_TAG)))


def noun_phrases(
    docs: DataFrame, doc: str, text: str, lexicon: DataFrame, pattern: str = "<J.*>*<N.*>+", min_df: int = 1, stop_words: str | Sequence[str] = ()
) -> DataFrame:
    """Rows `(doc, term, tf, df)`: the phrases of each text whose tags match the pattern.

    Matches go from left to right, repeat as often as they can and do not overlap; stop words
    end a phrase. A word is tagged once, wherever it stands; only ids, places and words are
    shuffled, and the tags of frequent words are broadcast.
    """
    need_columns(docs.columns, doc, text)
    phrase_pattern(pattern, [DEFAULT_TAG])  # a broken pattern is told before any work
    words = tokens(clean_text(F.col(text)))
    placed = spread(docs.select(doc, text)).select(doc, F.posexplode_outer(words).alias("at", "term")).where("term is not null")
    placed = materialize(placed, "words")
    uses = materialize(placed.groupBy("term").agg(F.count(F.lit(1)).alias("uses")), "word-uses")
    known = materialize(guessed_tags(uses, lexicon).join(uses, "term"), "tags")
    tags = sorted(r.pos for r in known.select("pos").distinct().limit(MOST_TAGS + 1).collect())
    if len(tags) > MOST_TAGS:
        raise KeywordExtractorError(f"more than {MOST_TAGS} different tags")
    found = phrase_pattern(pattern, tags)
    letters = F.lit("-")
    for i, tag in enumerate(tags):
        letters = F.when(F.col("pos") == tag, F.lit(letter(i))).otherwise(letters)
    letters = F.when(F.col("term").isin(*stop_list(stop_words)), F.lit("-")).otherwise(letters) if stop_words else letters
    tagged = attach_stored(placed, known, "term", size="uses").select(doc, F.struct("at", "term", letters.alias("letter")).alias("w"))
    lines = tagged.groupBy(doc).agg(F.array_sort(F.collect_list("w")).alias("w"))

    @F.arrow_udf("array<string>")
    def matched(words: pa.Array, line: pa.Array) -> pa.Array:
        every = words.flatten().to_numpy(zero_copy_only=False)  # the words of all texts, one after another
        out, first = [], 0
        for marks in line.to_pylist():
            spans = [(first + m.start(), first + m.end()) for m in found.finditer(marks) if m.end() > m.start()]
            out.append([" ".join(every[start:end]) for start, end in spans])
            first += len(marks)
        return pa.array(out, pa.list_(pa.string()))

    terms = lines.select(doc, F.explode(matched("w.term", F.array_join("w.letter", ""))).alias("term"))
    counted = materialize(terms.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf")), "phrases")
    frequent = materialize(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df), "frequent-phrases")
    return attach_stored(counted, frequent, "term", size="df")


def tag_counts(tags: DataFrame) -> DataFrame:
    """`(pos, words, share)` of a table of tagged words."""
    whole = Window.partitionBy(F.lit(0))
    counts = tags.groupBy("pos").agg(F.count(F.lit(1)).alias("words"))
    return counts.withColumn("share", F.col("words") / F.sum("words").over(whole))
