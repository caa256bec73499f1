"""Sentences, and words by the rules of the Penn Treebank, as column expressions.

The rules are applied one after the other, each to the whole sentence; blanks end a word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations that end in a stop without ending a sentence
ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "e.g", "i.e", "cf", "al", "Inc", "Ltd", "Co", "Corp", "No", "Fig", "fig", "Vol",
    "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "approx", "resp",
]
KEPT_STOP, BREAK = "\ue000", "\ue001"  # private letters: the stop of an abbreviation, and the end of a sentence
BLANK = r"[ \t\n\x0B\f\r]+"

# fixed values: the rewriting rules of the treebank, in their order
OPENING = [
    ('^"', "`` "),
    ("(``)", " $1 "),
    (r"""([ (\[{<])("|'')""", "$1 `` "),
]
MARKS = [
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", " $1 "),
    (r"""([^.])(\.)([\])}>"']*)\s*$""", "$1 $2$3 "),
    (r"([?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
]
CLOSING = [
    ('"', " '' "),
    (r"(\S)('')", "$1 $2 "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
]
CONTRACTIONS = [
    (r"(?i)\b(can)(not)\b", " $1 $2 "),
    (r"(?i)\b(d)('ye)\b", " $1 $2 "),
    (r"(?i)\b(gim)(me)\b", " $1 $2 "),
    (r"(?i)\b(gon)(na)\b", " $1 $2 "),
    (r"(?i)\b(got)(ta)\b", " $1 $2 "),
    (r"(?i)\b(lem)(me)\b", " $1 $2 "),
    (r"(?i)\b(more)('n)\b", " $1 $2 "),
    (r"(?i) ('t)(is)\b", " $1 $2 "),
    (r"(?i) ('t)(was)\b", " $1 $2 "),
    (r"(?i)\b(wan)(na) ", " $1 $2 "),
]


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, into in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(into))
    return text


def sentences(text: Column) -> Column:
    """The sentences of a text: a stop, question or exclamation mark, closing marks, white space,
    then a capital or a digit, with opening marks or without. Stops of abbreviations and initials
    do not count; all white space is one blank."""
    text = F.trim(F.regexp_replace(text, F.lit(BLANK), F.lit(" ")))
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    for _ in range(2):  # the second time for initials that follow each other without a blank
        text = F.regexp_replace(text, F.lit(rf"(^|[^\p{{L}}\p{{N}}_])({names}|[A-Z])\."), F.lit("$1$2" + KEPT_STOP))
    text = F.regexp_replace(text, F.lit(r"""([.?!]["')\]]*) (["'(\[]*[A-Z0-9])"""), F.lit(f"$1{BREAK}$2"))
    return F.split(F.translate(text, KEPT_STOP, "."), BREAK, -1)


def sentence_words(sentence: Column) -> Column:
    """The treebank's words of one sentence."""
    rewritten = _apply(_apply(sentence, OPENING), MARKS)
    rewritten = F.concat(F.lit(" "), rewritten, F.lit(" "))
    rewritten = _apply(_apply(rewritten, CLOSING), CONTRACTIONS)
    return F.filter(F.split(rewritten, r"\s+", -1), lambda w: w != "")


def treebank_tokens(text: Column) -> Column:
    """The words of a text, sentence by sentence; null for null, none for a blank text."""
    return F.flatten(F.transform(sentences(text), sentence_words))
