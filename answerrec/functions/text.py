"""Text cleaning and tokenising as column expressions (JVM side, no Python per row)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from html.entities import html5

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns that the cleaning removes or decodes
URL = r"https?://[A-Za-z0-9./]+"
DIGITS = r"\p{Nd}+"
HIDDEN = [
    r"(?s)<!--.*?-->",
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
]
# a tag ends at the first > outside of quoted attribute values
TAG = r"""(?s)</?[A-Za-z!](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>"""
TOKEN = r"[\p{L}\p{N}_]{2,}"
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# the standard's names of characters; a no-break space is a space
NAMED = {name[:-1]: text.replace("\u00a0", " ") for name, text in html5.items() if name.endswith(";")}
# numbers from 128 to 159 mean the characters of Windows-1252
CONTROLS = "".join(map(chr, range(0x80, 0xA0))) + "\u00a0"
MEANT = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)) + " "


def _accent_table() -> tuple[str, str]:
    """Letters with marks, other than capitals, and their base letters; bare marks are deleted."""
    folded = {}
    for code in range(0x00C0, 0x2000):
        base, *marks = unicodedata.normalize("NFKD", chr(code))
        if marks and base.isalpha() and not chr(code).isupper() and all(map(unicodedata.combining, marks)):
            folded[chr(code)] = base
    bare = "".join(map(chr, range(0x0300, 0x0370)))
    return "".join(folded) + bare, "".join(folded.values())


ACCENTED, PLAIN = _accent_table()


def decode_entities(text: Column) -> Column:
    """Named and numeric character references that end in a semicolon, decoded once.

    Unknown names stay; numbers that are no character become U+FFFD.
    """
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def character(name: Column) -> Column:
        digits = F.regexp_extract(name, "^#[xX](.+)", 1)
        number = F.when(digits != "", F.conv(digits, 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        numeric = F.when(valid, F.translate(point, CONTROLS, MEANT)).otherwise(F.lit("\ufffd"))
        return F.when(name.startswith("#"), numeric).otherwise(F.try_element_at(named, name))

    def piece(part: Column, at: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        rest = F.substr(part, F.length(name) + 2)
        return F.when(at == 0, part).otherwise(F.coalesce(F.concat(character(name), rest), F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(F.split(text, "&", -1), piece), "")


def strip_html(text: Column) -> Column:
    """Text nodes of a page, joined without separator; scripts, styles and comments are no
    text. Entities are decoded once, so `&amp;lt;` becomes `&lt;`."""
    for pattern in [*HIDDEN, TAG]:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(""))
    return decode_entities(text)


def stop_list(words: str | Sequence[str]) -> list[str]:
    """The words themselves, or Spark's list for a language such as "english"."""
    return StopWordsRemover.loadDefaultStopWords(words) if isinstance(words, str) else list(words)


def strip_urls_and_digits(text: Column) -> Column:
    """Remove URLs, then every run of digits of any script."""
    text = F.regexp_replace(text, F.lit(URL), F.lit(""))
    return F.regexp_replace(text, F.lit(DIGITS), F.lit(""))


def clean_text(text: Column) -> Column:
    """URLs and digits first, then tags: the order changes the result (`<h1>` → `<h>`)."""
    return strip_html(strip_urls_and_digits(text))


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def tokens(text: Column, strip_accents: bool = True) -> Column:
    """Lower-case words of at least two word characters."""
    text = F.lower(text)
    if strip_accents:
        text = fold_accents(text)
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of `low`..`high` neighbouring words, joined by a space.

    The word array is bound once: inside a lambda a plain expression would be computed
    again for every position.
    """
    if (low, high) == (1, 1):
        return words

    def runs_of(bound: Column, n: int) -> Column:
        starts = F.when(F.size(bound) >= n, F.sequence(F.lit(1), F.size(bound) - (n - 1)))
        run = F.transform(starts, lambda i: F.array_join(F.slice(bound, i, F.lit(n)), " "))
        return F.coalesce(run, F.array().cast("array<string>"))

    every = F.transform(F.array(words), lambda bound: F.concat(*[runs_of(bound, n) for n in range(low, high + 1)]))
    return F.flatten(every)
