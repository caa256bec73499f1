"""Registered queries: phrases by parts of speech, and the treebank's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.functions.treebank import treebank_tokens as words_of
from answerrec.operators import phrases
from answerrec.plans.catalogue import register
from answerrec.plans.profile_queries import STOP_SQL, STOP_WORDS
from answerrec.plans.text_queries import WORDS, documents, word_rows
from answerrec.plans.views import sql_with
from answerrec.session import materialize

PLACED = WORDS.replace("words as (select doc_id, unnest(", "words as (select doc_id, generate_subscripts(ws, 1) as place, unnest(ws) as word from (select doc_id, ").replace(") as word from documents)", " as ws from documents))")
LEXICON = """
vocabulary as materialized (select distinct word from words),
lexicon as (select word, case when substr(md5(word), 2, 1) < '6' then 'NOUN' when substr(md5(word), 2, 1) < 'b' then 'ADJ' else 'VERB' end as pos
            from vocabulary where left(md5(word), 1) < '8')"""
GUESSED = """
sizes as (select unnest([1, 2, 3, 4]) as size),
best as (select size, ending, arg_min(pos, (-n, pos)) as guess from (
  select size, right(word, size) as ending, pos, count(*) as n from lexicon, sizes where length(word) >= size group by all) group by all),
guessed as (select word, arg_max(guess, size) as pos from (
  select v.word, b.size, b.guess from (select word from vocabulary where word not in (select word from lexicon)) v, sizes s
    join best b on b.size = s.size and length(v.word) >= s.size and right(v.word, s.size) = b.ending) group by word),
tags as materialized (select word, coalesce(l.pos, g.pos, 'NOUN') as pos from vocabulary left join lexicon l using (word) left join guessed g using (word))"""
MATCHED = f"""
lines as (select doc_id, string_agg(' ' || word || '/' || case when word in {STOP_SQL} then '-' else pos end, '' order by place) as line
          from words join tags using (word) group by doc_id),
matches as (select doc_id, unnest(regexp_extract_all(line, '( [^ /]+/ADJ)*( [^ /]+/NOUN)+')) as m from lines),
terms as (select doc_id, trim(regexp_replace(m, '/[A-Z]+', '', 'g')) as term from matches),
counted as (select doc_id, term, count(*) as tf from terms group by all),
frequent as (select term, count(*) as df from counted group by term having count(*) >= 2)"""


def hashed_lexicon(words: DataFrame) -> DataFrame:
    """About half of the distinct words `(term)`, with tags by their md5."""
    digit = lambda i: F.substring(F.md5("term"), i, 1)
    pos = F.when(digit(2) < "6", "NOUN").when(digit(2) < "b", "ADJ").otherwise("VERB")
    return words.where(digit(1) < "8").select(F.col("term").alias("token"), pos.alias("pos"))


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words `(term)` of all texts, written once."""
    return materialize(word_rows(spark, sf_dir).select(F.col("word").alias("term")).distinct(), "distinct-words")


@register(sql_with(PLACED, LEXICON, GUESSED, select="select word as term, pos from tags"))
def guessed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = distinct_words(spark, sf_dir)
    return phrases.guessed_tags(words, hashed_lexicon(words))


@register(sql_with(PLACED, LEXICON, GUESSED, MATCHED, select="select doc_id, term, tf, df from counted join frequent using (term)"))
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of adjectives and nouns that stand in two documents or more."""
    lexicon = hashed_lexicon(distinct_words(spark, sf_dir))
    return phrases.noun_phrases(documents(spark, sf_dir), "doc_id", "text", lexicon, "<ADJ>*<NOUN>+", 2, STOP_WORDS)


def rewritten(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, into in rules:
        text = f"regexp_replace({text}, '{pattern}', '{into}', 'g')"
    return text


# the rules once more, as DuckDB writes them
SENTENCES_SQL = rewritten("text", [
    (r"[ \t\n\x0B\f\r]+", " "), ("^ | $", ""),
    *[(r"(^|[^\p{L}\p{N}_])(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\.g|i\.e|cf|al|Inc|Ltd|Co|Corp|No|Fig|fig|Vol|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|approx|resp|[A-Z])\.", "\\1\\2\ue000")] * 2,
    (r"([.?!][\"'')\]]*) ([\"''(\[]*[A-Z0-9])", "\\1\ue001\\2"), ("\ue000", "."),
])
WORDS_SQL = rewritten("' ' || " + rewritten("s", [
    ('^"', "`` "), ("(``)", r" \1 "), (r"([ (\[{<])(\"|'')", r"\1 `` "),
    (r"([:,])([^0-9])", r" \1 \2"), ("([:,])$", r" \1 "), (r"\.\.\.", " ... "), ("([;@#$%&])", r" \1 "),
    (r"([^.])(\.)([\])}>\"'']*)\s*$", r"\1 \2\3 "), ("([?!])", r" \1 "), ("([^''])'' ", r"\1 '' "), (r"([\]\[(){}<>])", r" \1 "), ("--", " -- "),
]) + " || ' '", [
    ('"', " '''' "), (r"(\S)('''')", r"\1 \2 "), (r"([^'' ])(''[sS]|''[mM]|''[dD]|'') ", r"\1 \2 "),
    (r"([^'' ])(''ll|''LL|''re|''RE|''ve|''VE|n''t|N''T) ", r"\1 \2 "), (r"(?i)\b(can)(not)\b", r" \1 \2 "), (r"(?i)\b(d)(''ye)\b", r" \1 \2 "),
    (r"(?i)\b(gim)(me)\b", r" \1 \2 "), (r"(?i)\b(gon)(na)\b", r" \1 \2 "), (r"(?i)\b(got)(ta)\b", r" \1 \2 "), (r"(?i)\b(lem)(me)\b", r" \1 \2 "),
    (r"(?i)\b(more)(''n)\b", r" \1 \2 "), (r"(?i) (''t)(is)\b", r" \1 \2 "), (r"(?i) (''t)(was)\b", r" \1 \2 "), (r"(?i)\b(wan)(na) ", r" \1 \2 "),
])


@register(f"""
with cut as (select doc_id, unnest(string_split({SENTENCES_SQL}, '\ue001')) as s, generate_subscripts(string_split({SENTENCES_SQL}, '\ue001'), 1) as place from documents),
words as (select doc_id, place, list_filter(string_split_regex({WORDS_SQL}, '\\s+'), lambda w: w <> '') as ws from cut)
select doc_id, cast(sum(len(ws)) as integer) as n_words, md5(string_agg(array_to_string(ws, ' '), ' ' order by place) filter (where len(ws) > 0)) as digest
from words group by doc_id""")
def treebank_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the treebank's words of every document."""
    words = documents(spark, sf_dir).select("doc_id", words_of(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))
