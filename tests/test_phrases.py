"""Phrases by tag patterns, guessed tags, sentences and the treebank's words."""

import pytest
from pyspark.sql import functions as F

from answerrec.errors import KeywordExtractorError
from answerrec.functions.treebank import sentences, treebank_tokens
from answerrec.operators.phrases import guessed_tags, noun_phrases, phrase_pattern

LEXICON = [("red", "ADJ"), ("old", "ADJ"), ("car", "NOUN"), ("door", "NOUN"), ("runs", "VERB"), ("sees", "VERB"), ("walking", "VERB"), ("talking", "VERB"), ("king", "NOUN"), ("the", "DET")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "token string, pos string")


def phrases(spark, lexicon, text, **options):
    docs = spark.createDataFrame([(1, text)], "id long, t string")
    return {(r.term, r.tf) for r in noun_phrases(docs, "id", "t", lexicon, **options).collect()}


def test_phrases_match_the_pattern(spark, lexicon):
    text = "The red old car door runs, the king sees red. Old king!"
    assert phrases(spark, lexicon, text, pattern="<A.*>*<N.*>+") == {("red old car door", 1), ("king", 1), ("red old king", 1)}
    assert phrases(spark, lexicon, text, pattern="<N.*>") == {("car", 1), ("door", 1), ("king", 2)}
    assert phrases(spark, lexicon, text, pattern="<ADJ>{2}") == {("red old", 2)}
    assert phrases(spark, lexicon, text, pattern="(<ADJ>|<DET>)+ <NOUN>") == {("the red old car", 1), ("the king", 1), ("red old king", 1)}
    assert phrases(spark, lexicon, text, pattern="<N.*>+", stop_words=["door"]) == {("car", 1), ("king", 2)}
    assert phrases(spark, lexicon, "car " * 30_000, pattern="<A.*>*<N.*>+") == {(" ".join(["car"] * 30_000), 1)}
    docs = spark.createDataFrame([(1, "red car"), (2, "car"), (3, None), (4, "")], "id long, t string")
    assert {(r.id, r.term, r.df) for r in noun_phrases(docs, "id", "t", lexicon, "<N.*>", min_df=2).collect()} == {(1, "car", 2), (2, "car", 2)}
    for bad in ("<N", "N", "(<N>", "<N>)", "<N>{x}"):
        with pytest.raises(KeywordExtractorError):
            phrase_pattern(bad, ["NOUN"])


def test_unknown_words_are_tagged_by_their_ending(spark, lexicon):
    words = spark.createDataFrame([(w,) for w in ["barking", "ring", "sked", "car", "xyzq", "moor", "barking"]], "term string")
    found = {r.term: r.pos for r in guessed_tags(words, lexicon).collect()}
    assert found == {"barking": "VERB", "ring": "VERB", "sked": "ADJ", "car": "NOUN", "xyzq": "NOUN", "moor": "NOUN"}


def test_sentences(spark):
    text = 'Dr. Who met J. Smith at 3 p.m. today. "Really?" He left (quickly!) Now... 5 more. e.g. This. FÜR. The U.S. Army.'
    row = spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t")).alias("s")).first()
    assert row.s == ["Dr. Who met J. Smith at 3 p.m. today.", '"Really?"', "He left (quickly!)", "Now...", "5 more. e.g. This.", "FÜR.", "The U.S. Army."]


CASES = {
    "Good muffins cost $3.88 in New York.  Please buy me two of them. Thanks.": "Good muffins cost $ 3.88 in New York . Please buy me two of them . Thanks .",
    "They'll save and invest more.": "They 'll save and invest more .",
    "hi, my name can't hello,": "hi , my name ca n't hello ,",
    "\"We beat some pretty good teams to get here,\" Slocum said.": "`` We beat some pretty good teams to get here , '' Slocum said .",
    "I cannot cannot work under these conditions!": "I can not can not work under these conditions !",
    "The company spent 40.75% of its income last year.": "The company spent 40.75 % of its income last year .",
    "He arrived at 3:00 pm.": "He arrived at 3:00 pm .",
    "I bought these items: books, pencils, and pens.": "I bought these items : books , pencils , and pens .",
    "Though there were 150, 100 of them were old.": "Though there were 150 , 100 of them were old .",
    "There were 300,000, but that wasn't enough.": "There were 300,000 , but that was n't enough .",
    "It's more'n enough.": "It 's more 'n enough .",
    "Is this (really) so -- or not...": "Is this ( really ) so -- or not ...",
    "'Tis a dog's life; I'm gonna go, gimme that & this @home": "'T is a dog 's life ; I 'm gon na go , gim me that & this @ home",
    "": "",
}


@pytest.mark.parametrize("text", CASES)
def test_published_cases(spark, text):
    row = spark.createDataFrame([(text,), (None,)], "t string").select(treebank_tokens(F.col("t")).alias("w")).collect()
    assert " ".join(row[0].w) == CASES[text] and row[1].w is None


def test_words_and_lexicon_are_computed_once(spark):
    words = spark.createDataFrame([("walking",), ("talking",), ("blue",), ("blue",)], "w string").select(F.lower("w").alias("term"))
    tags = guessed_tags(words, words.where("term = 'walking'").select(F.col("term").alias("token"), F.lit("VERB").alias("pos")))
    assert sorted(tuple(r) for r in tags.select("term", "pos").collect()) == [("blue", "NOUN"), ("talking", "VERB"), ("walking", "VERB")]
    assert "lower(" not in tags._jdf.queryExecution().executedPlan().toString()
