"""Cleaning strings, tokens, keywords and their errors."""

import random
import pytest
from pyspark.sql import functions as F

from answerrec.errors import InvalidTag, KeywordExtractorError
from answerrec.functions import text
from answerrec.operators.keyrank import KeywordsExtractor, candidate_terms
from answerrec.operators.profile import word_length
from answerrec.operators.tfidf import Tfidf

URLS = {
    "https://docs.example.org/guide/tagging": "",
    "https://docs.example.org/guide/tagging and some other text": " and some other text",
    "and some other text https://docs.example.org/guide/tagging": "and some other text ",
    "126584": "",
    "56985 and some other55 text": " and some other text",
    "a5nd some other55 text6666": "and some other text",
    "http://a.b/c-d?x=1 ok": "-d?x= ok",
    "٣ apples": " apples",
}


def apply(spark, function, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", function(F.col("t")).alias("r"))
    return {r.t: r.r for r in rows.collect()}


def test_urls_and_digits(spark):
    assert apply(spark, text.strip_urls_and_digits, URLS) == URLS


def test_strip_html(spark):
    expected = {
        "<p>a <b>bold</b> &amp; &lt;x&gt;</p>": "a bold & <x>",
        '<script>var t="</p>";</script>x<!-- <b>no</b> -->y': "xy",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "&amp;lt;": "&lt;",
        None: None,
    }
    assert apply(spark, text.strip_html, expected) == expected


def test_entities(spark):
    given = ["caf&eacute; &#8217;&#x2019; &euro;&nbsp;5 &rsquo;", "a&b &unknown; &#0; &#xD800; &#9999999; &", "&#146;&AMP;&ngE;", "a=1&copy=2&copy;", ""]
    wanted = ["café ’’ € 5 ’", "a&b &unknown; \ufffd \ufffd \ufffd &", "’&≧̸", "a=1&copy=2©", ""]
    assert apply(spark, text.decode_entities, given) == dict(zip(given, wanted))


def test_stop_words_of_a_language(spark):
    docs = spark.createDataFrame([(1, "The answer is not in the question about Spark")], "id long, t string")
    kept = candidate_terms(docs, "id", "t", stop_words="english").select("term").collect()
    assert {r.term for r in kept} == {"answer", "question", "spark"}
    counted = Tfidf(stem="none", stop_words="english").term_counts(docs, "id", "t").select("term").collect()
    assert {r.term for r in counted} == {"answer", "question", "spark"}


def test_accents_of_other_scripts(spark):
    assert apply(spark, text.fold_accents, ["ёлка άλφα été"]) == {"ёлка άλφα été": "елка αλφα ete"}


def test_cleaning_order_matters(spark):
    assert apply(spark, text.clean_text, ["<h1>T</h1>&#39;"]) == {"<h1>T</h1>&#39;": "T&#;"}


def test_tokens_and_ngrams(spark):
    found = apply(spark, text.tokens, ["Été à la Plage, x2 ß foo_bar"])
    assert list(found.values()) == [["ete", "la", "plage", "x2", "foo_bar"]]
    grams = apply(spark, lambda t: text.ngrams(text.tokens(t), 1, 2), ["one two three", "one"])
    assert grams["one two three"] == ["one", "two", "three", "one two", "two three"]
    assert grams["one"] == ["one"]


def test_word_length(spark):
    rows = apply(spark, lambda t: F.array(word_length(t), word_length(t, empty_as_zero=True)), ["", "a  b", "a"])
    assert rows == {"": [1, 0], "a  b": [3, 3], "a": [1, 1]}


DOCS = [(1, "spark joins tables and spark sorts tables"), (2, "pandas sorts frames"), (3, "")]


@pytest.mark.parametrize("top_n", [1, 2, 5])
def test_keyword_arrays(spark, top_n):
    docs = spark.createDataFrame(DOCS, "id long, t string")
    model = KeywordsExtractor("tfidf", stem="none", stop_words=["and"], top_n=top_n).fit(docs, "id", "t")
    rows = {r.id: r for r in model.transform(docs, "id", "t").collect()}
    assert len(rows) == 3 and rows[3].keywords is None and rows[3].tag1 is None
    assert len(rows[1].keywords) == min(top_n, 4)
    assert rows[1].keywords[:2] == ["spark", "tables"][:top_n]
    assert rows[1].tag1 == "spark"


def test_extractor_errors(spark):
    docs = spark.createDataFrame(DOCS, "id long, t string")
    with pytest.raises(KeywordExtractorError):
        KeywordsExtractor("tfidf").transform(docs, "id", "t")
    with pytest.raises(KeywordExtractorError):
        KeywordsExtractor("keybert").transform(docs, "id", "t")
    with pytest.raises(InvalidTag):
        KeywordsExtractor("cnn")
    with pytest.raises(InvalidTag):
        Tfidf(stem="cnn")
    with pytest.raises(KeywordExtractorError):
        Tfidf(stem="lemmatizer")


def test_vector_extractor_with_all_choices(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd")], "id long, t string")
    doc_vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    term_vectors = spark.createDataFrame(
        [("aa", [1.0, 0.0]), ("bb", [0.99, 0.01]), ("cc", [0.8, 0.6]), ("dd", [0.0, 1.0])], "term string, vector array<double>"
    )

    def keywords(**options):
        extractor = KeywordsExtractor("keybert", dim=2, top_n=2, **options)
        return extractor.transform(docs, "id", "t", doc_vectors=doc_vectors, term_vectors=term_vectors).first().keywords

    assert keywords() == ["aa", "bb"]
    assert keywords(use_mmr=True, diversity=0.9) == ["aa", "dd"]
    assert keywords(use_maxsum=True, nr_candidates=3) == ["aa", "cc"]
    assert keywords(use_maxsum=True, nr_candidates=4) == ["aa", "dd"]


def test_candidate_filters(spark):
    docs = spark.createDataFrame([(1, "red cat"), (2, "red dog")], "id long, t string")
    only = lambda **o: {(r.id, r.term) for r in candidate_terms(docs, "id", "t", **o).collect()}
    assert only(min_df=2) == {(1, "red"), (2, "red")}
    assert only(allowed=spark.createDataFrame([("cat",)], "term string")) == {(1, "cat")}
    nouns = spark.createDataFrame([("dog", "NOUN"), ("red", "ADJ")], "token string, pos string")
    assert only(nouns=nouns) == {(2, "dog")}


def test_unseen_documents_use_fitted_frequencies(spark):
    docs = spark.createDataFrame(DOCS, "id long, t string")
    model = Tfidf(stem="none", norm=None).fit(docs, "id", "t")
    new = spark.createDataFrame([(9, "spark unknown sorts")], "id long, t string")
    found = {r.term: r.weight for r in model.weights(new, "id", "t").collect()}
    known = {r.term: r.idf for r in model.terms.collect()}
    assert found == {"spark": pytest.approx(known["spark"]), "sorts": pytest.approx(known["sorts"])}


def test_weights_follow_the_text_column(spark):
    docs = spark.createDataFrame([(1, "aa bb", "bb cc")], "id long, t string, other string")
    model = Tfidf(stem="none").fit(docs, "id", "t")
    assert {r.term for r in model.weights(docs, "id", "t").collect()} == {"aa", "bb"}
    assert {r.term for r in model.weights(docs, "id", "other").collect()} == {"bb"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_their_text_is(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (1, "blue green"), (None, "red"), (2, None)], "id long, t string")
    counts = Tfidf(stem="none").term_counts(docs, "id", "t")
    assert {(r.id, r.term): r.tf for r in counts.collect()} == {(1, "red"): 2, (1, "blue"): 2, (1, "green"): 1, (None, "red"): 1}
    exchanges = [line for line in plan_of(counts).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("term" not in line for line in exchanges)


def test_only_terms_near_the_top_are_shuffled(spark):
    rng = random.Random(7)
    words = ["word" + a + b for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(i // 2 if i else None, " ".join(rng.choices(words, k=60))) for i in range(40)]
    for norm in ("l2", "l1", None):
        model = Tfidf(stem="none", norm=norm, top_n=3).fit(spark.createDataFrame(rows, "id long, t string"), "id", "t")
        expected = {}
        for r in model.fitted_weights().collect():
            expected.setdefault(r.id, []).append((-r.weight, r.term))
        top = model.fitted_top_terms()
        found = {}
        for r in top.collect():
            found.setdefault(r.id, {})[r["rank"]] = r.term
        assert {k: [v[i] for i in sorted(v)] for k, v in found.items()} == {k: [t for _, t in sorted((round(w, 12), t) for w, t in v)[:3]] for k, v in expected.items()}
        assert plan_of(top).count("WindowGroupLimit") >= 3  # one of them before the shuffle
