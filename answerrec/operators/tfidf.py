"""Term weights and keywords by term frequency and inverse document frequency."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerrec.errors import KeywordExtractorError, need_columns, need_option
from answerrec.functions.stem import stem
from answerrec.functions.text import clean_text, stop_list, tokens
from answerrec.operators.prep import tag_columns
from answerrec.operators.skew import attach_stored
from answerrec.session import dealt, materialize

STEMS = ["none", "stemmer", "lemmatizer"]


def lemmas(vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add `form` to distinct terms: the lemma from a `(form, lemma)` table, else the term."""
    need_columns(lexicon.columns, "form", "lemma")
    known = lexicon.groupBy(F.col("form").alias("term")).agg(F.min("lemma").alias("_lemma"))
    return vocabulary.join(known, "term", "left").withColumn("form", F.coalesce("_lemma", "term")).drop("_lemma")


def without(words: DataFrame, stop_words: str | Sequence[str], word: str = "term") -> DataFrame:
    return words.where(~F.col(word).isin(*stop_list(stop_words))) if stop_words else words


@dataclass(frozen=True)
class Tfidf:
    """Options of the weighting; `fit` returns a model that holds document frequencies."""

    norm: str | None = "l2"
    use_idf: bool = True
    smooth_idf: bool = True
    sublinear_tf: bool = False
    top_n: int = 5
    stem: str = "stemmer"
    stop_words: str | Sequence[str] = ()  # words, or a language such as "english"
    strip_accents: bool = True
    stop_after_stem_only: bool = False
    min_df: int = 1
    lexicon: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        need_option(self.stem, STEMS)
        if self.norm not in ("l1", "l2", None):
            need_option(self.norm, ["l1", "l2"])
        if self.stem == "lemmatizer" and self.lexicon is None:
            raise KeywordExtractorError("the lemmatizer needs a lexicon of (form, lemma)")

    def term_counts(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """Rows `(doc, term, tf)` of all terms of the cleaned texts."""
        need_columns(docs.columns, doc, text)
        words = tokens(clean_text(F.col(text)), self.strip_accents)
        # explode_outer: explode would add a filter that computes all tokens a second time
        # whole texts are dealt by document, so that no row for a word is shuffled to be counted
        words = dealt(docs.select(doc, text), doc).select(doc, F.explode_outer(words).alias("term"))
        words = words.where(F.col("term").isNotNull())
        if self.stem == "none" or not self.stop_after_stem_only:
            words = without(words, self.stop_words)
        counts = words.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
        if self.stem == "none":
            return counts
        # each distinct word is normalised once, and written for the branches
        # of the join that takes it back to its documents
        counts = materialize(counts, "term-counts")
        vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_docs"))
        if self.stem == "stemmer":
            vocabulary = vocabulary.withColumn("form", stem("term"))
        else:
            vocabulary = lemmas(vocabulary, self.lexicon)
        vocabulary = without(materialize(vocabulary, "vocabulary"), self.stop_words, "form")
        formed = attach_stored(counts, vocabulary, "term", size="_docs")
        formed = dealt(formed.select(doc, F.col("form").alias("term"), "tf"), doc)
        return formed.groupBy(doc, "term").agg(F.sum("tf").alias("tf"))

    def fit(self, docs: DataFrame, doc: str, text: str) -> TfidfModel:
        counts = materialize(self.term_counts(docs, doc, text), "term-counts")
        total = docs.agg(F.count(F.lit(1))).scalar()
        terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= self.min_df)
        terms = materialize(terms.withColumn("idf", self.idf(F.col("df"), total)), "terms")
        return TfidfModel(self, terms, (docs, doc, text), counts)

    def idf(self, df: Column, total: Column) -> Column:
        if not self.use_idf:
            return F.lit(1.0)
        extra = 1 if self.smooth_idf else 0
        return F.log((total + extra) / (df + extra)) + 1


@dataclass(frozen=True)
class TfidfModel:
    """Fitted `(term, df, idf)` table; documents not seen when fitting use the same idf.

    The term counts of the fitted documents are kept, so that their texts are read once.
    """

    options: Tfidf
    terms: DataFrame
    fitted: tuple[DataFrame, str, str]
    counts: DataFrame

    def vocabulary(self) -> DataFrame:
        return self.terms.select("term").orderBy("term")

    def weights(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """Rows `(doc, term, tf, weight)`; terms outside the vocabulary are left out."""
        return self._weighted(materialize(self.options.term_counts(docs, doc, text), "term-counts"), doc)

    def fitted_weights(self) -> DataFrame:
        """The weights of the fitted documents, without reading their texts again."""
        return self._weighted(self.counts, self.fitted[1])

    def _raw(self, counts: DataFrame, doc: str) -> DataFrame:
        """Rows `(doc, term, tf, weight)` of written counts, before lengths are made equal."""
        known = attach_stored(counts, self.terms, "term", size="df")
        tf = F.log(F.col("tf")) + 1 if self.options.sublinear_tf else F.col("tf")
        return known.select(doc, "term", "tf", (tf * F.col("idf")).alias("weight"))

    def _total(self) -> Column | None:
        """Aggregate: what the length of a document's weights comes from."""
        if self.options.norm is None:
            return None
        return F.sum(F.col("weight") * F.col("weight") if self.options.norm == "l2" else F.abs("weight"))

    def _length(self, total: Column) -> Column:
        return F.sqrt(total) if self.options.norm == "l2" else total

    def _weighted(self, counts: DataFrame, doc: str) -> DataFrame:
        raw, total = self._raw(counts, doc), self._total()
        if total is None:
            return raw
        return raw.withColumn("weight", F.col("weight") / self._length(total.over(Window.partitionBy(doc))))

    def _strongest(self, counts: DataFrame, doc: str) -> DataFrame:
        """Rows `(doc, rank, term, weight)` of the strongest terms of written counts.

        Only terms near the top of their document and its length are shuffled. The division
        may make neighbouring weights equal, and then the term decides; such weights have the
        same or the next single-precision value, so one more of these values is kept.
        """
        raw, total = self._raw(counts, doc), self._total()
        falling = Window.partitionBy(doc).orderBy(F.desc(F.col("weight").cast("float")))
        near = raw.select(doc, "term", "weight", F.dense_rank().over(falling).alias("_place")).where(F.col("_place") <= self.options.top_n + 1)
        if total is not None:
            totals = raw.groupBy(F.col(doc).alias("_doc")).agg(total.alias("_total"))
            near = near.join(totals, F.col(doc).eqNullSafe(F.col("_doc"))).withColumn("weight", F.col("weight") / self._length(F.col("_total")))
        return top_per_document(near, doc, "weight", self.options.top_n)

    def top_terms(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """Rows `(doc, rank, term, weight)` of the strongest terms; ties in term order."""
        return self._strongest(materialize(self.options.term_counts(docs, doc, text), "term-counts"), doc)

    def fitted_top_terms(self) -> DataFrame:
        """`top_terms` of the fitted documents."""
        return self._strongest(self.counts, self.fitted[1])

    def keywords(self, docs: DataFrame, doc: str, text: str, order: str = "desc") -> DataFrame:
        """Every document with its keyword array and `tag1..tagN`, strongest first."""
        return keyword_table(docs, self.top_terms(docs, doc, text), doc, self.options.top_n, order)

    def fitted_keywords(self, order: str = "desc") -> DataFrame:
        """`keywords` of the fitted documents."""
        docs, doc, _ = self.fitted
        return keyword_table(docs, self.fitted_top_terms(), doc, self.options.top_n, order)


def top_per_document(scored: DataFrame, doc: str, score: str, top_n: int) -> DataFrame:
    best = Window.partitionBy(doc).orderBy(F.desc(score), "term")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
    return ranked.select(doc, "rank", "term", score)


def keyword_table(docs: DataFrame, ranked: DataFrame, doc: str, top_n: int, order: str = "desc") -> DataFrame:
    """Attach ranked terms to all documents; documents without terms have null tags.

    Each array holds at most `top_n` terms.
    """
    need_option(order, ["asc", "desc"])
    position = F.col("rank") if order == "desc" else -F.col("rank")
    lists = ranked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(position.alias("at"), "term"))).alias("_k"))
    lists = lists.select(doc, F.transform("_k", lambda k: k["term"]).alias("keywords"))
    return tag_columns(docs.join(lists, doc, "left"), "keywords", top_n)
