"""Topics of documents: latent Dirichlet allocation over the words of the texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerrec.errors import need_columns
from answerrec.functions.text import clean_text, stop_list, tokens
from answerrec.session import spread


@dataclass(frozen=True)
class Topics:
    """Options of the topic model.

    The vocabulary is the `vocabulary` most frequent words that occur in at least `min_df`
    documents, or in at least that share of them if below 1. The driver holds one number per
    topic and word of the vocabulary; texts stay where they are.
    """

    topics: int = 10
    iterations: int = 20
    vocabulary: int = 2**17
    min_df: float = 2
    top_n: int = 5
    stop_words: str | Sequence[str] = ()
    seed: int = 42

    def words(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        need_columns(docs.columns, doc, text)
        words = tokens(clean_text(F.col(text)))
        if self.stop_words:
            words = F.filter(words, lambda w: ~w.isin(*stop_list(self.stop_words)))
        return spread(docs.select(doc, text)).select(doc, F.coalesce(words, F.array().cast("array<string>")).alias("_words"))

    def fit(self, docs: DataFrame, doc: str, text: str) -> TopicModel:
        words = self.words(docs, doc, text)
        counter = CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=self.vocabulary, minDF=float(self.min_df)).fit(words)
        lda = LDA(k=self.topics, maxIter=self.iterations, seed=self.seed, optimizer="online", featuresCol="_counts", topicDistributionCol="_topics")
        return TopicModel(self, counter, lda.fit(counter.transform(words)))


@dataclass(frozen=True)
class TopicModel:
    """A fitted topic model; it serves documents that were not there when fitting, too."""

    options: Topics
    counter: CountVectorizerModel = field(repr=False)
    lda: LDAModel = field(repr=False)

    def keywords(self) -> DataFrame:
        """Rows `(topic, rank, term, weight)`: the most probable words of each topic."""
        rows = [
            (t.topic, rank, self.counter.vocabulary[i], float(w))
            for t in self.lda.describeTopics(self.options.top_n).collect()
            for rank, (i, w) in enumerate(zip(t.termIndices, t.termWeights), 1)
        ]
        return self.lda.describeTopics(1).sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")

    def documents(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """Rows `(doc, topic, weight)` of every document and topic; weights of a document sum to
        1, or are 0 if it has no word of the vocabulary."""
        found = self.lda.transform(self.counter.transform(self.options.words(docs, doc, text)))
        return found.select(doc, F.posexplode(vector_to_array("_topics")).alias("topic", "weight"))

    def best(self, docs: DataFrame, doc: str, text: str) -> DataFrame:
        """`(doc, topic, weight)`: the likeliest topic of each document, null without known words."""
        found = self.lda.transform(self.counter.transform(self.options.words(docs, doc, text)))
        weights = vector_to_array("_topics")
        most = F.array_max(weights)
        topic = F.when(most > 0, F.array_position(weights, most).cast("int") - 1)
        return found.select(doc, topic.alias("topic"), F.when(most > 0, most).alias("weight"))
