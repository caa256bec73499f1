"""Stages for `pyspark.ml.Pipeline`: cleaning, words, and tf-idf keywords.

They wrap the column expressions and tables of this package, keep their options as params,
and are saved and loaded with the pipeline that holds them.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.errors import need_columns
from answerrec.functions.text import clean_text, stop_list, tokens
from answerrec.operators.tfidf import Tfidf, TfidfModel, keyword_table


class TextCleaner(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Texts without URLs, digits and markup."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "clean"):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="text", outputCol="clean")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        need_columns(dataset.columns, self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), clean_text(F.col(self.getInputCol())))


class WordTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Lower-case words of at least two letters, without accents and stop words."""

    stripAccents = Param(Params._dummy(), "stripAccents", "whether accents are folded", TypeConverters.toBoolean)
    stopWords = Param(Params._dummy(), "stopWords", "words that are left out", TypeConverters.toListString)
    language = Param(Params._dummy(), "language", "a language whose stop words are left out, or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "clean", outputCol: str = "words", stripAccents: bool = True, stopWords: list[str] = [], language: str = ""):  # noqa: B006, N803
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="clean", outputCol="words", stripAccents=True, stopWords=[], language="")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        need_columns(dataset.columns, self.getInputCol())
        words = tokens(F.col(self.getInputCol()), self.getOrDefault(self.stripAccents))
        language = self.getOrDefault(self.language)
        stop = [*self.getOrDefault(self.stopWords), *(stop_list(language) if language else [])]
        return dataset.withColumn(self.getOutputCol(), F.filter(words, lambda w: ~w.isin(*stop)) if stop else words)


class _KeywordParams(HasInputCol, HasOutputCol):
    idCol = Param(Params._dummy(), "idCol", "the column that names a document", TypeConverters.toString)
    topN = Param(Params._dummy(), "topN", "keywords per document", TypeConverters.toInt)
    stem = Param(Params._dummy(), "stem", "none or stemmer", TypeConverters.toString)
    norm = Param(Params._dummy(), "norm", "l1, l2 or none", TypeConverters.toString)
    useIdf = Param(Params._dummy(), "useIdf", "whether rare terms weigh more", TypeConverters.toBoolean)
    smoothIdf = Param(Params._dummy(), "smoothIdf", "whether one more document is assumed to hold every term", TypeConverters.toBoolean)
    sublinearTf = Param(Params._dummy(), "sublinearTf", "whether counts enter by their logarithm", TypeConverters.toBoolean)
    minDF = Param(Params._dummy(), "minDF", "documents a term must occur in", TypeConverters.toInt)
    stopWords = Param(Params._dummy(), "stopWords", "words that are left out", TypeConverters.toListString)

    def _defaults(self) -> None:
        self._setDefault(
            inputCol="text", outputCol="keywords", idCol="id", topN=5, stem="stemmer", norm="l2", useIdf=True, smoothIdf=True,
            sublinearTf=False, minDF=1, stopWords=[],
        )

    def options(self) -> Tfidf:
        get = self.getOrDefault
        norm = get(self.norm)
        return Tfidf(
            norm=None if norm == "none" else norm, use_idf=get(self.useIdf), smooth_idf=get(self.smoothIdf), sublinear_tf=get(self.sublinearTf),
            top_n=get(self.topN), stem=get(self.stem), stop_words=tuple(get(self.stopWords)), min_df=get(self.minDF),
        )


class TfidfKeywords(Estimator, _KeywordParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns document frequencies from raw texts."""

    @keyword_only
    def __init__(
        self, *, inputCol: str = "text", outputCol: str = "keywords", idCol: str = "id", topN: int = 5, stem: str = "stemmer", norm: str = "l2",
        useIdf: bool = True, smoothIdf: bool = True, sublinearTf: bool = False, minDF: int = 1, stopWords: list[str] = [],
    ):  # fmt: skip  # noqa: B006, N803
        super().__init__()
        self._set(**self._input_kwargs)
        self._defaults()

    def _fit(self, dataset: DataFrame) -> TfidfKeywordsModel:
        learned = self.options().fit(dataset, self.getOrDefault(self.idCol), self.getInputCol())
        return self._copyValues(TfidfKeywordsModel(learned.terms))


class TfidfKeywordsModel(Model, _KeywordParams, MLReadable, MLWritable):
    """Adds the strongest terms of each document, strongest first; null where it has none."""

    def __init__(self, terms: DataFrame | None = None):
        super().__init__()
        self._defaults()
        self.terms = terms

    def _transform(self, dataset: DataFrame) -> DataFrame:
        doc, text, out = self.getOrDefault(self.idCol), self.getInputCol(), self.getOutputCol()
        options = self.options()
        model = TfidfModel(options, self.terms, (dataset, doc, text), self.terms)
        ranked = model.top_terms(dataset, doc, text)
        plain = dataset.drop("keywords", out)
        tags = [f"tag{i + 1}" for i in range(options.top_n)]
        found = keyword_table(plain.select(doc), ranked, doc, options.top_n).drop(*tags)
        return plain.join(found.withColumnRenamed("keywords", out).distinct(), doc, "left")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader[TfidfKeywordsModel]:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: TfidfKeywordsModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, SparkSession.getActiveSession())
        self.instance.terms.write.parquet(f"{path}/terms")


class _ModelReader(MLReader[TfidfKeywordsModel]):
    def load(self, path: str) -> TfidfKeywordsModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = TfidfKeywordsModel(spark.read.parquet(f"{path}/terms"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
