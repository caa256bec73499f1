"""Pipeline stages and topics."""

import random

from pyspark.ml import Pipeline, PipelineModel

from answerrec.operators.stages import TextCleaner, TfidfKeywords, TfidfKeywordsModel, WordTokenizer
from answerrec.operators.tfidf import Tfidf
from answerrec.operators.topics import Topics


def test_a_saved_pipeline_equals_the_plain_keywords(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text")
    stages = [TextCleaner(), WordTokenizer(stopWords=["the"], language="english"), TfidfKeywords(idCol="doc_id", topN=4, sublinearTf=True, minDF=2, stopWords=["and"])]
    pipeline = Pipeline(stages=stages)
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(docs)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(loaded.stages[-1], TfidfKeywordsModel) and loaded.stages[-1].getOrDefault("topN") == 4
    rows = {r.doc_id: r for r in loaded.transform(docs).collect()}
    plain = Tfidf(top_n=4, sublinear_tf=True, min_df=2, stop_words=["and"]).fit(docs, "doc_id", "text").keywords(docs, "doc_id", "text")
    assert {i: r.keywords for i, r in rows.items()} == {r.doc_id: r.keywords for r in plain.collect()}
    assert all("the" not in r.words for r in rows.values())
    again = model.transform(docs).collect()
    assert {r.doc_id: r.keywords for r in again} == {i: r.keywords for i, r in rows.items()}


def test_stage_params(spark):
    docs = spark.createDataFrame([(1, "Éa cats <b>run</b> 12"), (2, None)], "id long, t string")
    out = WordTokenizer(inputCol="c", outputCol="w").transform(TextCleaner(inputCol="t", outputCol="c").transform(docs)).collect()
    assert [r.c for r in out] == ["Éa cats run ", None] and out[0].w == ["ea", "cats", "run"]
    keywords = TfidfKeywords(inputCol="t", outputCol="k", stem="none", norm="none", topN=1).fit(docs).transform(docs).collect()
    assert {r.id: r.k for r in keywords} == {1: ["cats"], 2: None}


def test_planted_topics_are_found(spark):
    rng = random.Random(3)
    words = {t: [t + c * 2 for c in "abcdefgh"] for t in ("ocean", "forge", "bread")}
    names = list(words)
    rows = [(i, " ".join(rng.choices(words[names[i % 3]], k=20) + ["every"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, t string")
    model = Topics(topics=3, iterations=30, stop_words=["every"], top_n=6).fit(docs, "id", "t")
    keywords = {}
    for r in model.keywords().orderBy("topic", "rank").collect():
        keywords.setdefault(r.topic, []).append(r.term)
    assert len(keywords) == 3 and all(len({w[:5] for w in k}) == 1 and len(k) == 6 for k in keywords.values())
    assert len({k[0][:5] for k in keywords.values()}) == 3
    new = spark.createDataFrame([(1, "oceanaa oceanbb oceancc"), (2, "nothing known"), (3, None)], "id long, t string")
    best = {r.id: r.topic for r in model.best(new, "id", "t").collect()}
    assert keywords[best[1]][0].startswith("ocean") and best[2] is None and best[3] is None
    sums = {r.id: r.s for r in model.documents(new, "id", "t").groupBy("id").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    assert abs(sums[1] - 1) < 1e-9 and sums[2] == 0 == sums[3]
