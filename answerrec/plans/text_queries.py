"""Registered queries: cleaning, tokens, stems and tf-idf keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.functions import text as textfn
from answerrec.functions.stem import SPECIAL_WORDS, STEPS, stem
from answerrec.operators.tfidf import Tfidf
from answerrec.operators.topics import Topics
from answerrec.plans import views
from answerrec.plans.catalogue import register
from answerrec.plans.profile_queries import STOP_SQL, STOP_WORDS, STRIP_SQL, TOKENS_SQL
from answerrec.plans.views import ANSWERS, QUESTIONS, USERS, sql_with
from answerrec.session import materialize

NO_URL_SQL = r"regexp_replace(regexp_replace({0}, 'https?://[A-Za-z0-9./]+', '', 'g'), '\p{{Nd}}+', '', 'g')"
CLEAN_SQL = STRIP_SQL.format(NO_URL_SQL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", "text")


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, word); explode_outer, as explode would compute all tokens twice for its filter."""
    words = textfn.tokens(textfn.clean_text(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", F.explode_outer(words).alias("word")).where("word is not null")


def digest(column: F.Column) -> list[F.Column]:
    return [F.md5(column).alias("digest"), F.length(column).alias("chars")]


@register(f"select page_id, md5(t) as digest, length(t) as chars from (select page_id, {STRIP_SQL.format('html')} as t from pages)")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", *digest(textfn.strip_html(F.col("html"))))


@register(f"select page_id, md5(t) as digest, length(t) as chars from (select page_id, {NO_URL_SQL.format('html')} as t from pages)")
def strip_urls_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", *digest(textfn.strip_urls_and_digits(F.col("html"))))


@register(f"select page_id, md5(t) as digest, length(t) as chars from (select page_id, {CLEAN_SQL.format('html')} as t from pages)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", *digest(textfn.clean_text(F.col("html"))))


WORDS = f"""
words as (select doc_id, unnest({TOKENS_SQL.format(CLEAN_SQL.format('text'))}) as word from documents)"""
KEPT = f"kept as (select doc_id, word as term from words where word not in {STOP_SQL})"


def stem_sql(source: str, word: str) -> str:
    """CTEs `stem_0 …` over the distinct words of `source`; `stemmed` maps word to stem."""
    ctes = [f"""stem_0 as (select distinct {word} as word,
       regexp_replace({word}, '(^|[aeiouy])y', '\\1Y', 'g') as w from {source})"""]
    for i, (column, expression) in enumerate(STEPS):
        known = {c for c, _ in STEPS[:i]} | {"w"}
        star = f"* exclude ({column})" if column in known else "*"
        ctes.append(f"stem_{i + 1} as (select {star}, {expression} as {column} from stem_{i})")
    special = " ".join(f"when '{a}' then '{b}'" for a, b in SPECIAL_WORDS.items())
    ctes.append(f"""stemmed as (select word, case when length(word) <= 2 then word else
       case word {special} else lower(w) end end as stem from stem_{len(STEPS)})""")
    return ",\n".join(ctes)


@register(sql_with(WORDS, stem_sql("words", "word"), select="select word, stem from stemmed"))
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_rows(spark, sf_dir).select("word")
    return words.distinct().withColumn("stem", stem("word"))


LEXICON = """
vocabulary as (select distinct word from words),
lexicon as (select word as form, left(word, length(word) - 1) as lemma from vocabulary
            where right(word, 1) = 'n' and left(word, length(word) - 1) in (select word from vocabulary))"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A `(form, lemma)` table from the texts: words that also occur without their last n."""
    vocabulary = materialize(word_rows(spark, sf_dir).select("word").distinct(), "distinct-words")
    forms = vocabulary.where(F.col("word").endswith("n")).select(
        F.col("word").alias("form"), F.expr("left(word, length(word) - 1)").alias("lemma")
    )
    return forms.join(vocabulary, F.col("lemma") == F.col("word"), "left_semi")


@register(sql_with(WORDS, LEXICON, select="""
select doc_id, coalesce(lemma, word) as term, count(*) as uses
from words left join lexicon on word = form group by all"""))
def lemma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = Tfidf(stem="lemmatizer", lexicon=lexicon(spark, sf_dir))
    return options.term_counts(documents(spark, sf_dir), "doc_id", "text").withColumnRenamed("tf", "uses")


@register(sql_with(WORDS, select="""
select doc_id, count(*) as words, count(distinct word) as distinct_words, min(word) as first_word, max(word) as last_word
from words group by 1"""))
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_rows(spark, sf_dir)
    return words.groupBy("doc_id").agg(
        F.count("word").alias("words"), F.count_distinct("word").alias("distinct_words"),
        F.min("word").alias("first_word"), F.max("word").alias("last_word"))


PLAIN = Tfidf(stem="none", stop_words=STOP_WORDS)


def tfidf_sql(source: str, docs: str, tf: str = "tf", idf: str = "ln((1 + n)::double / (1 + df)) + 1", norm: str = "l2",
              doc: str = "doc_id") -> str:
    """CTEs from `source` (doc, term per occurrence) to `weighted`."""
    length = {"l2": f"sqrt(sum(raw * raw) over (partition by {doc}))", "l1": f"sum(abs(raw)) over (partition by {doc})", "none": "1"}
    return f"""
counts as (select {doc}, term, count(*) as tf from {source} group by all),
freq as (select term, count(*) as df, (select count(*) from {docs}) as n from counts group by term),
raw as (select {doc}, term, counts.tf, {tf} * ({idf}) as raw from counts join freq using (term)),
weighted as (select {doc}, term, tf, raw / {length[norm]} as weight from raw)"""


def top_sql(doc: str = "doc_id", n: int = 5) -> str:
    return f"""
ranked as (select * from (select {doc}, term, round(weight, 6) as weight, row_number() over (
  partition by {doc} order by weight desc, term) as rank from weighted) where rank <= {n})"""


@register(sql_with(WORDS, KEPT, tfidf_sql("kept", "documents"), select="select doc_id, term, tf from counts"))
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLAIN.term_counts(documents(spark, sf_dir), "doc_id", "text")


@register(sql_with(WORDS, KEPT, tfidf_sql("kept", "documents"), select="select distinct term from counts"))
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLAIN.fit(documents(spark, sf_dir), "doc_id", "text").vocabulary()


def weights(spark: SparkSession, sf_dir: str, options: Tfidf) -> DataFrame:
    docs = documents(spark, sf_dir)
    weighted = options.fit(docs, "doc_id", "text").fitted_weights()
    return weighted.select("doc_id", "term", F.round("weight", 6).alias("weight"))


WEIGHTS = "select doc_id, term, round(weight, 6) as weight from weighted"


@register(sql_with(WORDS, KEPT, tfidf_sql("kept", "documents"), select=WEIGHTS))
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir, PLAIN)


@register(sql_with(WORDS, KEPT, tfidf_sql("kept", "documents", "(ln(tf) + 1)", "1.0::double", "l1"), select=WEIGHTS))
def tfidf_sublinear_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir, Tfidf(stem="none", stop_words=STOP_WORDS, use_idf=False, sublinear_tf=True, norm="l1"))


@register(sql_with(WORDS, KEPT, tfidf_sql("kept", "documents", idf="ln(n::double / df) + 1", norm="none"), select=WEIGHTS))
def tfidf_raw_unsmoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir, Tfidf(stem="none", stop_words=STOP_WORDS, smooth_idf=False, norm=None))


@register(sql_with(WORDS, KEPT, tfidf_sql("kept", "documents"), top_sql(), select="select doc_id, rank, term, weight from ranked"))
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return PLAIN.fit(docs, "doc_id", "text").fitted_top_terms().withColumn("weight", F.round("weight", 6))


STEM_KEPT = f"""
stem_kept as (select doc_id, stem as term from words join stemmed using (word)
              where word not in {STOP_SQL} and stem not in {STOP_SQL})"""


@register(sql_with(WORDS, stem_sql("words", "word"), STEM_KEPT, tfidf_sql("stem_kept", "documents"), top_sql(),
                   select="select doc_id, rank, term, weight from ranked"))
def stemmed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ranked = Tfidf(stop_words=STOP_WORDS).fit(docs, "doc_id", "text").fitted_top_terms()
    return ranked.withColumn("weight", F.round("weight", 6))


def tags_sql(entity: str, key: str, n: int = 5) -> str:
    tags = ", ".join(f"max(case when rank = {i} then term end) as tag{i}" for i in range(1, n + 1))
    names = ", ".join(f"tag{i}" for i in range(1, n + 1))
    return f"""select {key}, {names} from {entity} left join (
  select doc_id, {tags} from ranked group by doc_id) on {key} = doc_id"""


TAGS = [f"tag{i}" for i in range(1, 6)]


def user_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = views.users(spark, sf_dir)
    described = users.where(F.col("about_me").isNotNull())
    model = PLAIN.fit(described, "id", "about_me")
    tagged = model.fitted_keywords()
    return users.join(tagged.select("id", *TAGS), "id", "left")


def question_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = views.questions(spark, sf_dir)
    return PLAIN.fit(questions, "question_id", "title").fitted_keywords()


USER_KEPT = f"""
user_words as (select id as doc_id, unnest({TOKENS_SQL.format(CLEAN_SQL.format('about_me'))}) as term from users
               where about_me is not null),
user_kept as (select * from user_words where term not in {STOP_SQL}),
described as (select * from users where about_me is not null)"""
TITLE_KEPT = f"""
title_words as (select question_id as doc_id, unnest({TOKENS_SQL.format(CLEAN_SQL.format('title'))}) as term from questions),
title_kept as (select * from title_words where term not in {STOP_SQL})"""


@register(sql_with(USERS, USER_KEPT, tfidf_sql("user_kept", "described"), top_sql(), select=tags_sql("users", "id")))
def user_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_tags(spark, sf_dir).select("id", *TAGS)


@register(sql_with(ANSWERS, QUESTIONS, TITLE_KEPT, tfidf_sql("title_kept", "questions"), top_sql(),
                   select=tags_sql("questions", "question_id")))
def question_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_tags(spark, sf_dir).select("question_id", *TAGS)


TOPIC_WORDS = """
known as (select word from words where word not in """ + STOP_SQL + """ group by word having count(distinct doc_id) >= 2),
told as (select distinct doc_id from words join known using (word))"""


@register(sql_with(WORDS, TOPIC_WORDS, select="""
select doc_id, case when doc_id in (select doc_id from told) then 1.0::double else 0 end as total, 8 as topics from documents"""))
def document_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic weights of every document add up to 1, or to 0 if it has no word of the vocabulary."""
    docs = documents(spark, sf_dir)
    model = Topics(topics=8, iterations=10, stop_words=STOP_WORDS).fit(docs, "doc_id", "text")
    weights = model.documents(docs, "doc_id", "text").groupBy("doc_id")
    return weights.agg(F.round(F.sum("weight"), 6).alias("total"), F.count(F.lit(1)).cast("int").alias("topics"))
