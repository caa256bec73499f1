"""The registered queries of the corpus operators, and the SQL texts that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerrec.llm.base import fold, table
from answerrec.llm.bpe import digest_texts
from answerrec.llm.centroids import centroid_clusters
from answerrec.llm.decontam import find_items
from answerrec.llm.html import extract_text
from answerrec.llm.langid import identify, train_languages
from answerrec.llm.licenses import scan_licenses, train_licenses
from answerrec.llm.lines import dedup_lines
from answerrec.llm.neardup import near_duplicates
from answerrec.llm.quality import score_quality, train_quality
from answerrec.llm.simhash import simhash_duplicates
from answerrec.llm.topk import top_inner_products
from answerrec.llm.toxicity import score_toxicity, train_toxicity
from answerrec.llm.whitening import whitened

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOXIC_FROM, GOOD_FROM = 0.3, 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, train_licenses(docs))
    return found.select("doc_id", F.size("licenses").alias("n_notices"), "licenses")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = digest_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train_languages(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.transform("found", lambda f: f["item_id"])
    return found.select("doc_id", F.size("found").cast("long").alias("n_items"), items.alias("item_ids"), F.transform("found", lambda f: f["distance"]).alias("distances"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), weighted=True)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP6_SQL = """
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
    from documents
), keyed as (
    select doc_id, place, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), holders as (
    select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), marked as (
    select k.doc_id, k.place, k.line, h.first is not null and k.doc_id > h.first as gone
    from keyed k left join holders h on k.key = h.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_toxicity, op2_licenses, op3_bpe, op4_topk, op5_quality, op6_line_dedup, op7_language, op8_decontamination, op9_html, op10_near_duplicates, op11_simhash, op12_centroids, op13_whitening)
}
OP4_SQL = """
with whole as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from whole q join whole c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

OP12_KEPT = """
kept as materialized (
    select row_number() over (order by vec_id, v) as r, vec_id, v from (
        select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
        from embeddings
        where vec_id is not null and len(embedding) = 64
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    )
), entries as materialized (
    select r, unnest(v) as x, generate_subscripts(v, 1) as d from kept
), started as materialized (
    select row_number() over (order by h, v) - 1 as k, v
    from (select sha256('3:' || vec_id) as h, v from kept order by h, v limit 8)
), c0 as materialized (
    select k, generate_subscripts(v, 1) as d, unnest(v) as x from started
)"""
OP12_ASSIGN = """
a{i} as materialized (
    select r, k, distance from (
        select *, row_number() over (partition by r order by distance, k) as place from (
            select r, k, sum((e.x - c.x) * (e.x - c.x)) as distance from entries e join c{i} c using (d) group by r, k
        )
    ) where place = 1
)"""
OP12_MOVE = """
c{j} as materialized (
    select c.k, c.d, case when m.n is null then c.x else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as x
    from c{i} c left join (
        select k, d, sum(x) as s, count(*) as n from entries join a{i} using (r) group by k, d
    ) m on c.k = m.k and c.d = m.d
)"""
OP12_ROUNDS = 10
OP12_SQL = f"""
with {OP12_KEPT}, {", ".join(OP12_ASSIGN.format(i=i) + "," + OP12_MOVE.format(i=i, j=i + 1) for i in range(OP12_ROUNDS))},
{OP12_ASSIGN.format(i=OP12_ROUNDS)}, digests as (
    select k, sha256(string_agg(cast(x as varchar), ',' order by d)) as centroid_sha256 from c{OP12_ROUNDS} group by k
)
select vec_id, cast(k as integer) as cluster, cast(distance as bigint) as distance,
       cast(sum(distance) over (partition by k) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia, centroid_sha256
from a{OP12_ROUNDS} join kept using (r) join digests using (k)
"""

ORACLES = {"op4_topk": OP4_SQL, "op6_line_dedup": OP6_SQL, "op12_centroids": OP12_SQL}
