"""One query per operator, over its whole table with production parameters, and SQL where it can be told."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import language
from casework.llm import quality as good
from casework.llm import toxicity as toxic
from casework.llm.embeddings import near_vectors
from casework.llm.hard_negatives import hard_negatives
from casework.llm.mixing import mix
from casework.llm.packing import pack
from casework.llm.passages import digests, repeated_spans
from casework.llm.periodic_runs import periodic_runs, repeated_tails, run_digests
from casework.llm.sampling import remainder
from casework.llm.simhash import near_duplicates
from casework.llm.token_counts import token_counts
from casework.llm.topk import top_k
from casework.llm.warc import round_trip
from casework.session import let_workers_import


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = toxic.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxic.toxicity(docs, model)
    held_out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = language.fit(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_place", "in_mix")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(repeated_tails(table(spark, sf_dir, "documents"))))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = good.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    held_out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    return good.quality(docs, model).select("doc_id", held_out, "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash": op5_simhash,
    "op6_top_k": op6_top_k,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality": op13_quality,
}

ORACLES: dict[str, str] = {
    "op6_top_k": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM q AS a JOIN q AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op7_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.95
        ), reached(a, b) AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM reached AS r JOIN l ON r.b = l.a
        ), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a
        ), c AS (SELECT a, min(b) AS low FROM reached GROUP BY a)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
            e.vec_id <= coalesce(low, e.vec_id) AS kept
        FROM embeddings AS e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op11_hard_negatives": """
        WITH q AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM q AS a JOIN q AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank
            FROM s WHERE same
        ), n AS (
            SELECT anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
                s.score AS negative_score, positive_rank,
                row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
            FROM p JOIN s USING (anchor_id)
            WHERE positive_rank <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
        ) SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM n WHERE rank <= 5
    """,
}
