"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, curve_packing, language_id, media_chunks, merkle_warc, permutation_index, pii_surrogates, simhash_dedup, suffix_dedup, token_counts
from .common import read


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replace(docs)


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a replica in which one page of 97 has another first character, one of 89 is missing and
    one of 83 stands twice."""
    pages = read(spark, sf_dir, "pages")
    of = lambda n, r: F.col("page_id") % n == r
    hurt = F.when(of(97, 5), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    times = F.when(of(89, 7), 0).when(of(83, 11), 2).otherwise(1)
    replica = pages.withColumn("html", hurt).withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(2)))).where(F.col("nth") <= times)
    return merkle_warc.audit(merkle_warc.records(pages), merkle_warc.records(replica))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.store_and_rebuild(read(spark, sf_dir, "documents"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(read(spark, sf_dir, "documents"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_bpe_tree, op3_merkle_fixity, op4_suffix_dedup, op5_media_chunks, op6_curve_packing, op7_token_counts, op8_language_id, op9_simhash_dedup, op10_permutation_index)}

ORACLE_SQL = {
    "op3_merkle_fixity": """
        WITH r AS (
            SELECT page_id, CAST(floor(page_id / 1024.0) AS BIGINT) AS file,
                   strlen(coalesce(html, '')) + strlen(coalesce(url, '')) + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR))
                   + strlen('WARC/1.0') + strlen('WARC-Type: resource') + strlen('WARC-Target-URI: ') + strlen('Content-Length: ') + 10 + 4 AS size
            FROM pages),
        own AS (
            SELECT file, row_number() OVER w - 1 AS number, CAST(sum(size) OVER w - size AS BIGINT) AS "offset", size, page_id,
                   CASE WHEN page_id % 89 = 7 THEN 'missing' WHEN page_id % 97 = 5 THEN 'corrupt' ELSE 'ok' END AS status
            FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id)),
        other AS (
            SELECT file, nth, row_number() OVER w - 1 AS number, CAST(sum(size) OVER w - size AS BIGINT) AS "offset", size, page_id, 'added' AS status
            FROM r, range(1, 3) t(nth) WHERE page_id % 89 <> 7 AND (nth = 1 OR page_id % 83 = 11) WINDOW w AS (PARTITION BY file ORDER BY page_id, nth))
        SELECT * FROM own UNION ALL SELECT * EXCLUDE (nth) FROM other WHERE nth = 2""",
    "op10_permutation_index": None,
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
