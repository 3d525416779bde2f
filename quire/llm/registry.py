"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, hard_negatives, language_id, license_scan, line_dedup, merkle, mixing, neighbours, ngram_join, quality, secrets, token_counts, topk
from quire.llm.common import bucket_of, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=5, num=4, den=5)


#: Blocks of each source in a round of the mix; all other sources together give one.
WEIGHTS = {f"src{k}": 1 + k % 3 for k in range(20)}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS, other=1, block=mixing.BLOCK).drop("source")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 3, 1)
    profiles = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, profiles, keep={"held_out": held_out})


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, held_out=bucket_of("doc_id", 5, 0), calibrates=bucket_of("doc_id", 5, 4), threshold=0.3)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents"), dictionary=public_tokenizers.path("byte_bpe_50k.json")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), words=50)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), F.md5("text").alias("text_md5"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("vec_id")
    label = F.when(own % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), own % 100 == 0, label, positives=5, negatives=10, window=(30, 90), scale=256.0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), bucket_of("doc_id", 5, 0), merkle.lower_ascii(F.col("text")))


def op13_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_benchmark_decontamination, op3_ngram_jaccard_join, op4_source_mixing, op5_language_id, op6_quality_classifier, op7_token_counts, op8_secret_scans, op9_license_scans, op10_line_dedup, op11_hard_negative_mining, op12_merkle_manifest, op13_approximate_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk.ORACLE_SQL,
        "op3_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op4_source_mixing": mixing.oracle_sql(WEIGHTS, 1, mixing.BLOCK),
        "op5_language_id": language_id.ORACLE_SQL,
        "op9_license_scans": license_scan.oracle_sql(),
        "op10_line_dedup": line_dedup.ORACLE_SQL,
        "op11_hard_negative_mining": hard_negatives.ORACLE_SQL,
        "op12_merkle_manifest": merkle.oracle_sql(),
    }
