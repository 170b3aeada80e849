"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language_model, licenses, mixing, packing, quality_classifier, quality_rules, secrets, simhash, vectors, wrappers
from .common import remainder, session, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(session(spark), sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    scored = quality_classifier.score_quality(docs, quality_classifier.train_classifier(docs, labels))
    verdict = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", verdict.alias("predicted"))


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(table(session(spark), sf_dir, "pages"))


def op3_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(session(spark), sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(session(spark), sf_dir, "documents"))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(session(spark), sf_dir, "documents"), language_model.held_out_tenth())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(session(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(session(spark), sf_dir, "labels").withColumn("domain", mixing.label_domain())
    return mixing.mix(table(spark, sf_dir, "documents"), labels)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(session(spark), sf_dir, "documents")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(simhash.near_duplicates(table(session(spark), sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(session(spark), sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_wrapper_induction, op3_hnsw_near_dedup, op4_best_fit_packing, op5_recurrent_lm, op6_quality_rules, op7_source_mixing, op8_license_scan, op9_simhash_near_dedup, op10_secret_scan)
}

#: No query here can be said whole in SQL; the tests hold each against brute force.
ORACLE_SQL: dict[str, str] = {}
