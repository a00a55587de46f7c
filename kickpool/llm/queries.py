"""Queries of the training-data operators, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from kickpool.llm import (
    chat,
    decontamination,
    extraction,
    language,
    licenses,
    merkle,
    packing,
    quality_model,
    quality_rules,
    simhash,
    token_counts,
    trie,
    warc,
)
from kickpool.llm.common import crc_of, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(spark, docs.where(crc_of("doc_id") % 4 != 2))
    held_out = F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    return language.identify(spark, docs, model).select("doc_id", held_out, "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.overlaps(spark, docs, items)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = extraction.main_texts(spark, pages, extraction.train(pages))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality_model.train(spark, docs, labels.where(crc_of("doc_id") % 5 != 0))
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return quality_model.score(spark, docs, machine).select("doc_id", held_out, "score", "predicted")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, table(spark, sf_dir, "documents")).drop("proof")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark, table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_chat": op7_chat,
    "op8_extraction": op8_extraction,
    "op9_warc": op9_warc,
    "op10_quality_model": op10_quality_model,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
    "pipeline": corpus_pipeline.run,
}
WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""

ORACLES: dict[str, str] = {
    "op4_licenses": licenses.scan_sql(),
    "op7_chat": chat.SQL,
    "op9_warc": WARC_SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_prefix_trie": trie.SQL,
}
