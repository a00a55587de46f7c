"""Training corpus from ``documents``: five stages, each on all that the one before kept.

1. language ID: documents without a known language go
2. quality classifier: documents predicted as bad go
3. SimHash near-dedup: one document of each group stays
4. benchmark decontamination: documents that overlap with a test item go
5. packing: token sequences, with the token ids of every piece

Nulls, empty tables and further columns: as each operator states. The first four stages return
the columns of ``documents`` (and any further ones) as they are. Stage 5 returns ``doc_id, start,
length, ids_crc32, doc_tokens, sequence_id, offset, ids``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool import session
from kickpool.llm import decontamination, language, packing, quality_model, simhash
from kickpool.llm.common import crc_of, discard, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(spark, docs.where(crc_of("doc_id") % 4 != 2))
    return language.keep_identified(spark, docs, model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_of("doc_id") % 5 != 0)
    return quality_model.keep_good(spark, docs, quality_model.train(spark, docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "ids",
    )


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# Trained models and tokenizers are beyond SQL; tests hold every stage against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written, and what came before them is then removed."""
    rows, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = len(session.MADE)
        rows, made = stored(spark, stage(spark, rows, sf_dir), f"pipeline-{name}")
        session.release(spark, before, keep=[made])
        if path is not None:
            discard(spark, path)
        path = made
    return STAGES[-1][1](spark, rows, sf_dir)
