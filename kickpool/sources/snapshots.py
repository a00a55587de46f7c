"""Landed pages: files or a table of (key, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<source_key>.html`` file: source_key, snapshot_id, landed_at, html."""
    files = spark.read.text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(
        F.regexp_replace(name, r"\.html?$", "").alias("source_key"),
        F.col("_metadata.file_path").alias("snapshot_id"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("value").alias("html"),
    )


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    """Scan of a pages table; files and their row groups set how it spreads."""
    return spark.read.parquet(path)


def land_snapshots(pages: DataFrame, path: str) -> None:
    """Append landed pages, leaving out failed ones; per key the last one counts on reading."""
    pages.where(F.col("html").isNotNull()).write.mode("append").parquet(path)
