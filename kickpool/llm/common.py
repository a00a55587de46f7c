"""Helpers of the training-data operators: scans, written intermediates, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from kickpool.session import fresh_path

# Rows of an Arrow batch are handled in slices, so a batch of long texts is never held twice. A
# slice ends with the row that fills its bytes, so at most one text goes beyond them.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(spark: SparkSession, rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``written`` rows and the path they were written to."""
    path = fresh_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def written(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the cluster's shared folder and read again: the lineage ends here.

    A lost executor costs its running tasks, never the steps before.
    """
    return stored(spark, rows, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``fresh_path`` named and that nothing reads any more."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def crc_of(column: Column | str) -> Column:
    """CRC-32 of a value's text; null for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary"))


HASH_RANGE = 1 << 31
SPARE = 4  # how many times the wanted rows the first filter lets through, as expected


def lowest_hashes(rows: DataFrame, group: str, key: str, n: int, sizes: DataFrame) -> DataFrame:
    """Per group the ``n`` rows with the smallest hash of their key, with their ``place`` from 1.

    ``sizes`` has ``group, n``, the rows of each group, few enough groups to broadcast. A first
    filter on the hash lets about ``SPARE * n`` rows of a group through, however large it is and
    in however many partitions, so only these are shuffled and put in order.
    """
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(key), F.lit(HASH_RANGE)))
    share = F.lit(float(SPARE * n * HASH_RANGE)) / F.col("n")
    some = hashed.join(F.broadcast(sizes), group).where(F.col("_hash") < share)
    place = F.row_number().over(Window.partitionBy(group).orderBy("_hash", key))
    return some.withColumn("place", place).where(F.col("place") <= n).drop("_hash", "n")


_LAST: list = [None]


def claim(cache) -> None:
    """Clear the word cache of another operator that ran in this worker before, if any.

    A Python worker lives through all stages of a pipeline; only the running one keeps its cache.
    """
    if _LAST[0] is not cache:
        if _LAST[0] is not None:
            _LAST[0].clear()
        _LAST[0] = cache


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of each row's text and binary columns."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(row_bytes(batch))
        at = 0
        while at < batch.num_rows:
            filled = SLICE_BYTES + (ends[at - 1] if at else 0)
            end = min(int(np.searchsorted(ends, filled)) + 1, at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def map_slices(
    rows: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: T.StructType | str,
) -> DataFrame:
    """A stateless function over small slices of each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            made = work(piece)
            if made is not None and made.num_rows:
                yield made

    return rows.mapInArrow(run, schema)
