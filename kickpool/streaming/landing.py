"""Streams of landed pages and imported rows.

Page and scoring operators work row by row and take a streaming DataFrame as they are. What
needs a whole batch, such as the upsert, runs per micro-batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kickpool.operators.lookup import first_per_key
from kickpool.operators.upsert import stored_table, upsert_table

PAGE_SCHEMA = "snapshot_id string, source_key string, landed_at timestamp, html string"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed pages as they arrive in a folder of parquet files."""
    reader = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def upsert_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    key: Sequence[str],
    partition: str,
    order: str,
    defaults: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Keep a stored table current from a stream; the row of a key that is last by ``order`` wins.

    The table keeps the order column, and a late row that is older than the stored one is left
    out; of rows equal in it the one with the largest values, column by column, wins. A batch
    that is run again after a failure upserts the same rows to the same effect.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in (*key, order)]
        latest = first_per_key(batch, key, [F.col(c).desc_nulls_last() for c in (order, *rest)])
        kind = {partition: batch.schema[partition].dataType}
        stored = stored_table(batch.sparkSession, path, partitions=kind)
        if stored is not None and order in stored.columns:
            kinds = {k: batch.schema[k].dataType for k in key}
            have = stored.select(*(F.col(k).cast(t).alias(k) for k, t in kinds.items()), F.col(order).alias("_have"))
            latest = latest.join(have, list(key), "left")
            latest = latest.where(F.col("_have").isNull() | (F.col(order) >= F.col("_have"))).drop("_have")
        upsert_table(path, latest, key, partition, defaults)

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
