"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Settings the operators count on: AQE re-plans joins from real sizes, splits skewed join
# partitions (also where that costs one more exchange) and evens out written files. Rows
# carry costly text work, so small shuffles still spread over all cores.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def with_engine_conf(spark: SparkSession) -> SparkSession:
    """A session of the caller's own with the settings above, as far as it can still take them."""
    for key, value in ENGINE_CONF.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kickpool")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session without that setting gets a folder on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):  # local-cluster shares no folder
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


# Paths that ``fresh_path`` named in this process, in order.
MADE: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten."""
    MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return MADE[-1]


def release(spark: SparkSession, since: int = 0, keep: Sequence[str] = ()) -> None:
    """Remove what was written to paths named since the given place in ``MADE``.

    For a caller that has used its results: frames that still read these paths cannot be read
    any more.
    """
    for path in [p for p in MADE[since:] if p not in keep]:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)
        MADE.remove(path)


def written(rows: DataFrame, path: str) -> DataFrame:
    """The same rows, read back from a table written at the path."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
