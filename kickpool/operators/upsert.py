"""Upsert without MERGE: one full-outer join on the key, then a rewrite of touched rounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from kickpool.functions import fixed_values as fv
from kickpool.functions.text import strip_ws
from kickpool.session import fresh_path, written

# --- fixed values: what an insert puts where the payload has no such column -----------
ROUND_DEFAULTS = {"status": "draft"}
MATCH_DEFAULTS = {
    "weather": fv.WEATHER_UNKNOWN,
    "home_rest_days": 5,
    "away_rest_days": 5,
    "home_injury_level": 0,
    "away_injury_level": 0,
}
CHANGES = ("inserted", "updated", "unchanged")
NEXT = "__next"  # ending of the folder that holds a table's replacement
PARTS = "__parts"  # the same for replacements of some of its partitions
PREDICTION_DEFAULTS = {"model_version": "rule-v0.1", "reasons": "[]"}


def with_column_defaults(rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add absent columns with their default. A present column keeps its NULLs."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


def require_unique(rows: DataFrame, key: Sequence[str]) -> None:
    """Raise when a key occurs twice in the payload; the count combines map-side."""
    twice = rows.groupBy(*key).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"duplicate upsert key: {twice[0].asDict()}")


def require_complete(rows: DataFrame, key: Sequence[str]) -> None:
    """Raise when a part of a key is NULL or a blank text: such a row can never be met again."""
    missing = [
        F.col(k).isNull() | (strip_ws(F.col(k).cast("string")) == "") for k in key
    ]
    lacking = rows.where(reduce(lambda a, b: a | b, missing)).select(*key).take(1)
    if lacking:
        raise ValueError(f"incomplete upsert key: {lacking[0].asDict()}")


def require_known(columns: Sequence[str], known: Sequence[str]) -> None:
    unknown = [c for c in columns if c not in known]
    if unknown:
        raise ValueError(f"columns the table does not have: {unknown}")


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows cast to the table's types, as far as they have its columns. Fractions of whole-number
    columns are cut; a text that is no time stamp becomes NULL."""

    def cast(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.TimestampType):
            return F.col(f.name).try_cast(f.dataType)
        return F.col(f.name).cast(f.dataType)

    return rows.select(*(cast(f).alias(f.name) for f in schema.fields if f.name in rows.columns))


def merge_rows(
    target: DataFrame,
    payload: DataFrame,
    key: Sequence[str],
    defaults: Mapping[str, object] | None = None,
    change: str | None = None,
) -> DataFrame:
    """Insert-or-update as a DataFrame in the target's columns.

    A column the payload has overwrites, also with NULL. A column it lacks keeps the old
    value on update and takes its default on insert. A column the target lacks is an error.
    ``change`` names a column that tells rows of the payload apart by ``CHANGES``; other rows have
    NULL there.
    """
    defaults = defaults or {}
    require_known(payload.columns, target.columns)
    given = [c for c in target.columns if c in payload.columns and c not in key]
    new = payload.select(*key, *(F.col(c).alias(f"_new_{c}") for c in given))
    new = new.withColumn("_in_payload", F.lit(True))
    old = target.withColumn("_in_target", F.lit(True))
    joined = old.join(new, list(key), "full_outer")

    def merged(c: str) -> Column:
        kind = target.schema[c].dataType
        if c in given:
            return F.when(F.col("_in_payload"), F.col(f"_new_{c}").cast(kind)).otherwise(F.col(c))
        return F.when(F.col("_in_target"), F.col(c)).otherwise(F.lit(defaults.get(c)).cast(kind))

    columns = [F.col(c) if c in key else merged(c).alias(c) for c in target.columns]
    if change is not None:
        equal = [F.col(c).eqNullSafe(F.col(f"_new_{c}").cast(target.schema[c].dataType)) for c in given]
        equal = reduce(lambda a, b: a & b, equal, F.lit(True))
        kind = F.when(F.col("_in_target").isNull(), CHANGES[0]).when(~equal, CHANGES[1]).otherwise(CHANGES[2])
        columns.append(F.when(F.col("_in_payload"), kind).alias(change))
    return joined.select(*columns)


def stored_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    partitions: Mapping[str, T.DataType] | None = None,
) -> DataFrame | None:
    """The table at a path, or None while nothing has been stored there.

    With a schema, columns that older files lack are NULL. Partition values are texts in the
    names of folders and take the schema's types, or those of ``partitions``; with neither,
    Spark types them by their look, so that ``01`` would be 1. While a replacement is being put
    in place, its complete copy is read.
    """
    path = path + NEXT if complete(spark, path + NEXT) else path
    files, name = folder(spark, path)
    if not files.exists(name):
        return None
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise
    if not partitions:
        return found
    kinds = ((f.name, partitions.get(f.name, f.dataType)) for f in found.schema.fields)
    return spark.read.schema(T.StructType([T.StructField(*kind) for kind in kinds])).parquet(path)


def folder(spark: SparkSession, path: str) -> tuple:
    """File system and name of a folder, as Spark sees it."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def remove_folder(spark: SparkSession, path: str) -> None:
    files, name = folder(spark, path)
    files.delete(name, True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder ran to its end."""
    files, name = folder(spark, path + "/_SUCCESS")
    return files.exists(name)


def publish(rows: DataFrame, path: str) -> None:
    """Replace an unpartitioned table so that a crash at any point loses nothing.

    The new table is complete beside the old one before that is touched, and is read from there
    (``stored_table``) until it has its name. An interrupted replacement is finished by
    ``recover``.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(path + NEXT)
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Give a complete replacement the table's name; drop a copy that never became complete."""
    files, copy = folder(spark, path + NEXT)
    if complete(spark, path + NEXT):
        remove_folder(spark, path)
        if not files.rename(copy, folder(spark, path)[1]):
            raise OSError(f"cannot rename {path + NEXT}")
    else:
        remove_folder(spark, path + NEXT)


def publish_parts(rows: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that the rows hold. They are complete beside the table before it is
    touched, and are then moved into it; ``recover_parts`` finishes an interrupted move."""
    # Rebalancing splits a partition that is much larger than the others over many tasks.
    rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path + PARTS)
    recover_parts(rows.sparkSession, path)


def recover_parts(spark: SparkSession, path: str) -> None:
    """Move complete replacements of partitions into the table; drop such as never were complete.

    A loop over the names of partitions on the driver, as Spark's own commit of an overwrite is.
    """
    files, parts = folder(spark, path + PARTS)
    if complete(spark, path + PARTS):
        files.mkdirs(folder(spark, path)[1])
        for status in files.listStatus(parts):
            if status.isDirectory():
                place = f"{path}/{status.getPath().getName()}"
                remove_folder(spark, place)
                if not files.rename(status.getPath(), folder(spark, place)[1]):
                    raise OSError(f"cannot move {status.getPath()}")
    remove_folder(spark, path + PARTS)


def upsert_table(
    path: str,
    payload: DataFrame,
    key: Sequence[str],
    partition: str | None = None,
    defaults: Mapping[str, object] | None = None,
    schema: str | T.StructType | None = None,
    staged: bool = False,
    checked: bool = False,
) -> dict[str, int]:
    """Upsert into a parquet table, created on first use; counts of the payload's rows by ``CHANGES``.

    With a ``schema`` the table has exactly its columns and types, and the payload is cast to
    them. Columns that the table does not know, incomplete and repeated keys are refused. With a
    ``partition`` column, which is part of the key, only the partitions that occur in the payload
    are read and rewritten, their values under the payload's type. The payload is written to the
    shared folder first, so that it is computed once, and removed at the end. The merged rows are
    written once, beside the table, and take their place by renaming. ``staged`` says that the
    payload is read from written rows already, ``checked`` that its keys are complete and unique.
    The counts are observed in the writing job itself. Running the same upsert again after a
    failure gives the same table.
    """
    if partition is not None and partition not in key:
        raise ValueError("the partition column must be part of the upsert key")
    spark = payload.sparkSession
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        require_known(payload.columns, schema.fieldNames())
        payload = conformed(payload, schema)
    recover(spark, path) if partition is None else recover_parts(spark, path)
    copy = fresh_path(spark, "payload")
    counts = Observation()
    try:
        if not staged:
            payload = written(payload, copy)
        if not checked:
            require_complete(payload, key)
            require_unique(payload, key)
        kinds = {partition: payload.schema[partition].dataType} if partition else None
        target = stored_table(spark, path, schema, kinds)
        if target is None:
            rows = _first_rows(payload, defaults or {}, schema).withColumn("_change", F.lit(CHANGES[0]))
        else:
            rows = _merged_rows(target, payload, key, partition, defaults)
        rows = observed(rows, counts)
        publish(rows, path) if partition is None else publish_parts(rows, path, partition)
        return {name: int(counts.get[name]) for name in CHANGES}
    finally:
        remove_folder(spark, copy)


def observed(rows: DataFrame, counts: Observation) -> DataFrame:
    """The rows without ``_change``, whose values are counted while they are written."""
    return rows.observe(counts, *(F.count_if(F.col("_change") == name).alias(name) for name in CHANGES)).drop("_change")


def _first_rows(
    payload: DataFrame, defaults: Mapping[str, object], schema: T.StructType | None
) -> DataFrame:
    """What the first upsert stores: the payload, with defaults and the schema's further columns."""
    rows = with_column_defaults(payload, defaults)
    if schema is None:
        return rows
    none = {f.name: F.lit(None) for f in schema.fields if f.name not in rows.columns}
    return rows.withColumns(none).select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))


def _merged_rows(
    target: DataFrame,
    payload: DataFrame,
    key: Sequence[str],
    partition: str | None,
    defaults: Mapping[str, object] | None,
) -> DataFrame:
    """The rows of the touched partitions, or of the table, after the merge."""
    kinds = {c: payload.schema[c].dataType for c in key}
    target = target.select(
        *(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in target.columns)
    )
    if partition is not None:
        touched = payload.select(partition).distinct()
        target = target.join(touched, partition, "left_semi").select(*target.columns)
    return merge_rows(target, payload, key, defaults, "_change")
