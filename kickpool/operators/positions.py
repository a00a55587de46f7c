"""Exact positions within groups, however large a group is, and rows in written ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kickpool.session import fresh_path, written

PART_SHIFT = 33  # monotonically_increasing_id holds the partition above this bit


def in_ranges(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """The rows in order of the keys, in ranges: ``_part`` numbers the range, ``_at`` the row.

    A group may lie in several ranges, so no task holds it whole. The ordered rows are written
    once, so a lost executor cannot change them; equal rows take any order, and are told apart so
    that no range holds all of them. The input is read twice.
    """
    keys = [*keys, F.col("_tie")]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, fresh_path(rows.sparkSession, "ranges"))
    return ranged.withColumn("_part", F.shiftright("_at", PART_SHIFT))


def with_positions(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with ``position`` (from 0, in order within the group) and ``size`` of the group.

    Each range of group and order counts its own rows, and the counts of a group before a range
    are its offset there.
    """
    ranged = in_ranges(rows, [F.col(name).asc_nulls_first() for name in group] + list(order))
    counts = ranged.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(name).alias(f"_g{i}") for i, name in enumerate(group)],
        F.col("_part").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("size"),
    )
    same = F.col("_part") == F.col("_p")
    for i, name in enumerate(group):
        same &= F.col(name).eqNullSafe(F.col(f"_g{i}"))
    found = ranged.join(shifts, same).withColumn("position", F.col("_at") + F.col("_shift"))
    return found.select(*rows.columns, "position", "size")


def last_before(
    rows: DataFrame,
    captures: DataFrame,
    on: Sequence[str],
    at: str,
    captured_at: str,
    values: Sequence[str],
    order: Sequence[str] = (),
) -> DataFrame:
    """As-of join: every row with ``values`` of the last capture of its key not later than ``at``.

    Of captures at one time the last by ``order``, then by its values, counts. Rows without a key
    or a time, and those before the first capture, have NULL values. Both inputs are put into
    ranges of (key, time) together; each range carries its last capture along its rows, and a
    capture is handed on to the ranges after it, so a key may hold most of the rows.
    """
    kept = rows.columns
    capture = F.struct(F.col(captured_at).alias("_time"), *order, *(F.col(v).alias(f"_v_{v}") for v in values))
    usable = captures.where(F.col(captured_at).isNotNull())
    one = usable.select(*on, F.col(captured_at).alias("_time"), F.lit(0).alias("_kind"), capture.alias("_capture"))
    other = rows.select(*on, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.struct(*kept).alias("_row"))
    both = one.unionByName(other, allowMissingColumns=True)
    keys = [F.col(name).asc_nulls_first() for name in on]
    ranged = in_ranges(both, [*keys, F.col("_time").asc_nulls_first(), F.col("_kind").asc(), F.col("_capture").asc_nulls_first()])

    along = Window.partitionBy(*on, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.withColumn("_last", F.last("_capture", ignorenulls=True).over(along)).where("_kind = 1")
    ends = ranged.groupBy(*on, "_part").agg(F.max("_capture").alias("_end"))
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        *[F.col(name).alias(f"_g{i}") for i, name in enumerate(on)],
        F.col("_part").alias("_p"),
        F.last("_end", ignorenulls=True).over(before).alias("_handed"),
    ).where("_handed IS NOT NULL")
    same = F.col("_part") == F.col("_p")
    for i, name in enumerate(on):
        same &= F.col(name) == F.col(f"_g{i}")
    found = inside.join(handed, same, "left")
    last = F.coalesce("_last", "_handed")
    has_key = F.col("_row." + at).isNotNull()
    for name in on:
        has_key &= F.col("_row." + name).isNotNull()
    shown = [F.when(has_key, last[f"_v_{v}"]).alias(v) for v in values]
    return found.select("_row.*", *shown)
