"""Best picks and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kickpool.operators.lookup import first_per_key
from kickpool.operators.positions import with_positions
from kickpool.session import fresh_path, written


def best_by_probability(
    predictions: DataFrame, per: Sequence[str] = ("round",), ordinal: Sequence[str] = ("match_no",)
) -> DataFrame:
    """Likeliest prediction per round; of equal ones the first by ``ordinal``, the place a row has
    on its page or in its file where it came from one."""
    return first_per_key(predictions, per, [F.desc("probability"), *ordinal])


def best_by_edge(
    rows: DataFrame, per: Sequence[str] = ("round",), ordinal: Sequence[str] = ("id",)
) -> DataFrame:
    """Largest edge per round, a missing edge counting 0; of equal ones the first by ``ordinal``."""
    edge = F.coalesce(F.col("edge"), F.lit(0))
    return first_per_key(rows, per, [edge.desc(), *ordinal])


def latest_round(rounds: DataFrame, *snapshot: str) -> DataFrame:
    """Current round per snapshot of a flat rounds relation: first open one, else the first."""
    closed = F.when(F.col("status") == "open", 0).otherwise(1)
    return first_per_key(rounds, snapshot, [closed, "pos"])


def rank_by_counts(
    df: DataFrame,
    per: Sequence[str],
    keys: Sequence[str],
    rank: str = "place",
    size: str | None = None,
) -> DataFrame:
    """Competition rank by descending integer keys inside a group, equal keys sharing a place.

    Counting rows per (group, key) comes first and combines map-side; only these counts are
    put in order. With keys from a small range the ordered set stays small however many rows
    a group has, so a group that holds most rows never has to fit one task. ``size`` asks
    for the number of rows in the group as well.
    """
    counts = df.groupBy(*per, *keys).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*per)
    ahead = group.orderBy(*(F.desc(k) for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    added = [(F.coalesce(F.sum("_n").over(ahead), F.lit(0)) + 1).alias(rank)]
    if size:
        added.append(F.sum("_n").over(group).alias(size))
    return df.join(counts.select(*per, *keys, *added), [*per, *keys])


def rank_by_ranges(
    df: DataFrame, per: Sequence[str], key: str, tie: Sequence[str], rank: str = "place"
) -> DataFrame:
    """Competition rank by a descending key of any values, equal keys sharing a place, and the
    ``position`` in the whole order, where ``tie`` decides; a missing key is last.

    For real-valued keys, whose counts would be as many as the rows: positions come from ranges
    of (group, key), so a group that holds most rows is many tasks. An equal key's place is that
    of its first row, found by an aggregation that combines map-side.
    """
    order = [F.desc_nulls_last(key), *(F.col(c).asc_nulls_first() for c in tie)]
    placed = with_positions(df, per, order).withColumn("position", F.col("position") + 1).drop("size")
    first = placed.groupBy(*per, key).agg(F.min("position").alias(rank))
    first = first.select(*(F.col(c).alias(f"_k_{c}") for c in (*per, key)), rank)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*per, key)))
    return placed.join(first, same).select(*df.columns, rank, "position")


def outcome_rows(predictions: DataFrame, *keep: str) -> DataFrame:
    """One row per match and outcome with its probability and edge."""
    sides = (("HOME", "home"), ("DRAW", "draw"), ("AWAY", "away"))
    options = F.array(
        *(
            F.struct(
                F.lit(outcome).alias("outcome"),
                F.col(f"{side}_prob").alias("probability"),
                F.col(f"{side}_edge").alias("edge"),
            )
            for outcome, side in sides
        )
    )
    return predictions.select(*keep, F.inline(options))


def edge_ranking(predictions: DataFrame, per: str = "round", match: str = "match_no") -> DataFrame:
    """All outcomes of a round in order of edge, match and outcome. Those without votes take no part.

    ``place`` is shared by equal edges, ``position`` is the place in the whole order. Edges are
    whole points in -100..100, so a round falls into at most 201 groups that are ordered apart,
    and their places follow from counts. The scored rows are written once, so models and lookups
    behind them are not evaluated for the counts again.
    """
    options = outcome_rows(predictions, per, match).where(F.col("edge").isNotNull())
    options = written(options, fresh_path(options.sparkSession, "edges"))
    ranked = rank_by_counts(options, [per], ["edge"])
    inside = F.row_number().over(Window.partitionBy(per, "edge").orderBy(match, "outcome"))
    return ranked.withColumn("position", F.col("place") + inside - 1)


def row_counts(df: DataFrame, *per: str) -> DataFrame:
    return df.groupBy(*per).agg(F.count("*").alias("row_count"))


def first_value(df: DataFrame, per: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``value`` of the first row per group, combined map-side."""
    first = F.min(F.struct(*order, F.col(value).alias("_value"))).alias("_first")
    return df.groupBy(*per).agg(first).select(*per, F.col("_first._value").alias(f"first_{value}"))


