"""Hit checks and backtest aggregates over predictions with known results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kickpool.functions.labels import outcome_from_any
from kickpool.functions.text import as_column

MATCHES_PER_COUPON = 13


def is_hit(pick: Column | str, result: Column | str) -> Column:
    """Pick equals result, whichever vocabulary each is in; NULL without a result."""
    return outcome_from_any(pick) == outcome_from_any(result)


def round_backtest(predictions: DataFrame, per: str = "round") -> DataFrame:
    """Per round: matches with a result, hits, accuracy and mean edge of the picks.

    The counts of picks with a positive edge go along for the overall figures. All of it is
    sums, so a round with very many matches is combined map-side.
    """
    checked = predictions.withColumn("_hit", is_hit("pick", "result_outcome").cast("int"))
    checked = checked.where(F.col("_hit").isNotNull())
    positive = F.when(F.col("pick_edge") > 0, F.lit(1)).otherwise(F.lit(0))
    sums = checked.groupBy(per).agg(
        F.count("*").alias("match_count"),
        F.sum("_hit").alias("hit_count"),
        F.sum("pick_edge").alias("edge_sum"),
        F.sum(positive).alias("positive_count"),
        F.sum(positive * F.col("_hit")).alias("positive_hits"),
    )
    return sums.withColumns(
        {
            "accuracy": as_column("hit_count") / as_column("match_count"),
            "average_edge": as_column("edge_sum") / as_column("match_count"),
        }
    )


def grain_backtest(predictions: DataFrame, grains: Sequence[Sequence[str]]) -> DataFrame:
    """The figures of ``round_backtest`` at several grains in one aggregation.

    A grain is a list of columns, an empty one the total. ``grain`` names its columns, joined by
    ``+`` (``total`` for none); columns outside a grain are NULL. Predictions are summed once for
    each combination of all the columns, map-side first; the grouping sets add up these sums, so
    predictions are neither read nor multiplied again for a further grain.
    """
    columns = list(dict.fromkeys(name for grain in grains for name in grain))
    checked = predictions.withColumn("_hit", is_hit("pick", "result_outcome").cast("int"))
    checked = checked.where(F.col("_hit").isNotNull())
    positive = F.when(F.col("pick_edge") > 0, F.lit(1)).otherwise(F.lit(0))
    parts = checked.groupBy(*columns).agg(
        F.count("*").alias("match_count"),
        F.sum("_hit").alias("hit_count"),
        F.sum("pick_edge").alias("edge_sum"),
        F.sum(positive).alias("positive_count"),
        F.sum(positive * F.col("_hit")).alias("positive_hits"),
    )
    grouped = parts.groupingSets([[F.col(c) for c in grain] for grain in grains], *columns)
    sums = grouped.agg(
        F.grouping_id().alias("_set"),
        *(F.sum(c).alias(c) for c in ("match_count", "hit_count", "edge_sum", "positive_count", "positive_hits")),
    )
    name = F.lit(None).cast("string")
    for grain in grains:  # a bit of the set is 1 where a column, the first in the highest bit, is left out
        bits = sum((column not in grain) << i for i, column in enumerate(reversed(columns)))
        name = F.when(F.col("_set") == bits, "+".join(grain) or "total").otherwise(name)
    return sums.where("match_count > 0").select(
        name.alias("grain"), *columns, "match_count", "hit_count", "edge_sum", "positive_count", "positive_hits",
        (F.col("hit_count") / F.col("match_count")).alias("accuracy"),
        (F.col("edge_sum") / F.col("match_count")).alias("average_edge"),
        F.try_divide("positive_hits", "positive_count").alias("positive_hit_rate"),
    )


def overall_backtest(rounds: DataFrame, *per: str) -> DataFrame:
    """Figures over all rounds: hit rate, mean hits per 13 matches, best round, positive edges."""
    hits, matches = F.sum("hit_count"), F.sum("match_count")
    return rounds.groupBy(*per).agg(
        F.count("*").alias("round_count"),
        matches.alias("match_count"),
        hits.alias("hit_count"),
        (hits / matches).alias("hit_rate"),
        (hits * MATCHES_PER_COUPON / matches).alias("mean_hits_per_13"),
        F.max("hit_count").alias("best_hits"),
        F.try_divide(F.sum("positive_hits"), F.sum("positive_count")).alias("positive_hit_rate"),
    )
