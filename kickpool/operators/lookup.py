"""Matching fixtures with standings, rounds with pages, keys with addresses.

No join here is forced to broadcast except the registry, whose size is fixed. Standings grow
with the number of seasons and teams, so their joins are left to the size checks of the
planner: broadcast below the threshold, shuffled on (scope, key) with skew splitting above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kickpool.functions import fixed_values as fv
from kickpool.functions.labels import dash_if_null
from kickpool.functions.text import name_key, round_digits
from kickpool.operators.positions import with_positions

STANDING_FIELDS = ("rank", "points", "goal_difference")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key in the given order.

    A row_number = 1 filter: Spark limits each key to one row inside every map task before
    it shuffles, so a key holding most of the rows costs no more than any other.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).where("_position = 1").drop("_position")


def first_standing_per_name(
    standings: DataFrame, scope: Sequence[str], order: Sequence[Column | str] = ("rank",)
) -> DataFrame:
    """Lookup side: one standing per (scope, canonical name), the best-ranked first one."""
    keyed = standings.withColumn("name_key", name_key("team_name"))
    return first_per_key(keyed, [*scope, "name_key"], order)


def attach_standings(
    fixtures: DataFrame,
    standings: DataFrame,
    scope: Sequence[str] = (),
    order: Sequence[Column | str] = ("rank",),
    fields: Sequence[str] = STANDING_FIELDS,
) -> DataFrame:
    """Left-join both sides' standings on the canonical name inside the scope.

    Fixture names are replaced by their canonical form. Standing columns arrive with a
    home_/away_ prefix and are NULL where no standing matches.
    """
    lookup = first_standing_per_name(standings, scope, order)
    out = fixtures.withColumns(
        {"home_team": name_key("home_team"), "away_team": name_key("away_team")}
    )
    for side in ("home", "away"):
        columns = [F.col(c).alias(f"{side}_{c}") for c in fields]
        one_side = lookup.select(
            *scope,
            F.col("name_key").alias(f"{side}_team"),
            F.col("team_name").alias(f"{side}_standing_name"),
            *columns,
        )
        out = out.join(one_side, [*scope, f"{side}_team"], "left")
    return out


def source_registry(spark: SparkSession) -> DataFrame:
    """The four registered sources: source_key, url."""
    entries = F.array(
        *(
            F.struct(F.lit(key).alias("source_key"), F.lit(url).alias("url"))
            for key, url in fv.SOURCE_URLS.items()
        )
    )
    return spark.range(1).select(F.inline(entries))


def with_source_url(df: DataFrame) -> DataFrame:
    """Add the address of a source key; rows with an unregistered key fall out.

    Broadcast by hint: the registry is a constant of four rows.
    """
    return df.join(F.broadcast(source_registry(df.sparkSession)), "source_key")


def latest_snapshots(
    pages: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("landed_at",),
    snapshot: str = "snapshot_id",
) -> DataFrame:
    """Last landed page per key: exactly one row, however often it was landed.

    The latest order values win, a missing one is the oldest, and the larger identity breaks a
    tie. The winner is found on narrow columns alone; the planner sends these identities to the
    page bodies while they are few, and moves bodies only beyond its size threshold. A snapshot
    that was landed again, as by a repeated append, is the same page: of its rows the one with the
    latest order values is kept, and only such rows are put in order. Without any, their branch is
    empty and is not read.
    """
    last = [F.col(c).desc_nulls_last() for c in (*order, snapshot)]
    narrow = pages.select(*dict.fromkeys((*keys, *order, snapshot)))
    winners = first_per_key(narrow, keys, last) if keys else narrow.orderBy(*last).limit(1)
    winners = winners.select(snapshot)
    repeated = narrow.groupBy(snapshot).agg(F.count("*").alias("_n")).where("_n > 1").select(snapshot)
    again = winners.join(repeated, snapshot, "left_semi")
    once = pages.join(winners.join(repeated, snapshot, "left_anti"), snapshot, "left_semi")
    several = first_per_key(
        pages.join(again, snapshot, "left_semi"), [snapshot], [F.col(c).desc_nulls_last() for c in order]
    )
    return once.select(*pages.columns).unionByName(several.select(*pages.columns))


def round_pages(rounds: DataFrame, snapshots: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Detail pages of each round: joined on the digits of the round label, inside the scope.

    A missing label counts as the fixed round.
    """
    label = F.coalesce(F.col("round"), F.lit(fv.FALLBACK_DETAIL_ROUND))
    numbered = rounds.withColumn("round", label).withColumn("round_number", round_digits("round"))
    return numbered.join(snapshots, [*scope, "round_number"])


def round_bundles(
    fixtures: DataFrame,
    rounds: DataFrame,
    fields: Sequence[str] = ("match_no", "home_team", "away_team", "kickoff", "venue"),
    per_bundle: int = 1000,
) -> DataFrame:
    """Round header with its fixtures nested in match order.

    A bundle holds at most ``per_bundle`` fixtures of a round by their position in it, so its
    array has a bound, whether match numbers are missing, repeated or far apart; a round of
    ordinary size is one bundle, and a larger one comes as several with increasing bundle_no.
    """
    order = [F.col(c).asc_nulls_first() for c in dict.fromkeys(("match_no", *fields))]
    placed = with_positions(fixtures, ["round"], order)
    nested = (
        placed.withColumn("bundle_no", F.expr(f"position div {int(per_bundle)}"))
        .groupBy("round", "bundle_no")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("fixtures"))
    )
    return nested.join(rounds.select("round", "sales_start", "sales_end"), "round", "left")


def round_label_or_fallback(
    primary: Column, failed: Column, first_match_round: Column
) -> Column:
    """Round to show. Only a *failed* lookup falls back to the first match's round."""
    constant = F.lit(fv.FALLBACK_ROUND_LABEL)
    return F.when(failed, F.coalesce(first_match_round, constant)).otherwise(
        F.coalesce(primary, constant)
    )


def display_inputs(inputs: DataFrame, *keys: str) -> DataFrame:
    """Standing fields as text, a dash for what is missing."""
    shown = [
        dash_if_null(f"{side}_{field}").alias(f"{side}_{field}")
        for side in ("home", "away")
        for field in STANDING_FIELDS
    ]
    return inputs.select(*keys, "home_team", "away_team", *shown)
