"""Projections from raw CSV rows to typed matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kickpool.functions import fixed_values as fv
from kickpool.functions.numbers import nullable_numbers, number_or, number_text
from kickpool.functions.text import empty_or_null_to, empty_to_null, null_to, slug

DEFAULT_LEAGUE = "J1"
DEFAULT_TEMPERATURE = 25.0
DEFAULT_WIND_SPEED = 3.0
UNUSED_STATS = ("points", "wins", "draws", "losses", "goals_for", "goals_against")


def _team(side: str) -> Column:
    short_name = F.col(f"{side}ShortName")
    return F.struct(
        F.col(f"_{side}_id").alias("id"),
        short_name.alias("name"),
        short_name.alias("short_name"),
        F.lit(DEFAULT_LEAGUE).alias("league"),
    )


def _stats(side: str) -> Column:
    """Stats struct. The home side keeps only its home win rate, the away side only its away one."""
    rate = number_or(f"{side}WinRate")
    zero = F.lit(0.0)
    return F.struct(
        F.col(f"_{side}_id").alias("team_id"),
        number_or(f"{side}Rank").alias("rank"),
        *(zero.alias(name) for name in UNUSED_STATS),
        number_or(f"{side}GoalDiff").alias("goal_difference"),
        (rate if side == "home" else zero).alias("home_win_rate"),
        (rate if side == "away" else zero).alias("away_win_rate"),
        number_or(f"{side}RecentPoints").alias("recent_form_points"),
    )


def vote_struct(home: str, draw: str, away: str) -> Column:
    """Votes as a struct when all three are there; empty text is there and counts 0."""
    present = F.col(home).isNotNull() & F.col(draw).isNotNull() & F.col(away).isNotNull()
    votes = F.struct(
        number_or(home).alias("home"), number_or(draw).alias("draw"), number_or(away).alias("away")
    )
    return F.when(present, votes)


def normalize_matches(raw: DataFrame) -> DataFrame:
    """Raw text rows to nested matches. What is used more than once is computed first."""
    raw = raw.withColumns(
        {
            "_number": number_or("matchNo"),
            "_home_id": slug("homeShortName"),
            "_away_id": slug("awayShortName"),
        }
    )
    weather = F.struct(
        null_to("weather", fv.WEATHER_UNKNOWN).alias("condition"),
        F.lit(DEFAULT_TEMPERATURE).alias("temperature"),
        F.lit(DEFAULT_WIND_SPEED).alias("wind_speed"),
    )
    return raw.select(
        F.concat_ws("-", "totoRound", number_text("_number")).alias("id"),
        F.col("totoRound").alias("round"),
        F.col("_number").alias("match_no"),
        F.col("kickoffAt").alias("kickoff"),
        "venue",
        _team("home").alias("home_team"),
        _team("away").alias("away_team"),
        _stats("home").alias("home_stats"),
        _stats("away").alias("away_stats"),
        weather.alias("weather"),
        vote_struct("voteHome", "voteDraw", "voteAway").alias("votes"),
    )


def model_a_inputs(matches: DataFrame) -> DataFrame:
    """Nested matches to the flat columns model A reads."""
    return matches.select(
        "id",
        "round",
        "match_no",
        F.col("home_team.short_name").alias("home_short_name"),
        F.col("away_team.short_name").alias("away_short_name"),
        *(
            F.col(f"{side}_stats.{field}").alias(f"{side}_{name}")
            for side in ("home", "away")
            for field, name in (
                ("rank", "rank"),
                ("recent_form_points", "form_points"),
                ("goal_difference", "goal_difference"),
            )
        ),
        F.col("home_stats.home_win_rate").alias("home_home_win_rate"),
        F.col("away_stats.away_win_rate").alias("away_away_win_rate"),
        F.col("weather.condition").alias("weather"),
        *(F.col(f"votes.{side}").alias(f"vote_{side}") for side in ("home", "draw", "away")),
    )


# How each import column is read: text as it is, empty text as NULL, or a nullable number.
TEXT_AS_IS = ("round_no", "home_team", "away_team")
EMPTY_AS_NULL = ("kickoff", "league", "venue", "home_last5", "away_last5")
NUMBERS = [c for c in fv.IMPORT_COLUMNS if c not in (*TEXT_AS_IS, *EMPTY_AS_NULL, "weather")]


def import_column(name: str) -> Column:
    if name in TEXT_AS_IS:
        return F.col(name)
    if name == "weather":
        return empty_or_null_to(name, fv.WEATHER_UNKNOWN).alias(name)
    if name in EMPTY_AS_NULL:
        return empty_to_null(name).alias(name)
    return F.get("_numbers", F.lit(NUMBERS.index(name))).alias(name)


def import_projection(rows: DataFrame) -> DataFrame:
    """The 27 import columns, typed. The numbers are read as one array."""
    rows = rows.withColumn("_numbers", nullable_numbers(F.array(*NUMBERS)))
    return rows.select(*(import_column(name) for name in fv.IMPORT_COLUMNS))


def imported_rounds(matches: DataFrame) -> DataFrame:
    """A round row for every round that occurs in the imported matches."""
    rounds = matches.select("round_no").distinct()
    return rounds.select(
        "round_no",
        F.concat(F.col("round_no"), F.lit(" toto")).alias("title"),
        F.lit("imported").alias("status"),
    )
