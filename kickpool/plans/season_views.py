"""Football-shaped views over the given tables.

An order is a game: its first line item names the home side, its last one the away side.
Suppliers are teams, the order year is the season, the order month the round. Every view is
built from whole tables and grows with them; groups are only ever summed or counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kickpool.functions.numbers import half_up
from kickpool.functions.text import round_label

SEASON_GAMES = 38
LEAGUE_PLACES = 20
WEATHER = {
    "1-URGENT": "雨",
    "2-HIGH": "曇り",
    "3-MEDIUM": "晴れ",
    "4-NOT SPECIFIED": "雪",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def games(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with two different sides.

    First and last line item are a min and a max over the columns in use, so duplicate line
    numbers make no difference and line items combine before they are shuffled.
    """
    line = F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    sides = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(line).alias("h"), F.max(line).alias("a"))
        .where("h.l_suppkey <> a.l_suppkey")
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    joined = sides.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def goals(side: str) -> Column:
        return F.floor(F.col(f"{side}.l_quantity") / 17).cast("bigint")

    weather = F.create_map(*(F.lit(x) for pair in WEATHER.items() for x in pair))
    return joined.select(
        F.col("o_orderkey").alias("match_no"),
        F.year("o_orderdate").cast("bigint").alias("season"),
        round_label(F.date_format("o_orderdate", "yyyyMM")).alias("round"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("kickoff"),
        F.col("h.l_suppkey").alias("home_key"),
        F.col("a.l_suppkey").alias("away_key"),
        goals("h").alias("home_goals"),
        goals("a").alias("away_goals"),
        F.col("h.l_discount").alias("home_discount"),
        F.col("a.l_discount").alias("away_discount"),
        F.try_element_at(weather, "o_orderpriority").alias("weather"),
    )


def fixture_name(key: Column | str) -> Column:
    """Name as the fixture list writes it: full-width, and misspelt for every 11th team."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key % 11 == 7, F.format_string("旧 Supplier#%09d", key)).otherwise(
        F.format_string("Ｖ．ＦＣ　Supplier#%09d", key)
    )


def fixtures(games_df: DataFrame) -> DataFrame:
    venue = F.concat(F.lit("Stadium, "), F.col("home_key").cast("string"))
    return games_df.select(
        "season",
        "round",
        "match_no",
        fixture_name("home_key").alias("home_team"),
        fixture_name("away_key").alias("away_team"),
        "kickoff",
        venue.alias("venue"),
    )


def team_seasons(games_df: DataFrame) -> DataFrame:
    """Per season and team: games, points, goals, win rates, scaled to a season of 38 games."""

    def side(me: str, other: str, is_home: int) -> Column:
        return F.struct(
            F.col(f"{me}_key").alias("team_key"),
            F.col(f"{me}_goals").alias("scored"),
            F.col(f"{other}_goals").alias("conceded"),
            F.lit(is_home).alias("is_home"),
        )

    sides = games_df.select(
        "season", F.inline(F.array(side("home", "away", 1), side("away", "home", 0)))
    )
    won = F.when(F.col("scored") > F.col("conceded"), 1).otherwise(0)
    drawn = F.when(F.col("scored") == F.col("conceded"), 1).otherwise(0)
    sums = sides.groupBy("season", "team_key").agg(
        F.count("*").alias("games"),
        F.sum(won * 3 + drawn).alias("won_points"),
        F.sum(F.col("scored") - F.col("conceded")).alias("goal_gap"),
        F.sum("is_home").alias("home_games"),
        F.sum(won * F.col("is_home")).alias("home_wins"),
        F.sum(won * (1 - F.col("is_home"))).alias("away_wins"),
    )

    def scaled(total: str, to: int) -> Column:
        return F.floor(F.col(total) * to / F.col("games")).cast("bigint")

    def rate(wins: str, of: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(wins), of), F.lit(0.0))

    return sums.select(
        "season",
        "team_key",
        scaled("won_points", SEASON_GAMES).alias("points"),
        scaled("goal_gap", SEASON_GAMES).alias("goal_difference"),
        scaled("won_points", 5).alias("form_points"),
        rate("home_wins", F.col("home_games")).alias("home_win_rate"),
        rate("away_wins", F.col("games") - F.col("home_games")).alias("away_win_rate"),
    )


def standings(spark: SparkSession, sf: str, games_df: DataFrame) -> DataFrame:
    """Season standings. The rank, 1 to 20, follows from the scaled points alone."""
    teams = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("team_key"), "s_name")
    rank = LEAGUE_PLACES - F.floor(F.col("points") * LEAGUE_PLACES / (3 * SEASON_GAMES + 1))
    return team_seasons(games_df).join(teams, "team_key").select(
        "season",
        "team_key",
        F.concat(F.lit("V.FC "), "s_name").alias("team_name"),
        rank.cast("bigint").alias("rank"),
        "points",
        "goal_difference",
        "form_points",
        "home_win_rate",
        "away_win_rate",
    )


def votes(games_df: DataFrame) -> DataFrame:
    """Vote shares per match; every seventh match has none."""
    home = half_up(F.lit(30.0) + F.col("home_discount") * 100)
    away = half_up(F.lit(30.0) + F.col("away_discount") * 100)
    voted = F.col("match_no") % 7 != 0
    return games_df.withColumns(
        {"vote_home": F.when(voted, home), "vote_away": F.when(voted, away)}
    ).withColumn("vote_draw", F.lit(100) - F.col("vote_home") - F.col("vote_away"))
