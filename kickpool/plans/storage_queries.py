"""Registered queries: scans, upserts, defaults, constraints, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kickpool.functions import fixed_values as fv
from kickpool.operators import constraints, lookup, ranking, upsert
from kickpool.plans import season_views as views
from kickpool.plans.oracle_parts import with_parts
from kickpool.plans.registry import query
from kickpool.session import fresh_path
from kickpool.sources.tables import query_table, scan

KEY = ["round", "match_no"]


@query(
    "table_scan",
    "SELECT o_orderkey, o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS season FROM orders "
    "WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
)
def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan(
        spark,
        f"{sf}/orders.parquet",
        ("o_orderkey", "o_orderpriority", "year(o_orderdate) AS season"),
        "o_orderstatus = 'F' AND o_totalprice > 200000",
    )


@query(
    "table_query",
    """SELECT o_orderkey, o_orderpriority AS priority, o_totalprice FROM orders
WHERE o_orderstatus <> 'O' AND o_totalprice >= 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND NOT o_orderpriority LIKE '2%' AND o_orderdate IS NOT NULL""",
)
def table_query(spark: SparkSession, sf: str) -> DataFrame:
    """The scan as a client asks for it, by a query string."""
    asked = "select=o_orderkey,priority:o_orderpriority,o_totalprice&o_orderstatus=neq.O&o_totalprice=gte.150000"
    asked += "&o_orderpriority=in.(1-URGENT,2-HIGH)&o_orderpriority=not.like.2*&o_orderdate=not.is.null"
    return query_table(spark, f"{sf}/orders.parquet", asked)


def stored_matches(games: DataFrame) -> DataFrame:
    """What the table holds: two thirds of the games."""
    return games.where(F.col("match_no") % 3 != 0).select(
        "round",
        "match_no",
        F.concat(F.lit("Stadium "), F.col("home_key").cast("string")).alias("venue"),
        "weather",
        F.lit(3).cast("bigint").alias("home_rest_days"),
        F.col("home_goals").alias("vote_home"),
    )


def new_matches(games: DataFrame) -> DataFrame:
    """What arrives: two thirds again, without weather and rest days, some votes empty."""
    return games.where(F.col("match_no") % 3 != 1).select(
        "round",
        "match_no",
        F.concat(F.lit("Arena "), F.col("away_key").cast("string")).alias("venue"),
        F.when(F.col("match_no") % 5 != 0, F.col("away_goals")).alias("vote_home"),
    )


def upsert_sql(round_sql: str) -> str:
    return with_parts(
        "games",
        f"""SELECT {round_sql} AS round, match_no,
  CASE WHEN match_no % 3 = 1 THEN 'Stadium ' || home_key ELSE 'Arena ' || away_key END AS venue,
  CASE WHEN match_no % 3 = 0 THEN '{fv.WEATHER_UNKNOWN}' ELSE weather END AS weather,
  CASE WHEN match_no % 3 = 0 THEN CAST(5 AS BIGINT) ELSE 3 END AS home_rest_days,
  CASE WHEN match_no % 3 = 1 THEN home_goals WHEN match_no % 5 <> 0 THEN away_goals END AS vote_home
FROM games""",
    )


_UPSERT = upsert_sql("round")


@query("upsert_matches", _UPSERT)
def upsert_matches(spark: SparkSession, sf: str) -> DataFrame:
    games = views.games(spark, sf)
    return upsert.merge_rows(
        stored_matches(games), new_matches(games), KEY, upsert.MATCH_DEFAULTS
    )


@query("upsert_table", _UPSERT)
def upsert_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same upsert into a stored table partitioned by round, then read back."""
    games = views.games(spark, sf)
    path = fresh_path(spark, "matches")
    stored_matches(games).hint("rebalance", "round").write.partitionBy("round").parquet(path)
    upsert.upsert_table(path, new_matches(games), KEY, "round", upsert.MATCH_DEFAULTS)
    return spark.read.parquet(path)


_TEXT_ROUND = "CASE match_no % 4 WHEN 0 THEN '01' WHEN 1 THEN '1' WHEN 2 THEN '1e3' ELSE '2024-01-01' END"


@query("upsert_text_rounds", upsert_sql(_TEXT_ROUND))
def upsert_text_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same upsert with rounds whose texts look like numbers and dates."""
    games = views.games(spark, sf).withColumn("round", F.expr(_TEXT_ROUND))
    path = fresh_path(spark, "matches")
    stored_matches(games).hint("rebalance", "round").write.partitionBy("round").parquet(path)
    upsert.upsert_table(path, new_matches(games), KEY, "round", upsert.MATCH_DEFAULTS)
    return upsert.stored_table(spark, path, partitions={"round": T.StringType()})


@query(
    "column_defaults",
    with_parts(
        "games",
        f"""SELECT match_no, weather, CAST(5 AS BIGINT) AS home_rest_days,
  CAST(5 AS BIGINT) AS away_rest_days, CAST(0 AS BIGINT) AS home_injury_level,
  CAST(0 AS BIGINT) AS away_injury_level, 'draft' AS status,
  'rule-v0.1' AS model_version, '[]' AS reasons FROM games""",
    ),
)
def column_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Weather is a column of the rows, so its NULLs stay; the others are absent."""
    rows = views.games(spark, sf).select("match_no", "weather")
    for defaults in (upsert.MATCH_DEFAULTS, upsert.ROUND_DEFAULTS, upsert.PREDICTION_DEFAULTS):
        rows = upsert.with_column_defaults(rows, defaults)
    return rows


def flawed_matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Matches with missing names, unknown outcomes and repeated keys; rounds without June."""
    games = views.games(spark, sf)
    number = F.col("match_no")
    rows = games.select(
        "round",
        F.when(number % 97 == 0, number + 1).otherwise(number).alias("match_no"),
        F.when(number % 50 != 0, views.fixture_name("home_key")).alias("home_team"),
        views.fixture_name("away_key").alias("away_team"),
        F.when(number % 40 == 0, "lost").when(number % 3 == 0, "home").alias("result_outcome"),
    )
    rounds = games.select("round").distinct().where(~F.col("round").endswith("06回"))
    return rows, rounds


@query(
    "constraint_violations",
    with_parts(
        "games",
        """, flawed AS (SELECT round, CASE WHEN match_no % 97 = 0 THEN match_no + 1 ELSE match_no END
    AS no, match_no % 50 = 0 AS unnamed, match_no % 40 = 0 AS lost FROM games)
SELECT 'matches' AS table_name, rule, round || '|' || CAST(no AS VARCHAR) AS row_key,
  CAST(n AS BIGINT) AS row_count FROM (
  SELECT 'not_null:home_team' AS rule, round, no, 1 AS n FROM flawed WHERE unnamed
  UNION ALL SELECT 'allowed:result_outcome', round, no, 1 FROM flawed WHERE lost
  UNION ALL SELECT 'unique:round,match_no', round, no, count(*) FROM flawed GROUP BY round, no
    HAVING count(*) > 1
  UNION ALL SELECT 'reference:round', round, no, 1 FROM flawed WHERE round LIKE '%06回')""",
    ),
)
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows, rounds = flawed_matches(spark, sf)
    allowed = {"result_outcome": list(fv.OUTCOME_KEY.values())}
    return constraints.violations(
        constraints.row_violations(
            rows, "matches", KEY, ["round", "home_team", "away_team"], allowed, {("round",): rounds}
        ),
        constraints.unique_violations(rows, "matches", KEY),
    )


@query(
    "orphans_cascade",
    with_parts(
        "games",
        "SELECT match_no, round LIKE '%06回' AS orphan FROM games",
    ),
)
def orphans_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Matches whose round is gone, and those that survive deleting these rounds."""
    games = views.games(spark, sf).select("match_no", "round")
    rounds = games.select("round").distinct().where(~F.col("round").endswith("06回"))
    lost = constraints.orphans(games, rounds, ["round"]).withColumn("orphan", F.lit(True))
    kept = constraints.cascade_delete(games, rounds, ["round"]).withColumn("orphan", F.lit(False))
    return lost.unionByName(kept).select("match_no", "orphan")


@query(
    "round_fallback",
    with_parts(
        "games",
        f"""SELECT season, CASE WHEN season % 3 = 0 THEN coalesce(first_round, '{fv.FALLBACK_ROUND_LABEL}')
  WHEN season % 3 = 1 THEN '{fv.FALLBACK_ROUND_LABEL}' ELSE last_round END AS round_label
FROM (SELECT season, arg_min(round, match_no) AS first_round, max(round) AS last_round
      FROM games GROUP BY season)""",
    ),
)
def round_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Per season: the schedule lookup failed, found nothing, or found the last round."""
    games = views.games(spark, sf).select("season", "match_no", "round")
    first = ranking.first_value(games, ["season"], ["match_no"], "round")
    last = games.groupBy("season").agg(F.max("round").alias("last_round"))
    kind = F.col("season") % 3
    label = lookup.round_label_or_fallback(
        F.when(kind != 1, F.col("last_round")), kind == 0, F.col("first_round")
    )
    return first.join(last, "season").select("season", label.alias("round_label"))


@query(
    "row_counts",
    with_parts("games", "SELECT round, count(*) AS row_count FROM games GROUP BY round"),
)
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.row_counts(views.games(spark, sf), "round")
