"""Registered queries over HTML tables on rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.functions.text import round_digits
from kickpool.operators import html_tables, lookup
from kickpool.plans import season_views as views
from kickpool.plans.oracle_parts import with_parts
from kickpool.plans.registry import query
from kickpool.plans.rendered_pages import detail_pages, standings_pages

HEAD = ("date", "venue", "no", "home", "result", "away", "pool")
PLAYED_WORD = "2-0"


def rendered_details(spark: SparkSession, sf: str) -> DataFrame:
    return detail_pages(views.games(spark, sf))


def rendered_standings(spark: SparkSession, sf: str) -> DataFrame:
    return standings_pages(views.standings(spark, sf, views.games(spark, sf)))


_HEAD_LIST = "list_value(" + ", ".join(f"'{h}'" for h in HEAD) + ")"
_PAGES = "SELECT DISTINCT snapshot_id FROM cells"
_ALL_ROWS = f"""
SELECT snapshot_id, 0 AS table_idx, 0 AS row_idx, 0 AS page_row_idx, list_value('menu', '') AS t
FROM ({_PAGES}) UNION ALL
SELECT snapshot_id, 1, 0, 1, list_value('menu', '') FROM ({_PAGES}) UNION ALL
SELECT snapshot_id, 2, NULL, 2, {_HEAD_LIST} FROM ({_PAGES}) UNION ALL
SELECT snapshot_id, 2, row_idx, row_idx + 3, t FROM cells"""


@query(
    "html_cells",
    with_parts(
        "cells",
        f"""SELECT snapshot_id, CAST(table_idx AS BIGINT) AS table_idx,
  CAST(row_idx AS BIGINT) AS row_idx, CAST(page_row_idx AS BIGINT) AS page_row_idx,
  CAST(i - 1 AS BIGINT) AS cell_idx, t[i] AS text
FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM ({_ALL_ROWS}))""",
    ),
)
def html_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = html_tables.table_cells(rendered_details(spark, sf), "snapshot_id")
    return cells.select("snapshot_id", "table_idx", "row_idx", "page_row_idx", "cell_idx", "text")


_FILLED = "SELECT *, list_filter(t, lambda x: x <> '') AS f FROM cells"


@query(
    "html_results",
    with_parts(
        "cells",
        f"""SELECT snapshot_id, CAST(row_idx AS BIGINT) AS row_idx, f[1] AS date, f[2] AS venue,
  f[3] AS match_no, f[4] AS home_team, f[5] AS result, f[6] AS away_team, f[7] AS pool_result
FROM ({_FILLED}) WHERE len(f) >= 6""",
    ),
)
def html_results(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables.extract_results(rendered_details(spark, sf), "snapshot_id")


@query(
    "html_fixtures",
    with_parts(
        "cells",
        f"""SELECT snapshot_id, CAST(row_idx AS BIGINT) AS row_idx,
  CAST(match_no AS DOUBLE) AS match_no, replace(f[4], ' ', '') AS home_team,
  replace(f[6], ' ', '') AS away_team, f[1] AS kickoff, f[2] AS venue
FROM ({_FILLED}) WHERE len(f) >= 6 AND match_no <> 0""",
    ),
)
def html_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables.extract_fixtures(rendered_details(spark, sf), "snapshot_id")


@query(
    "html_standings",
    with_parts(
        "standings",
        """SELECT season, CAST(1 AS BIGINT) AS table_idx, team_key // 40 AS block,
  row_number() OVER (PARTITION BY season, team_key // 40 ORDER BY team_key) - 1 AS row_idx,
  rank, replace(team_name, ' ', '') AS team_name, points, goal_difference FROM standings""",
    ),
)
def html_standings(spark: SparkSession, sf: str) -> DataFrame:
    found = html_tables.extract_standings(rendered_standings(spark, sf), "season", "block")
    return html_tables.sort_standings(found, "season", "block")


_ROW_TEXT = "array_to_string(t, '')"


@query(
    "html_table_preview",
    with_parts(
        "cells",
        f"""SELECT snapshot_id, CAST(table_idx AS BIGINT) AS table_idx,
  CAST(row_count AS BIGINT) AS row_count, CAST(length(text) AS BIGINT) AS text_length,
  substring(text, 1, 300) AS preview
FROM (SELECT snapshot_id, 0 AS table_idx, 1 AS row_count, 'menu' AS text FROM ({_PAGES})
      UNION ALL SELECT snapshot_id, 1, 1, 'menu' FROM ({_PAGES})
      UNION ALL SELECT snapshot_id, 2, count(*) + 1, '{"".join(HEAD)}' ||
        string_agg({_ROW_TEXT}, ' ' ORDER BY row_idx)
      FROM cells GROUP BY snapshot_id)""",
    ),
)
def html_table_preview(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables.table_previews(rendered_details(spark, sf), "snapshot_id")


@query(
    "html_row_dump",
    with_parts(
        "cells",
        f"""SELECT snapshot_id, CAST(page_row_idx AS BIGINT) AS page_row_idx, row_text,
  CAST(i - 1 AS BIGINT) AS cell_idx, t[i] AS text,
  replace(replace(t[i], '&', '&amp;'), 'ＦＣ ', 'ＦＣ　')
    || CASE WHEN i = 7 AND open_row THEN chr(10) ELSE '' END AS html
FROM (SELECT *, unnest(range(1, 8)) AS i FROM (SELECT snapshot_id, row_idx + 3 AS page_row_idx, t,
        {_ROW_TEXT} AS row_text, match_no % 2 = 1 AND row_idx < max(row_idx)
          OVER (PARTITION BY snapshot_id) AS open_row FROM cells)
      WHERE contains(row_text, '{PLAYED_WORD}'))""",
    ),
)
def html_row_dump(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables.rows_with_keyword(rendered_details(spark, sf), PLAYED_WORD, "snapshot_id")


_FIXTURE_TEXT = (
    "CAST(match_no AS VARCHAR) || ':' || home_key || ':' || away_key"
)


@query(
    "round_bundle",
    with_parts(
        "games",
        f"""SELECT round, substr(round, 2, 6) AS round_digits,
  bundle_no,
  any_value(CASE WHEN round NOT LIKE '%06回' THEN substr(round, 2, 4) || '/'
    || CAST(CAST(substr(round, 6, 2) AS INT) AS VARCHAR) || '/1' END) AS sales_start,
  count(*) AS fixture_count,
  string_agg({_FIXTURE_TEXT}, ' ' ORDER BY match_no) AS fixtures
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY round ORDER BY match_no) - 1) // 1000 AS BIGINT) AS bundle_no
      FROM games) GROUP BY round, bundle_no""",
    ),
)
def round_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Fixtures nested under their round; June rounds are missing from the schedule."""
    games = views.games(spark, sf)
    fixtures = games.select("round", "match_no", "home_key", "away_key")
    months = views.table(spark, sf, "orders").select(
        F.date_trunc("month", "o_orderdate").alias("m")
    ).distinct().where(F.month("m") != 6)
    rounds = months.select(
        F.date_format("m", "'第'yyyyMM'回'").alias("round"),
        F.date_format("m", "yyyy/M/1").alias("sales_start"),
        F.date_format(F.last_day("m"), "yyyy/M/d").alias("sales_end"),
    )
    bundles = lookup.round_bundles(fixtures, rounds, ("match_no", "home_key", "away_key"))
    texts = F.transform("fixtures", lambda f: F.concat_ws(":", f.match_no, f.home_key, f.away_key))
    return bundles.select(
        "round",
        round_digits("round").alias("round_digits"),
        "bundle_no",
        "sales_start",
        F.size("fixtures").cast("bigint").alias("fixture_count"),
        F.array_join(texts, " ").alias("fixtures"),
    )
