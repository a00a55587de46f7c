"""Landed pages rendered from the given tables: detail, standings and schedule pages.

Each page covers one block of keys, so the rows put together on a page have a bound.
Some rows leave out end tags, as real pages do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kickpool.functions.labels import signed
from kickpool.plans.season_views import fixture_name

MATCHES_PER_BLOCK = 1000
TEAMS_PER_BLOCK = 40
ORDERS_PER_BLOCK = 100
MENU = "<table><tr><td>menu<td>&nbsp;</table>"


def block_of(key: str, size: int) -> Column:
    return F.floor(F.col(key) / size).cast("bigint")


def joined_rows(order: str, html: str) -> Column:
    """Row markup of a group in key order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct(order, html)))
    return F.array_join(F.transform(rows, lambda r: r[html]), "\n")


def cell(content: Column, close: Column) -> Column:
    return F.concat(F.lit("<td>"), content, F.when(close, F.lit("</td>")).otherwise(F.lit("")))


def fixture_cells(games: DataFrame) -> DataFrame:
    """The seven texts of a fixture row. Every 13th match is unplayed and has no result."""
    unplayed = F.col("match_no") % 13 == 0
    mark = F.when(F.col("home_goals") > F.col("away_goals"), "1").when(
        F.col("home_goals") == F.col("away_goals"), "0"
    )
    score = F.concat_ws("-", "home_goals", "away_goals")
    return games.select(
        F.substring("round", 2, 6).alias("round_number"),
        "round",
        "season",
        "match_no",
        F.col("kickoff").alias("date"),
        F.concat(F.lit("Stadium & Park "), F.col("home_key").cast("string")).alias("venue"),
        F.col("match_no").cast("string").alias("number"),
        fixture_name("home_key").alias("home"),
        F.when(unplayed, "").otherwise(score).alias("result"),
        fixture_name("away_key").alias("away"),
        F.when(F.col("match_no") % 26 == 0, "").otherwise(mark.otherwise("2")).alias("pool"),
    )


def detail_pages(games: DataFrame) -> DataFrame:
    """Fixture pages: snapshot_id, season, round, round_number, html."""
    rows = fixture_cells(games).withColumn("block", block_of("match_no", MATCHES_PER_BLOCK))
    tidy = F.col("match_no") % 2 == 0
    texts = ("date", "venue", "number", "home", "result", "away", "pool")
    cells = [cell(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), tidy) for c in texts]
    row = F.concat(F.lit("<tr>"), *cells, F.when(tidy, F.lit("</tr>")).otherwise(F.lit("")))
    grouped = (
        rows.select("season", "round", "round_number", "block", "match_no", row.alias("row"))
        .groupBy("season", "round", "round_number", "block")
        .agg(joined_rows("match_no", "row").alias("body"))
    )
    head = "<table><thead><tr><th>date<th>venue<th>no<th>home<th>result<th>away<th>pool</thead><tbody>"
    return grouped.select(
        F.concat_ws("-", "round_number", "block").alias("snapshot_id"),
        "season",
        "round",
        "round_number",
        F.concat(
            F.lit("<html><head><title>"),
            "round",
            F.lit(f"</title></head><body>{MENU}<p>{MENU}{head}"),
            "body",
            F.lit("</tbody></table></body></html>"),
        ).alias("html"),
    )


def standings_pages(standings: DataFrame) -> DataFrame:
    """Standings pages: season, block, html. Team names stand in a span, a link or the cell."""
    name = F.col("team_name")
    kind = F.col("team_key") % 3
    team = (
        F.when(kind == 0, F.concat(F.lit('<a href="/club"><i></i><span>'), name, F.lit("</span></a> x")))
        .when(kind == 1, F.concat(F.lit('<a href="/club">'), name, F.lit("</a> x")))
        .otherwise(name)
    )
    filler = "".join(f"<td>{i}" for i in range(4, 11))
    row = F.concat(
        F.lit("<tr><td></td><td>"),
        F.col("rank").cast("string"),
        F.lit("位</td><td>"),
        team,
        F.lit("</td><th> "),
        F.col("points").cast("string"),
        F.lit(f" pt</th>{filler}<td>"),
        signed("goal_difference"),
    )
    grouped = (
        standings.select(
            "season", block_of("team_key", TEAMS_PER_BLOCK).alias("block"), "team_key", row.alias("row")
        )
        .groupBy("season", "block")
        .agg(joined_rows("team_key", "row").alias("body"))
    )
    html = F.concat(F.lit(f"<body>{MENU}<div><table>"), "body", F.lit("</table></div>"))
    return grouped.select("season", "block", html.alias("html"))


def schedule_pages(orders: DataFrame) -> DataFrame:
    """Schedule pages: one per block of orders, listing the months that occur in it."""
    months = orders.select(
        block_of("o_orderkey", ORDERS_PER_BLOCK).alias("page_no"),
        F.date_trunc("month", "o_orderdate").alias("month"),
    )
    return month_schedules(months, "page_no")


def month_schedules(months: DataFrame, page: str) -> DataFrame:
    """One schedule page for each value of ``page``, listing its distinct months in order."""
    months = months.select(page, "month").distinct()
    number = F.month("month") % 4
    status = F.when(number == 1, "<b>終了</b>").when(number == 2, "<i>販売中</i>&nbsp;").otherwise("")
    entry = F.concat(
        F.lit("<li>"),
        status,
        F.date_format("month", "'第'yyyyMM'回'　"),
        F.date_format("month", "（yyyy/M/1-"),
        F.date_format(F.last_day("month"), "yyyy/M/d）</'li'>"),
    )
    grouped = (
        months.withColumn("entry", entry)
        .groupBy(page)
        .agg(joined_rows("month", "entry").alias("body"))
    )
    html = F.concat(
        F.lit("<script>var s = '第999999回';</script><ul>"), "body", F.lit("</ul>")
    )
    return grouped.select(page, html.alias("html"))
