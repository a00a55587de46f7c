"""Registered queries: fixture lookup, both models, best picks, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.functions import fixed_values as fv, labels
from kickpool.functions.text import name_key, remove_ws
from kickpool.operators import lookup, ranking, scoring
from kickpool.operators.positions import last_before
from kickpool.plans import jobs, season_views as views
from kickpool.plans.jobs import best_picks, predict_pages
from kickpool.plans.oracle_parts import OUTCOME_LABEL_SQL, with_parts, rounded
from kickpool.plans.registry import query
from kickpool.plans.rendered_pages import detail_pages, month_schedules, standings_pages

A_FIELDS = ("rank", "goal_difference", "form_points", "home_win_rate", "away_win_rate")


def model_b_inputs(spark: SparkSession, sf: str) -> DataFrame:
    games = views.games(spark, sf)
    standings = views.standings(spark, sf, games)
    return lookup.attach_standings(
        views.fixtures(games), standings, ["season"], order=["rank", "team_key"]
    )


def model_b(spark: SparkSession, sf: str, explain: bool = False) -> DataFrame:
    return scoring.predict_model_b(model_b_inputs(spark, sf), explain)


def model_a_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """All matches with votes and weather; what a side without a standing lacks counts 0."""
    games = views.votes(views.games(spark, sf))
    listed = games.withColumns(
        {
            "home_team": views.fixture_name("home_key"),
            "away_team": views.fixture_name("away_key"),
        }
    )
    standings = views.standings(spark, sf, games)
    found = lookup.attach_standings(
        listed, standings, ["season"], ["rank", "team_key"], fields=A_FIELDS
    )
    absent = {
        name: F.coalesce(F.col(name), F.lit(0))
        for name in (f"{side}_{field}" for side in ("home", "away") for field in A_FIELDS)
    }
    return found.withColumns(
        {**absent, "home_short_name": F.col("home_team"), "away_short_name": F.col("away_team")}
    )


def model_a(spark: SparkSession, sf: str, explain: bool = False) -> DataFrame:
    return scoring.predict_model_a(model_a_inputs(spark, sf), explain)


B_COLUMNS = (
    "season", "round", "match_no", "home_team", "away_team", "outcome", "probability",
    "confidence", "total_score",
)
B_LIST = ", ".join(B_COLUMNS)


@query("model_b_predictions", with_parts("model_b", f"SELECT {B_LIST} FROM model_b"))
def model_b_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return model_b(spark, sf).select(*B_COLUMNS)


def _b_rows() -> str:
    def line(no: int, texts: tuple, score: str) -> str:
        label, home, away = texts
        return (
            f"SELECT match_no, {no} AS factor_no, '{label}' AS label, "
            f"CAST({rounded(score)} AS DOUBLE) AS score, CASE WHEN {score} >= 0 "
            f"THEN home_standing_name || '{home}' ELSE away_standing_name || '{away}' END "
            "AS description FROM model_b WHERE matched"
        )

    label, text = fv.B_VENUE
    parts = [
        line(0, fv.B_RANK, "f_rank"),
        line(1, fv.B_POINTS, "f_points"),
        line(2, fv.B_GOALS, "f_goals"),
        f"SELECT match_no, 3, '{label}', 5.0::DOUBLE, home_standing_name || '{text}' "
        "FROM model_b WHERE matched",
    ]
    parts += [
        f"SELECT match_no, {i}, '{label}', 0.0::DOUBLE, '{text}' FROM model_b WHERE NOT matched"
        for i, (label, text) in enumerate(fv.B_UNMATCHED)
    ]
    rows = " UNION ALL ".join(parts)
    return (
        "SELECT match_no, CAST(factor_no AS BIGINT) AS factor_no, label, score, "
        "CASE WHEN score >= 0 THEN '+' ELSE '' END || CAST(CAST(score AS BIGINT) AS VARCHAR) "
        f"AS shown, description FROM ({rows})"
    )


@query("model_b_factors", with_parts("model_b", _b_rows()))
def model_b_factors(spark: SparkSession, sf: str) -> DataFrame:
    factors = model_b(spark, sf, explain=True).select(
        "match_no", F.posexplode("factors").alias("factor_no", "f")
    )
    return factors.select("match_no", "factor_no", "f.*").select(
        "match_no",
        "factor_no",
        "label",
        "score",
        labels.signed(F.col("score").cast("bigint")).alias("shown"),
        "description",
    )


@query(
    "model_b_unmatched",
    with_parts(
        "model_b",
        "SELECT match_no, home_team, away_team, home_rank IS NULL AS home_missing, "
        "away_rank IS NULL AS away_missing, outcome, probability, confidence, total_score "
        "FROM model_b WHERE NOT matched",
    ),
)
def model_b_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return model_b(spark, sf).where(~F.col("matched")).select(
        "match_no",
        "home_team",
        "away_team",
        F.col("home_rank").isNull().alias("home_missing"),
        F.col("away_rank").isNull().alias("away_missing"),
        "outcome",
        "probability",
        "confidence",
        "total_score",
    )


_INPUT_TEXT = ", ".join(
    f"coalesce(CAST({s}_{f} AS VARCHAR), '-') AS {s}_{f}"
    for s in ("home", "away")
    for f in lookup.STANDING_FIELDS
)


@query(
    "prediction_inputs",
    with_parts("inputs", f"SELECT match_no, home_team, away_team, {_INPUT_TEXT} FROM inputs"),
)
def prediction_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.display_inputs(model_b_inputs(spark, sf), "match_no")


@query(
    "first_standing",
    with_parts(
        "standings",
        "SELECT season, name_key, rank, points FROM (SELECT season, "
        "'V.FCSupplier#' || lpad(CAST(team_key // 3 AS VARCHAR), 9, '0') AS name_key, rank, "
        "points, row_number() OVER (PARTITION BY season, team_key // 3 ORDER BY rank, team_key) "
        "AS n FROM standings) WHERE n = 1",
    ),
)
def first_standing(spark: SparkSession, sf: str) -> DataFrame:
    """Three teams share each name here; the best-ranked one is the one a lookup finds."""
    standings = views.standings(spark, sf, views.games(spark, sf))
    shared = F.format_string("Ｖ．FC Supplier#%09d", F.floor(F.col("team_key") / 3))
    first = lookup.first_standing_per_name(
        standings.withColumn("team_name", shared), ["season"], ["rank", "team_key"]
    )
    return first.select("season", "name_key", "rank", "points")


@query(
    "best_pick_by_probability",
    with_parts(
        "model_b",
        "SELECT round, match_no, home_team, away_team, outcome, outcome_label, probability, "
        f"confidence FROM (SELECT *, {OUTCOME_LABEL_SQL} AS outcome_label, row_number() OVER "
        "(PARTITION BY round ORDER BY probability DESC, match_no) AS n FROM model_b) WHERE n = 1",
    ),
)
def best_pick_by_probability(spark: SparkSession, sf: str) -> DataFrame:
    best = ranking.best_by_probability(model_b(spark, sf))
    return best.select(
        "round",
        "match_no",
        "home_team",
        "away_team",
        "outcome",
        labels.outcome_label("outcome").alias("outcome_label"),
        "probability",
        "confidence",
    )


# --------------------------------------------------------------------------------- model A

A_COLUMNS = ("match_no", "home_prob", "draw_prob", "away_prob", "pick", "confidence")


@query("model_a_probabilities", with_parts("model_a", f"SELECT {', '.join(A_COLUMNS)} FROM model_a"))
def model_a_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return model_a(spark, sf).select(*A_COLUMNS)


@query(
    "model_a_edges",
    with_parts(
        "model_a",
        "SELECT match_no, home_edge, draw_edge, away_edge, pick, pick_prob, pick_edge FROM model_a",
    ),
)
def model_a_edges(spark: SparkSession, sf: str) -> DataFrame:
    return model_a(spark, sf).select(
        "match_no", "home_edge", "draw_edge", "away_edge", "pick", "pick_prob", "pick_edge"
    )


def _a_rows() -> str:
    def line(no: int, texts: tuple, score: str, shown: str) -> str:
        label, home, away = texts
        return (
            f"SELECT match_no, {no} AS reason_no, '{label}' AS label, CAST({shown} AS DOUBLE) "
            f"AS impact, CASE WHEN {score} >= 0 THEN home_team || '{home}' "
            f"ELSE away_team || '{away}' END AS description FROM model_a"
        )

    label, text = fv.A_WEATHER
    rows = " UNION ALL ".join(
        [
            line(0, fv.A_RANK, "f_rank", "f_rank"),
            line(1, fv.A_FORM, "f_form", rounded("f_form")),
            line(2, fv.A_VENUE, "f_venue", rounded("f_venue")),
            line(3, fv.A_GOALS, "f_goals", rounded("f_goals")),
            f"SELECT match_no, 4, '{label}', -4.0::DOUBLE, '{text}' FROM model_a "
            "WHERE f_weather <> 0",
        ]
    )
    return (
        "SELECT match_no, CAST(reason_no AS BIGINT) AS reason_no, label, impact, description "
        f"FROM ({rows})"
    )


@query("model_a_reasons", with_parts("model_a", _a_rows()))
def model_a_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = model_a(spark, sf, explain=True).select(
        "match_no", F.posexplode("reasons").alias("reason_no", "r")
    )
    return rows.select("match_no", "reason_no", "r.*")


_CARD = (
    "round, match_no AS id, home_team AS home, away_team AS away, CASE pick "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.PICK_LABEL.items())
    + " END AS prediction, pick_prob AS probability, pick_edge AS edge, confidence"
)


@query("dashboard_rows", with_parts("model_a", f"SELECT {_CARD} FROM model_a"))
def dashboard_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.dashboard_rows(model_a(spark, sf), "round")


@query(
    "best_pick_by_edge",
    with_parts(
        "model_a",
        f"SELECT * EXCLUDE (n) FROM (SELECT {_CARD}, row_number() OVER (PARTITION BY round "
        "ORDER BY pick_edge DESC, match_no) AS n FROM model_a) WHERE n = 1",
    ),
)
def best_pick_by_edge(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.best_by_edge(dashboard_rows(spark, sf))


# ---------------------------------------------------------------------------------- labels

_RESULT = (
    "CASE WHEN home_goals > away_goals THEN 'HOME' WHEN home_goals = away_goals THEN 'DRAW' "
    "ELSE 'AWAY' END"
)


def _case(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(
    "outcome_labels",
    with_parts(
        "games",
        f"SELECT match_no, {_case('p', fv.OUTCOME_LABEL)} AS outcome_label, "
        f"{_case('p', fv.PICK_LABEL)} AS pick_label, "
        "CASE WHEN gap >= 0 THEN '+' ELSE '' END || CAST(gap AS VARCHAR) AS signed_gap "
        f"FROM (SELECT match_no, {_RESULT} AS p, home_goals - away_goals AS gap FROM games)",
    ),
)
def outcome_labels(spark: SparkSession, sf: str) -> DataFrame:
    games = views.games(spark, sf)
    pick = F.upper(scoring.outcome_from_scores("home_goals", "away_goals"))
    return games.select(
        "match_no",
        labels.outcome_label(pick).alias("outcome_label"),
        labels.pick_label(pick).alias("pick_label"),
        labels.signed(F.col("home_goals") - F.col("away_goals")).alias("signed_gap"),
    )


@query(
    "outcome_codes",
    with_parts(
        "games",
        f"SELECT match_no, {_case('p', fv.OUTCOME_KEY)} AS outcome_key, "
        f"{_case('p', fv.OUTCOME_MARK)} AS outcome_mark, p AS from_key, p AS from_mark "
        f"FROM (SELECT match_no, {_RESULT} AS p FROM games)",
    ),
)
def outcome_codes(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.upper(scoring.outcome_from_scores("home_goals", "away_goals"))
    coded = views.games(spark, sf).select(
        "match_no",
        labels.outcome_key(pick).alias("outcome_key"),
        labels.outcome_mark(pick).alias("outcome_mark"),
    )
    return coded.withColumns(
        {
            "from_key": labels.outcome_from_any("outcome_key"),
            "from_mark": labels.outcome_from_any("outcome_mark"),
        }
    )


# ------------------------------------------------------------------------ the job on pages



@query(
    "landed_page_predictions",
    with_parts(
        "model_b",
        "SELECT round, CAST(match_no AS DOUBLE) AS match_no, home_team, away_team, outcome, "
        "probability, confidence, total_score FROM model_b "
        "WHERE match_no % 13 <> 0 UNION ALL SELECT round, CAST(match_no AS DOUBLE), "
        "home_team, CASE WHEN home_goals > away_goals THEN '1' WHEN home_goals = away_goals "
        "THEN '0' ELSE '2' END, 'DRAW', 40, 'C', 0 FROM model_b "
        "WHERE match_no % 13 = 0 AND match_no % 26 <> 0",
    ),
)
def landed_page_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered pages through extraction, lookup and scoring; unplayed rows shift as they do."""
    games = views.games(spark, sf)
    standings = views.standings(spark, sf, games)
    predicted = predict_pages(
        detail_pages(games), standings_pages(standings), ["season"], explain=False
    )
    return predicted.select(
        "round", "match_no", "home_team", "away_team", "outcome", "probability", "confidence",
        "total_score",
    )


@query(
    "landed_page_best_picks",
    with_parts(
        "model_b",
        "SELECT round, CAST(match_no AS DOUBLE) AS match_no, home_team, away_team, outcome, "
        "probability, confidence FROM (SELECT *, row_number() OVER (PARTITION BY round "
        "ORDER BY probability DESC, CAST(match_no // 1000 AS VARCHAR), match_no) AS n FROM "
        "(SELECT * FROM model_b WHERE match_no % 13 <> 0 UNION ALL BY NAME SELECT round, match_no, home_team, "
        "CASE WHEN home_goals > away_goals THEN '1' WHEN home_goals = away_goals THEN '0' "
        "ELSE '2' END AS away_team, 'DRAW' AS outcome, 40 AS probability, 'C' AS confidence "
        "FROM model_b WHERE match_no % 13 = 0 AND match_no % 26 <> 0)) WHERE n = 1",
    ),
)
def landed_page_best_picks(spark: SparkSession, sf: str) -> DataFrame:
    games = views.games(spark, sf)
    standings = views.standings(spark, sf, games)
    best = best_picks(detail_pages(games), standings_pages(standings), ["season"], ["snapshot_id"])
    return best.select(
        "round", "match_no", "home_team", "away_team", "outcome", "probability", "confidence"
    )


def landed(pages: DataFrame, version: str, at: int | None, page: str) -> DataFrame:
    """Pages as a landing of them: snapshot_id, landed_at."""
    return pages.withColumns(
        {
            "snapshot_id": F.concat_ws("-", F.lit(version), page),
            "landed_at": F.lit(at).cast("bigint"),
        }
    )


_SHIFTED = (
    "SELECT * FROM model_b WHERE match_no % 13 <> 0 UNION ALL BY NAME SELECT season, round, match_no, "
    "home_team, CASE WHEN home_goals > away_goals THEN '1' WHEN home_goals = away_goals THEN '0' "
    "ELSE '2' END AS away_team, 'DRAW' AS outcome, 40 AS probability, 'C' AS confidence "
    "FROM model_b WHERE match_no % 13 = 0 AND match_no % 26 <> 0"
)


@query(
    "current_round_picks",
    with_parts(
        "model_b",
        f"""SELECT season, round, status, CAST(match_no AS DOUBLE) AS match_no, home_team, away_team,
  outcome, probability, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY probability DESC,
        CAST(match_no // 1000 AS VARCHAR), match_no) AS n
      FROM ({_SHIFTED})
      JOIN (SELECT season, coalesce(min(CASE WHEN month % 4 = 2 THEN round END), min(round)) AS round,
              CASE WHEN min(CASE WHEN month % 4 = 2 THEN round END) IS NOT NULL THEN 'open'
                   WHEN arg_min(month, round) % 4 = 1 THEN 'closed' ELSE 'unknown' END AS status
            FROM (SELECT DISTINCT season, round, CAST(substr(round, 6, 2) AS INT) AS month FROM games)
            GROUP BY season) USING (season, round)) WHERE n = 1""",
    ),
)
def current_round_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Per season: schedule, its current round, the round's pages, standings, best pick.

    Every page is landed twice with different content; the old one names another round, other
    numbers and other ranks, and must not count.
    """
    games = views.games(spark, sf)
    standings = views.standings(spark, sf, games)
    months = games.select("season", F.to_date(F.substring("kickoff", 1, 7), "yyyy-MM").alias("month"))
    schedules = month_schedules(months, "season")
    old_schedule = F.lit("<p>販売中 第999912回 （2001/1/1-2001/1/2）</p>")
    details = detail_pages(games).withColumnRenamed("snapshot_id", "page")
    old_games = games.withColumn("match_no", F.col("match_no") + 13)
    old_details = detail_pages(old_games).withColumnRenamed("snapshot_id", "page")
    ranks = standings_pages(standings)
    old_ranks = standings_pages(standings.withColumn("rank", F.lit(1).cast("bigint")))
    best = jobs.current_round_picks(
        landed(schedules, "b", 2, "season").unionByName(
            landed(schedules.withColumn("html", old_schedule), "a", 1, "season")
        ),
        landed(details, "a", 7, "page").unionByName(landed(old_details, "b", 5, "page")),
        landed(ranks, "a", 0, "block").unionByName(landed(old_ranks, "b", None, "block")).withColumn(
            "snapshot_id", F.concat_ws("-", "snapshot_id", "season")
        ),
        ["season"],
        ["page"],
        ["block"],
    )
    return best.select(
        "season", "round", "status", "match_no", "home_team", "away_team", "outcome", "probability",
        "confidence",
    )


@query(
    "same_team",
    with_parts(
        "games",
        "SELECT match_no, home_key % 11 <> 7 AS same_as_listed FROM games",
    ),
)
def same_team(spark: SparkSession, sf: str) -> DataFrame:
    """Each fixture's home name against the listed spelling, canonical name to canonical name."""
    listed = F.format_string("V.FC Supplier#%09d", "home_key")
    return views.games(spark, sf).select(
        "match_no",
        (name_key(views.fixture_name("home_key")) == name_key(remove_ws(listed))).alias(
            "same_as_listed"
        ),
    )


_SPREAD = "o_orderkey * 7919 % 2592000"  # seconds, over the thirty days of the events


@query(
    "votes_as_of_kickoff",
    f"""WITH m AS (
  SELECT o_orderkey AS match_no, CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey % 150 END AS team,
    TIMESTAMP '2023-12-31 00:00:00' + to_seconds({_SPREAD}) AS kickoff FROM orders),
v AS (SELECT user_id AS team, ts, arg_max(value, event_id) AS vote_home, max(event_id) AS capture
  FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT match_no, m.team, vote_home, capture
FROM m ASOF LEFT JOIN v ON m.team = v.team AND m.kickoff >= v.ts""",
)
def votes_as_of_kickoff(spark: SparkSession, sf: str) -> DataFrame:
    """The vote share last captured before each kickoff; some matches have no team or no capture."""
    second = F.expr(f"timestamp_seconds(unix_timestamp(timestamp'2023-12-31 00:00:00') + {_SPREAD})")
    matches = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("match_no"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey") % 150).alias("team"),
        second.alias("kickoff"),
    )
    captures = views.table(spark, sf, "events").where("event_type <> 'error'").select(
        F.col("user_id").alias("team"), F.col("ts"), F.col("value").alias("vote_home"), F.col("event_id").alias("capture")
    )
    found = last_before(matches, captures, ["team"], "kickoff", "ts", ["vote_home", "capture"], ["capture"])
    return found.drop("kickoff")
