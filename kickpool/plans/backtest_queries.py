"""Registered queries: designed scores, hit checks, backtests, edge ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.operators import backtest, ranking, scoring
from kickpool.plans.import_queries import form_text, form_text_sql
from kickpool.plans.oracle_parts import dbl, rounded, with_parts
from kickpool.plans.prediction_queries import model_a, model_a_inputs
from kickpool.plans.registry import query


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Model A predictions with the result; every 13th match is unplayed."""
    outcome = scoring.outcome_from_scores("home_goals", "away_goals")
    return model_a(spark, sf).withColumn(
        "result_outcome", F.when(F.col("match_no") % 13 != 0, outcome)
    )


def _points_sql(text: str) -> str:
    return (
        f"(3 * (len({text}) - len(replace({text}, 'W', ''))) + len({text}) "
        f"- len(replace({text}, 'D', '')))"
    )


_DESIGN = f"""SELECT match_no, rank_gap, net_gap, home_raw, away_raw, draw_raw,
  home_prob, draw_prob, 100 - home_prob - draw_prob AS away_prob
FROM (SELECT *, {rounded("home_raw / (home_raw + draw_raw + away_raw) * 100")} AS home_prob,
             {rounded("draw_raw / (home_raw + draw_raw + away_raw) * 100")} AS draw_prob
  FROM (SELECT *, {dbl(24)} + CASE WHEN abs(home_raw - away_raw) < 8 THEN 6 ELSE 0 END
          + CASE WHEN weather LIKE '%雨%' THEN 3 ELSE 0 END
          + CASE WHEN home_goals + away_goals <= 1 THEN 4 ELSE 0 END
          + CASE WHEN match_no % 4 = 0 THEN 2 ELSE 0 END AS draw_raw
    FROM (SELECT *, 50 + form_gap * {dbl(1.8)} + rank_gap * {dbl(1.1)} + net_gap * {dbl(0.7)} + 5
                 AS home_raw,
                 50 - form_gap * {dbl(1.8)} - rank_gap * {dbl(1.1)} - net_gap * {dbl(0.7)}
                 AS away_raw
      FROM (SELECT *, {_points_sql(form_text_sql("home_key"))}
                 - {_points_sql(form_text_sql("away_key"))} AS form_gap,
               CAST(away_rank - home_rank AS BIGINT) AS rank_gap,
               CAST(home_goals - away_goals - (away_goals - home_goals) AS BIGINT) AS net_gap
        FROM a_inputs))))"""


@query("design_scores", with_parts("a_inputs", _DESIGN))
def design_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The designed score, with the caller's own low-scoring and fatigue conditions."""
    inputs = model_a_inputs(spark, sf).withColumns(
        {
            "home_form_points": scoring.form_points(form_text("home_key")),
            "away_form_points": scoring.form_points(form_text("away_key")),
            "home_net_goals": F.col("home_goals") - F.col("away_goals"),
            "away_net_goals": F.col("away_goals") - F.col("home_goals"),
        }
    )
    inputs = scoring.design_gaps(inputs)
    scored = scoring.design_scores(
        inputs,
        low_scoring=F.col("home_goals") + F.col("away_goals") <= 1,
        fatigued=F.col("match_no") % 4 == 0,
    )
    return scoring.design_probabilities(scored).select(
        "match_no", "rank_gap", "net_gap", "home_raw", "away_raw", "draw_raw", "home_prob",
        "draw_prob", "away_prob",
    )


@query(
    "weighted_factors",
    with_parts(
        "a_inputs",
        "SELECT match_no, CAST(home_form_points - away_form_points AS DOUBLE) * 20 "
        "+ CAST(away_rank - home_rank AS DOUBLE) * 10 "
        "+ CAST(home_goal_difference - away_goal_difference AS DOUBLE) * 15 AS weighted_total "
        "FROM a_inputs",
    ),
)
def weighted_factors(spark: SparkSession, sf: str) -> DataFrame:
    inputs = model_a_inputs(spark, sf).withColumns(
        {
            "form_gap": F.col("home_form_points") - F.col("away_form_points"),
            "rank_gap": F.col("away_rank") - F.col("home_rank"),
            "goal_gap": F.col("home_goal_difference") - F.col("away_goal_difference"),
        }
    )
    factors = {"form": "form_gap", "rank": "rank_gap", "goal_difference": "goal_gap"}
    return scoring.weighted_score(inputs, factors).select("match_no", "weighted_total")


_TIER = (
    "CASE WHEN pick_edge >= 15 THEN 'S' WHEN pick_edge >= 10 THEN 'A' WHEN pick_edge >= 5 "
    "THEN 'B' WHEN pick_edge >= 0 THEN 'C' ELSE 'pass' END"
)


@query("edge_tier", with_parts("model_a", f"SELECT match_no, pick_edge, {_TIER} AS tier FROM model_a"))
def edge_tier(spark: SparkSession, sf: str) -> DataFrame:
    return model_a(spark, sf).select(
        "match_no", "pick_edge", scoring.edge_tier("pick_edge").alias("tier")
    )


@query(
    "confidence_spec",
    with_parts(
        "model_a",
        "SELECT match_no, CASE WHEN pick_prob >= 60 AND pick_edge >= 10 THEN 'S' WHEN "
        "pick_prob >= 55 AND pick_edge >= 7 THEN 'A' WHEN pick_prob >= 50 THEN 'B' ELSE 'C' END "
        "AS confidence FROM model_a",
    ),
)
def confidence_spec(spark: SparkSession, sf: str) -> DataFrame:
    grade = scoring.designed_confidence(F.col("pick_prob"), F.col("pick_edge"))
    return model_a(spark, sf).select("match_no", grade.alias("confidence"))


@query(
    "hit_check",
    with_parts(
        "judged",
        "SELECT match_no, pick, result_outcome, lower(pick) = result_outcome AS hit FROM judged",
    ),
)
def hit_check(spark: SparkSession, sf: str) -> DataFrame:
    hit = backtest.is_hit("pick", "result_outcome")
    return judged(spark, sf).select("match_no", "pick", "result_outcome", hit.alias("hit"))


_ROUNDS = """SELECT round, count(*) AS match_count,
  CAST(sum(CASE WHEN lower(pick) = result_outcome THEN 1 ELSE 0 END) AS BIGINT) AS hit_count,
  CAST(sum(pick_edge) AS BIGINT) AS edge_sum,
  CAST(sum(CASE WHEN pick_edge > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_count,
  CAST(sum(CASE WHEN pick_edge > 0 AND lower(pick) = result_outcome THEN 1 ELSE 0 END) AS BIGINT)
    AS positive_hits
FROM judged WHERE result_outcome IS NOT NULL GROUP BY round"""


@query(
    "backtest_round",
    with_parts(
        "judged",
        "SELECT *, hit_count / match_count AS accuracy, edge_sum / match_count AS average_edge "
        f"FROM ({_ROUNDS})",
    ),
)
def backtest_round(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.round_backtest(judged(spark, sf))


@query(
    "backtest_overall",
    with_parts(
        "judged",
        f"""SELECT count(*) AS round_count, CAST(sum(match_count) AS BIGINT) AS match_count,
  CAST(sum(hit_count) AS BIGINT) AS hit_count, sum(hit_count) / sum(match_count) AS hit_rate,
  sum(hit_count) * 13 / sum(match_count) AS mean_hits_per_13, max(hit_count) AS best_hits,
  sum(positive_hits) / sum(positive_count) AS positive_hit_rate FROM ({_ROUNDS})""",
    ),
)
def backtest_overall(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.overall_backtest(backtest_round(spark, sf))


GRAINS = (("season",), ("round",), ("tier",), ("league",), ("season", "tier"), ())


def _grains_sql() -> str:
    sets = ", ".join("(" + ", ".join(grain) + ")" for grain in GRAINS)
    name = " ".join(
        "WHEN " + " AND ".join(f"grouping({c}) = {int(c not in grain)}" for c in ("season", "round", "tier", "league"))
        + f" THEN '{'+'.join(grain) or 'total'}'"
        for grain in GRAINS
    )
    hit, up = "CASE WHEN lower(pick) = result_outcome THEN 1 ELSE 0 END", "CASE WHEN pick_edge > 0 THEN 1 ELSE 0 END"
    return with_parts(
        "judged",
        f"""SELECT *, hit_count / match_count AS accuracy, edge_sum / match_count AS average_edge,
  positive_hits / nullif(positive_count, 0) AS positive_hit_rate
FROM (SELECT CASE {name} END AS grain, season, round, tier, league, count(*) AS match_count,
  CAST(sum({hit}) AS BIGINT) AS hit_count, CAST(sum(pick_edge) AS BIGINT) AS edge_sum,
  CAST(sum({up}) AS BIGINT) AS positive_count, CAST(sum({up} * {hit}) AS BIGINT) AS positive_hits
FROM (SELECT *, {_TIER} AS tier, 'J' || CAST(match_no % 3 + 1 AS VARCHAR) AS league FROM judged
      WHERE result_outcome IS NOT NULL)
GROUP BY GROUPING SETS ({sets}))""",
    )


@query("backtest_grains", _grains_sql())
def backtest_grains(spark: SparkSession, sf: str) -> DataFrame:
    """The backtest by season, round, tier, league, season and tier, and in total, in one job."""
    league = F.concat(F.lit("J"), (F.col("match_no") % 3 + 1).cast("string"))
    rows = judged(spark, sf).withColumn("tier", scoring.edge_tier("pick_edge")).withColumn("league", league)
    return backtest.grain_backtest(rows, GRAINS)


@query(
    "score_ranking",
    with_parts(
        "a_inputs",
        f"""SELECT round, match_no, home_raw, rank() OVER (PARTITION BY round ORDER BY home_raw DESC) AS place,
  row_number() OVER (PARTITION BY round ORDER BY home_raw DESC, match_no) AS position
FROM ({_DESIGN.replace("SELECT match_no, rank_gap", "SELECT round, match_no, rank_gap", 1)})""",
    ),
)
def score_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of a round in order of the designed home score, which is not rounded."""
    rounds = model_a_inputs(spark, sf).select("round", "match_no")
    scored = design_scores(spark, sf).select("match_no", "home_raw").join(rounds, "match_no").select("round", "match_no", "home_raw")
    return ranking.rank_by_ranges(scored, ["round"], "home_raw", ["match_no"])


@query(
    "edge_ranking",
    with_parts(
        "model_a",
        """SELECT round, match_no, outcome, probability, edge,
  rank() OVER (PARTITION BY round ORDER BY edge DESC) AS place,
  row_number() OVER (PARTITION BY round ORDER BY edge DESC, match_no, outcome) AS position
FROM (SELECT round, match_no, 'HOME' AS outcome, home_prob AS probability, home_edge AS edge
      FROM model_a UNION ALL SELECT round, match_no, 'DRAW', draw_prob, draw_edge FROM model_a
      UNION ALL SELECT round, match_no, 'AWAY', away_prob, away_edge FROM model_a)
WHERE edge IS NOT NULL""",
    ),
)
def edge_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.edge_ranking(model_a(spark, sf), "round", "match_no")
