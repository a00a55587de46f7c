"""SQL building blocks of the oracles, written for DuckDB and apart from the Spark code."""

from __future__ import annotations

from kickpool.functions import fixed_values as fv

WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}]"
)


def rounded(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def bounded(x: str, cap: float, lo: float | None = None) -> str:
    lo = -cap if lo is None else lo
    return f"greatest(CAST({lo} AS DOUBLE), least(CAST({cap} AS DOUBLE), {x}))"


def dbl(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def number(x: str) -> str:
    """Numeric text as DOUBLE or NULL; blank text is 0."""
    t = stripped(x)
    return (
        f"CASE WHEN {x} = '' THEN NULL WHEN {t} = '' THEN 0.0::DOUBLE "
        rf"WHEN regexp_matches({t}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') "
        f"THEN TRY_CAST({t} AS DOUBLE) END"
    )


CHAIN = (
    "games", "side_rows", "team_sums", "scaled", "standings", "inputs", "model_b",
    "a_inputs", "a_factors", "a_scores", "a_shares", "model_a", "judged", "cells",
)


def with_parts(last: str, select: str, **replaced: str) -> str:
    """The select behind all parts up to the last one it needs; parts can be replaced."""
    parts = PARTS | replaced
    names = CHAIN[: CHAIN.index(last) + 1]
    return "WITH " + ",\n".join(f"{n} AS ({parts[n]})" for n in names) + "\n" + select


PARTS: dict[str, str] = {}

PARTS["games"] = """
SELECT o.o_orderkey AS match_no, CAST(year(o.o_orderdate) AS BIGINT) AS season,
       '第' || strftime(o.o_orderdate, '%Y%m') || '回' AS round,
       strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') AS kickoff,
       h.l_suppkey AS home_key, a.l_suppkey AS away_key,
       CAST(floor(h.l_quantity / 17) AS BIGINT) AS home_goals,
       CAST(floor(a.l_quantity / 17) AS BIGINT) AS away_goals,
       h.l_discount AS home_discount, a.l_discount AS away_discount,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN '雨' WHEN '2-HIGH' THEN '曇り'
            WHEN '3-MEDIUM' THEN '晴れ' WHEN '4-NOT SPECIFIED' THEN '雪' END AS weather
FROM (SELECT l_orderkey, min(line) AS h, max(line) AS a
      FROM (SELECT l_orderkey, struct_pack(l_linenumber := l_linenumber, l_suppkey := l_suppkey,
                   l_quantity := l_quantity, l_discount := l_discount) AS line FROM lineitem)
      GROUP BY l_orderkey) s
JOIN orders o ON o.o_orderkey = s.l_orderkey
WHERE h.l_suppkey <> a.l_suppkey"""

PARTS["side_rows"] = """
SELECT season, home_key AS team_key, home_goals AS scored, away_goals AS conceded, 1 AS at_home
FROM games
UNION ALL SELECT season, away_key, away_goals, home_goals, 0 FROM games"""

PARTS["team_sums"] = """
SELECT season, team_key, count(*) AS n,
       sum(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END) AS pts,
       sum(scored - conceded) AS gap, sum(at_home) AS home_n,
       sum(CASE WHEN scored > conceded THEN at_home ELSE 0 END) AS home_won,
       sum(CASE WHEN scored > conceded THEN 1 - at_home ELSE 0 END) AS away_won
FROM side_rows GROUP BY season, team_key"""

PARTS["scaled"] = """
SELECT season, team_key, CAST(floor(pts * 38 / n) AS BIGINT) AS points,
       CAST(floor(gap * 38 / n) AS BIGINT) AS goal_difference,
       CAST(floor(pts * 5 / n) AS BIGINT) AS form_points,
       CASE WHEN home_n > 0 THEN home_won / home_n ELSE 0 END AS home_win_rate,
       CASE WHEN n - home_n > 0 THEN away_won / (n - home_n) ELSE 0 END AS away_win_rate
FROM team_sums"""

PARTS["standings"] = """
SELECT t.*, 'V.FC ' || s.s_name AS team_name, 20 - CAST(floor(points * 20 / 115) AS BIGINT) AS rank
FROM scaled t JOIN supplier s ON s.s_suppkey = t.team_key"""


def _fixture_key(side: str) -> str:
    number = f"lpad(CAST({side}_key AS VARCHAR), 9, '0')"
    return (
        f"CASE WHEN {side}_key % 11 = 7 THEN '旧Supplier#' ELSE 'V.FCSupplier#' END || {number}"
    )


def _side(side: str) -> str:
    fields = (
        "rank", "points", "goal_difference", "form_points", "home_win_rate", "away_win_rate",
    )
    return ", ".join(f"{side[0]}.{f} AS {side}_{f}" for f in fields)


PARTS["inputs"] = f"""
SELECT g.*, {_fixture_key("home")} AS home_team, {_fixture_key("away")} AS away_team,
       h.team_name AS home_standing_name, a.team_name AS away_standing_name,
       {_side("home")}, {_side("away")}
FROM games g
LEFT JOIN standings h ON h.season = g.season AND h.team_key = g.home_key AND g.home_key % 11 <> 7
LEFT JOIN standings a ON a.season = g.season AND a.team_key = g.away_key AND g.away_key % 11 <> 7
"""

_B_RANK = bounded(f"(away_rank - home_rank) * {dbl(2.5)}", 20)
_B_POINTS = bounded(f"(home_points - away_points) * {dbl(0.8)}", 18)
_B_GOALS = bounded(f"(home_goal_difference - away_goal_difference) * {dbl(0.7)}", 16)
PARTS["model_b"] = f"""
SELECT *, CASE WHEN total_score >= 12 THEN 'HOME' WHEN total_score <= -12 THEN 'AWAY'
               ELSE 'DRAW' END AS outcome,
       CASE WHEN probability >= 70 THEN 'S' WHEN probability >= 62 THEN 'A'
            WHEN probability >= 55 THEN 'B' ELSE 'C' END AS confidence
FROM (SELECT *, CASE WHEN matched
        THEN {rounded(bounded(f"50 + abs(total_score) * {dbl(1.2)}", 78, 38))}
        ELSE 40 END AS probability
      FROM (SELECT *, CASE WHEN matched THEN {rounded("f_rank + f_points + f_goals + 5")}
                      ELSE 0 END AS total_score
            FROM (SELECT *, home_rank IS NOT NULL AND away_rank IS NOT NULL AS matched,
                         {_B_RANK} AS f_rank, {_B_POINTS} AS f_points, {_B_GOALS} AS f_goals
                  FROM inputs)))"""

_ABSENT = ", ".join(
    f"coalesce({side}_{field}, 0) AS {side}_{field}"
    for side in ("home", "away")
    for field in ("rank", "goal_difference", "form_points", "home_win_rate", "away_win_rate")
)
PARTS["a_inputs"] = f"""
SELECT *, CAST(100 AS BIGINT) - vote_home - vote_away AS vote_draw
FROM (SELECT * REPLACE ({_ABSENT}),
        CASE WHEN match_no % 7 <> 0 THEN {rounded("30 + home_discount * 100")} END AS vote_home,
        CASE WHEN match_no % 7 <> 0 THEN {rounded("30 + away_discount * 100")} END AS vote_away
      FROM inputs)"""

PARTS["a_factors"] = f"""
SELECT *, {bounded(f"(away_rank - home_rank) * {dbl(2)}", 16)} AS f_rank,
       {bounded(f"(home_form_points - away_form_points) * {dbl(1.5)}", 15)} AS f_form,
       {bounded(f"(home_home_win_rate - away_away_win_rate) * {dbl(25)}", 12)} AS f_venue,
       {bounded(f"(home_goal_difference - away_goal_difference) * {dbl(0.7)}", 10)} AS f_goals,
       CASE WHEN weather LIKE '%雨%' OR weather LIKE '%雪%' THEN -4 ELSE 0 END AS f_weather
FROM a_inputs"""

PARTS["a_scores"] = f"""
SELECT *, {bounded(f"{dbl(100)} - s_home - s_away - f_weather", 34, 18)} AS s_draw
FROM (SELECT *, {bounded("50 + f_rank + f_form + f_venue + f_goals", 76, 18)} AS s_home,
             {bounded("50 - f_rank - f_form - f_venue - f_goals", 58, 12)} AS s_away
      FROM a_factors)"""

PARTS["a_shares"] = f"""
SELECT *, 100 - home_prob - draw_prob AS away_prob
FROM (SELECT *, {rounded("s_home / (s_home + s_draw + s_away) * 100")} AS home_prob,
             {rounded("s_draw / (s_home + s_draw + s_away) * 100")} AS draw_prob FROM a_scores)"""

PARTS["model_a"] = """
SELECT *, CASE WHEN pick_prob >= 68 AND pick_edge >= 12 THEN 'S'
               WHEN pick_prob >= 62 AND pick_edge >= 8 THEN 'A'
               WHEN pick_prob >= 56 AND pick_edge >= 5 THEN 'B+'
               WHEN pick_prob >= 50 THEN 'B' ELSE 'C' END AS confidence
FROM (SELECT *, CASE pick WHEN 'HOME' THEN home_prob WHEN 'DRAW' THEN draw_prob
                     ELSE away_prob END AS pick_prob,
             coalesce(CASE pick WHEN 'HOME' THEN home_edge WHEN 'DRAW' THEN draw_edge
                      ELSE away_edge END, 0) AS pick_edge
      FROM (SELECT *, home_prob - vote_home AS home_edge, draw_prob - vote_draw AS draw_edge,
                   away_prob - vote_away AS away_edge,
                   CASE WHEN home_prob >= draw_prob AND home_prob >= away_prob THEN 'HOME'
                        WHEN away_prob >= draw_prob THEN 'AWAY' ELSE 'DRAW' END AS pick
            FROM a_shares))"""

PARTS["judged"] = """
SELECT *, CASE WHEN match_no % 13 = 0 THEN NULL WHEN home_goals > away_goals THEN 'home'
               WHEN home_goals = away_goals THEN 'draw' ELSE 'away' END AS result_outcome
FROM model_a"""

_POOL = (
    "CASE WHEN match_no % 26 = 0 THEN '' WHEN home_goals > away_goals THEN '1' "
    "WHEN home_goals = away_goals THEN '0' ELSE '2' END"
)
PARTS["cells"] = f"""
SELECT substr(round, 2, 6) || '-' || CAST(match_no // 1000 AS VARCHAR) AS snapshot_id,
       substr(round, 2, 6) AS round_number, round, season, match_no,
       row_number() OVER (PARTITION BY round, match_no // 1000 ORDER BY match_no) - 1 AS row_idx,
       list_value(kickoff, 'Stadium & Park ' || home_key, CAST(match_no AS VARCHAR),
         CASE WHEN home_key % 11 = 7 THEN '旧 Supplier#' ELSE 'Ｖ．ＦＣ Supplier#' END
           || lpad(CAST(home_key AS VARCHAR), 9, '0'),
         CASE WHEN match_no % 13 = 0 THEN '' ELSE home_goals || '-' || away_goals END,
         CASE WHEN away_key % 11 = 7 THEN '旧 Supplier#' ELSE 'Ｖ．ＦＣ Supplier#' END
           || lpad(CAST(away_key AS VARCHAR), 9, '0'),
         {_POOL}) AS t
FROM games"""

OUTCOME_LABEL_SQL = (
    "CASE outcome "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.OUTCOME_LABEL.items())
    + " END"
)
