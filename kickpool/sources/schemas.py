"""Explicit schemas of the stored tables, and the rules their rows keep."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: columns of the stored tables --------------------------------------
ROUNDS = (
    "round_no string, title string, sales_start timestamp, sales_end timestamp, status string, "
    "source_url string"
)
TEAMS = "name string, short_name string, league string"
MATCHES = (
    "round_no string, match_no int, kickoff timestamp, league string, venue string, "
    "home_team string, away_team string, weather string, home_rank int, away_rank int, "
    "home_points int, away_points int, home_last5 string, away_last5 string, "
    "home_goals_for int, home_goals_against int, away_goals_for int, away_goals_against int, "
    "home_win_rate double, away_win_rate double, home_rest_days int, away_rest_days int, "
    "home_injury_level int, away_injury_level int, vote_home double, vote_draw double, "
    "vote_away double, result_home_score int, result_away_score int, result_outcome string, "
    "source_url string"
)
PREDICTIONS = (
    "round_no string, match_no int, model_version string, home_prob double, draw_prob double, "
    "away_prob double, pick string, confidence string, edge double, reasons string"
)


@dataclass(frozen=True)
class Rules:
    """What a table's rows must satisfy; references name the parent table and the columns."""

    key: tuple[str, ...]
    not_null: tuple[str, ...]
    allowed: dict[str, list[str]] = field(default_factory=dict)
    references: dict[str, tuple[str, ...]] = field(default_factory=dict)


# --- fixed values: rules of the stored tables ----------------------------------------
OUTCOMES = ["home", "draw", "away"]
TABLE_RULES = {
    "rounds": Rules(("round_no",), ("round_no",)),
    "teams": Rules(("name",), ("name",)),
    "matches": Rules(
        ("round_no", "match_no"),
        ("round_no", "match_no", "home_team", "away_team"),
        {"result_outcome": OUTCOMES},
        {"rounds": ("round_no",)},
    ),
    "predictions": Rules(
        ("round_no", "match_no", "model_version"),
        (
            "model_version", "home_prob", "draw_prob", "away_prob", "pick", "confidence", "edge",
            "reasons",
        ),
        {"pick": OUTCOMES},
        {"matches": ("round_no", "match_no")},
    ),
}
