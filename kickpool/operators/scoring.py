"""Explainable pair scoring: clamped weighted differences, then probabilities and grades.

``score_pairs`` is the one scoring primitive; both rule models and the design-document
score are configurations of it. Everything is a Column expression, so a whole model is one
projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kickpool.functions import fixed_values as fv
from kickpool.functions.labels import pick_label
from kickpool.functions.numbers import clamp, half_up
from kickpool.functions.text import contains_any


@dataclass(frozen=True)
class Factor:
    """One term: (plus - minus) * weight, held inside [-cap, cap] when a cap is given."""

    name: str
    plus: str
    minus: str
    weight: float
    cap: float | None = None

    def column(self) -> Column:
        gap = F.col(self.plus).cast("double") - F.col(self.minus).cast("double")
        scaled = gap * F.lit(self.weight)
        return scaled if self.cap is None else clamp(scaled, -self.cap, self.cap)


def running_sum(start: Column, terms: Sequence[Column], sign: int = 1) -> Column:
    """start ± t1 ± t2 … in that order; the order fixes the floating-point result."""
    step = (lambda a, b: a + b) if sign > 0 else (lambda a, b: a - b)
    return reduce(step, terms, start)


def score_pairs(
    df: DataFrame, factors: Sequence[Factor], bonus: float = 0.0, total: str = "raw_total"
) -> DataFrame:
    """Add one ``<name>_score`` column per factor and their sum plus the home bonus."""
    scored = df.withColumns({f"{f.name}_score": f.column() for f in factors})
    terms = [F.col(f"{f.name}_score") for f in factors]
    return scored.withColumn(total, running_sum(F.lit(0.0), terms) + F.lit(float(bonus)))


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows with these computed columns passed through a one-row generator.

    Scores are built in steps that use each other several times. A later filter on one of
    them would be pushed below all steps and multiply the expression at each; a generator
    ends that, while filters on the other columns still reach the scan.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns))))


def explanation(label: str, shown: Column, sentence: Column, amount: str) -> Column:
    """(label, amount, description) struct; the amount is called score or impact."""
    return F.struct(
        F.lit(label).alias("label"),
        shown.cast("double").alias(amount),
        sentence.alias("description"),
    )


def reason(
    texts: Sequence[str], name: str, sides: tuple[str, str], shown: Column, amount: str
) -> Column:
    """Explanation of a factor; the sentence names the side its unrounded score favours."""
    label, for_home, for_away = texts
    home, away = sides
    sentence = F.when(
        F.col(f"{name}_score") >= 0, F.concat(F.col(home), F.lit(for_home))
    ).otherwise(F.concat(F.col(away), F.lit(for_away)))
    return explanation(label, shown, sentence, amount)


# ---------------------------------------------------------------- model B (standings only)

# --- fixed values: weights, caps and bonus of model B --------------------------------
MODEL_B = (
    Factor("rank", "away_rank", "home_rank", 2.5, 20.0),
    Factor("points", "home_points", "away_points", 0.8, 18.0),
    Factor("goals", "home_goal_difference", "away_goal_difference", 0.7, 16.0),
)
MODEL_B_HOME_BONUS = 5.0


def model_b_outcome(total: Column) -> Column:
    return F.when(total >= 12, "HOME").when(total <= -12, "AWAY").otherwise("DRAW")


def model_b_probability(total: Column) -> Column:
    return half_up(clamp(F.lit(50.0) + F.abs(total) * F.lit(1.2), 38, 78))


def model_b_confidence(probability: Column) -> Column:
    graded = F.when(probability >= 70, "S").when(probability >= 62, "A")
    return graded.when(probability >= 55, "B").otherwise("C")


def predict_model_b(inputs: DataFrame, explain: bool = True) -> DataFrame:
    """Score looked-up fixtures; a fixture with a missing side gets the fixed fallback.

    Needs the columns of ``lookup.attach_standings``. Adds outcome, probability,
    confidence, total_score and, on request, the factors array.
    """
    matched = F.col("home_standing_name").isNotNull() & F.col("away_standing_name").isNotNull()
    scored = score_pairs(inputs, MODEL_B, MODEL_B_HOME_BONUS)
    scored = scored.withColumns(
        {"matched": matched, "total_score": F.when(matched, half_up("raw_total")).otherwise(0)}
    )
    total = F.col("total_score")
    scored = scored.withColumns(
        {
            "outcome": model_b_outcome(total),
            "probability": F.when(F.col("matched"), model_b_probability(total)).otherwise(40),
        }
    ).withColumn("confidence", model_b_confidence(F.col("probability")))
    results = ["total_score", "outcome", "probability", "confidence"]
    if explain:
        scored = scored.withColumn("factors", model_b_factors())
        results.append("factors")
    scored = scored.drop("raw_total", *(f"{f.name}_score" for f in MODEL_B))
    return settled(scored, *results)


def model_b_factors() -> Column:
    """Four factor structs, or the two fixed ones when a side has no standing."""
    sides = ("home_standing_name", "away_standing_name")
    texts = {"rank": fv.B_RANK, "points": fv.B_POINTS, "goals": fv.B_GOALS}
    shown = [
        reason(text, name, sides, half_up(f"{name}_score"), "score")
        for name, text in texts.items()
    ]
    venue_label, venue_text = fv.B_VENUE
    venue = F.concat(F.col(sides[0]), F.lit(venue_text))
    shown.append(explanation(venue_label, F.lit(MODEL_B_HOME_BONUS), venue, "score"))
    missing = [
        explanation(label, F.lit(0.0), F.lit(text), "score") for label, text in fv.B_UNMATCHED
    ]
    return F.when(F.col("matched"), F.array(*shown)).otherwise(F.array(*missing))


# ------------------------------------------------- model A (form, venue, weather, votes)

# --- fixed values: weights and caps of model A ---------------------------------------
MODEL_A = (
    Factor("rank", "away_rank", "home_rank", 2.0, 16.0),
    Factor("form", "home_form_points", "away_form_points", 1.5, 15.0),
    Factor("venue", "home_home_win_rate", "away_away_win_rate", 25.0, 12.0),
    Factor("goals", "home_goal_difference", "away_goal_difference", 0.7, 10.0),
)


def bad_weather_impact(weather: Column | str) -> Column:
    return F.when(contains_any(weather, fv.BAD_WEATHER), F.lit(-4)).otherwise(F.lit(0))


def three_way_share(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    """Percentages of three scores; away takes the rounding remainder."""
    total = home + draw + away
    h, d = half_up(home / total * 100), half_up(draw / total * 100)
    return h, d, F.lit(100) - h - d


def argmax_pick(home: Column, draw: Column, away: Column) -> Column:
    """Likeliest outcome; ties go to HOME, then AWAY, then DRAW."""
    top = F.greatest(home, draw, away)
    return F.when(home == top, "HOME").when(away == top, "AWAY").otherwise("DRAW")


def of_pick(pick: Column, home: Column, draw: Column, away: Column) -> Column:
    return F.when(pick == "HOME", home).when(pick == "DRAW", draw).otherwise(away)


def model_a_confidence(probability: Column, edge: Column) -> Column:
    p, e = probability, edge
    graded = F.when((p >= 68) & (e >= 12), "S").when((p >= 62) & (e >= 8), "A")
    return graded.when((p >= 56) & (e >= 5), "B+").when(p >= 50, "B").otherwise("C")


def predict_model_a(matches: DataFrame, explain: bool = True) -> DataFrame:
    """Three-way probabilities, edge over the votes, pick, confidence and reasons.

    Reads home_/away_ rank, form_points, goal_difference, home_home_win_rate,
    away_away_win_rate, weather and vote_home/vote_draw/vote_away. All three votes must be
    there for an edge; otherwise the edges are NULL and count as 0 for the confidence.
    """
    terms = [F.col(f"{f.name}_score") for f in MODEL_A]
    scored = score_pairs(matches, MODEL_A).withColumn(
        "weather_impact", bad_weather_impact("weather")
    )
    scored = scored.withColumns(
        {
            "_home": clamp(running_sum(F.lit(50.0), terms), 18, 76),
            "_away": clamp(running_sum(F.lit(50.0), terms, sign=-1), 12, 58),
        }
    ).withColumn(
        "_draw",
        clamp(F.lit(100.0) - F.col("_home") - F.col("_away") - F.col("weather_impact"), 18, 34),
    )
    home, draw, away = three_way_share(F.col("_home"), F.col("_draw"), F.col("_away"))
    scored = scored.withColumns({"home_prob": home, "draw_prob": draw}).withColumn(
        "away_prob", F.lit(100) - F.col("home_prob") - F.col("draw_prob")
    )
    voted = F.col("vote_home").isNotNull() & F.col("vote_draw").isNotNull()
    voted = voted & F.col("vote_away").isNotNull()
    probs = [F.col(f"{side}_prob") for side in ("home", "draw", "away")]
    scored = scored.withColumns(
        {
            f"{side}_edge": F.when(voted, half_up(F.col(f"{side}_prob") - F.col(f"vote_{side}")))
            for side in ("home", "draw", "away")
        }
    ).withColumn("pick", argmax_pick(*probs))
    edges = [F.coalesce(F.col(f"{side}_edge"), F.lit(0)) for side in ("home", "draw", "away")]
    scored = scored.withColumns(
        {
            "pick_prob": of_pick(F.col("pick"), *probs),
            "pick_edge": of_pick(F.col("pick"), *edges),
        }
    ).withColumn("confidence", model_a_confidence(F.col("pick_prob"), F.col("pick_edge")))
    results = [f"{side}_{kind}" for side in ("home", "draw", "away") for kind in ("prob", "edge")]
    results += ["pick", "pick_prob", "pick_edge", "confidence"]
    if explain:
        scored = scored.withColumn("reasons", model_a_reasons())
        results.append("reasons")
    steps = ("raw_total", "_home", "_draw", "_away", "weather_impact")
    scored = scored.drop(*steps, *(f"{f.name}_score" for f in MODEL_A))
    return settled(scored, *results)


def model_a_reasons() -> Column:
    """Four reason structs, and a fifth when the weather counts. Rank is shown unrounded."""
    sides = ("home_short_name", "away_short_name")
    texts = {"form": fv.A_FORM, "venue": fv.A_VENUE, "goals": fv.A_GOALS}
    always = [reason(fv.A_RANK, "rank", sides, F.col("rank_score"), "impact")]
    always += [
        reason(text, name, sides, half_up(f"{name}_score"), "impact")
        for name, text in texts.items()
    ]
    label, text = fv.A_WEATHER
    weather = explanation(label, F.col("weather_impact"), F.lit(text), "impact")
    return F.when(F.col("weather_impact") != 0, F.array(*always, weather)).otherwise(
        F.array(*always)
    )


def dashboard_rows(predicted: DataFrame, *keep: str) -> DataFrame:
    """Card rows: label, probability and edge of the picked outcome (edge 0 without votes)."""
    return predicted.select(
        *keep,
        F.col("match_no").alias("id"),
        F.col("home_short_name").alias("home"),
        F.col("away_short_name").alias("away"),
        pick_label("pick").alias("prediction"),
        F.col("pick_prob").alias("probability"),
        F.col("pick_edge").alias("edge"),
        "confidence",
    )


# --------------------------------------------------------------- design-document scoring

# --- fixed values: points per result, designed weights -------------------------------
FORM_POINTS = {"W": 3, "D": 1, "L": 0}

DESIGN_SCORE = (
    Factor("form", "home_form_points", "away_form_points", 1.8),
    Factor("rank", "away_rank", "home_rank", 1.1),
    Factor("goals", "home_net_goals", "away_net_goals", 0.7),
)

# --- fixed values: designed factor weights -------------------------------------------
DESIGN_WEIGHTS = {
    "form": 20,
    "venue": 15,
    "rank": 10,
    "goal_difference": 15,
    "fatigue": 10,
    "absences": 15,
    "weather": 5,
    "motivation": 5,
    "head_to_head": 5,
}


def form_points(text: Column | str) -> Column:
    """Points of a W/D/L text, as BIGINT; other characters count nothing."""
    text = F.col(text) if isinstance(text, str) else text
    return sum(
        (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) * F.lit(points)
        for mark, points in FORM_POINTS.items()
        if points
    ).cast("bigint")


def design_gaps(matches: DataFrame) -> DataFrame:
    """Gaps of the designed score: rank (a smaller rank is better) and net goals, home minus away."""
    return matches.withColumns(
        {
            "rank_gap": F.col("away_rank") - F.col("home_rank"),
            "net_gap": F.col("home_net_goals") - F.col("away_net_goals"),
        }
    )


def design_scores(
    matches: DataFrame,
    low_scoring: Column | None = None,
    fatigued: Column | None = None,
) -> DataFrame:
    """Raw three-way scores: sides start at 50, draw at 24.

    The low-scoring and fatigue thresholds are unstated in the design, so the caller brings
    the two conditions; without them their increments stay out.
    """
    scored = score_pairs(matches, DESIGN_SCORE)
    terms = [F.col(f"{f.name}_score") for f in DESIGN_SCORE]
    scored = scored.withColumns(
        {
            "home_raw": running_sum(F.lit(50.0), terms) + F.lit(5.0),
            "away_raw": running_sum(F.lit(50.0), terms, sign=-1),
        }
    )
    close = F.abs(F.col("home_raw") - F.col("away_raw")) < 8
    increments = [(close, 6.0), (contains_any("weather", (fv.RAIN,)), 3.0)]
    if low_scoring is not None:
        increments.append((low_scoring, 4.0))
    if fatigued is not None:
        increments.append((fatigued, 2.0))
    draw = running_sum(
        F.lit(24.0), [F.when(c, F.lit(v)).otherwise(F.lit(0.0)) for c, v in increments]
    )
    scored = scored.withColumn("draw_raw", draw)
    scored = scored.drop("raw_total", *(f"{f.name}_score" for f in DESIGN_SCORE))
    return settled(scored, "home_raw", "draw_raw", "away_raw")


def design_probabilities(scored: DataFrame) -> DataFrame:
    """Percentages of the raw scores. The design names no rule; ours divides by the sum."""
    home, draw, away = three_way_share(F.col("home_raw"), F.col("draw_raw"), F.col("away_raw"))
    return scored.withColumns({"home_prob": home, "draw_prob": draw, "away_prob": away})


def weighted_score(
    df: DataFrame, factor_columns: dict[str, str], total: str = "weighted_total"
) -> DataFrame:
    """Weighted sum of caller-supplied factor columns with the designed weights.

    Only weights are designed, no formulas: each factor is a column the caller computed.
    """
    terms = [
        F.col(column).cast("double") * F.lit(float(DESIGN_WEIGHTS[name]))
        for name, column in factor_columns.items()
    ]
    return df.withColumn(total, running_sum(F.lit(0.0), terms))


def edge_tier(edge: Column | str) -> Column:
    edge = F.col(edge) if isinstance(edge, str) else edge
    tiers = F.when(edge >= 15, "S").when(edge >= 10, "A").when(edge >= 5, "B")
    return tiers.when(edge >= 0, "C").when(edge < 0, "pass")


def designed_confidence(probability: Column, edge: Column) -> Column:
    p, e = probability, edge
    graded = F.when((p >= 60) & (e >= 10), "S").when((p >= 55) & (e >= 7), "A")
    return graded.when(p >= 50, "B").otherwise("C")


def outcome_from_scores(home: Column | str, away: Column | str) -> Column:
    """home / draw / away from goals; NULL while a score is missing."""
    home = F.col(home) if isinstance(home, str) else home
    away = F.col(away) if isinstance(away, str) else away
    return F.when(home > away, "home").when(home == away, "draw").when(home < away, "away")


