"""Hand-derived rows, and bounds that hold for any input."""

import itertools

import pytest
from pyspark.sql import functions as F

from kickpool.operators import scoring
from kickpool.operators.lookup import attach_standings
from kickpool.operators.ranking import best_by_edge, best_by_probability

MATCHES = [
    # id, ranks, form, win rates, goal differences, weather, votes
    ("1", 2, 6, 12, 7, 0.72, 0.39, 15, 5, "曇り", 45.0, 26.0, 29.0),
    ("2", 9, 8, 6, 8, 0.45, 0.42, 0, 3, "雨", 34.0, 31.0, 35.0),
    ("3", 4, 12, 10, 4, 0.67, 0.22, 10, -9, "晴れ", 49.0, 27.0, 24.0),
]
FIELDS = (
    "id string, home_rank int, away_rank int, home_form_points int, away_form_points int, "
    "home_home_win_rate double, away_away_win_rate double, home_goal_difference int, "
    "away_goal_difference int, weather string, vote_home double, vote_draw double, vote_away double"
)


def model_a(spark, rows):
    df = spark.createDataFrame(rows, FIELDS).withColumns(
        {
            "home_short_name": F.lit("h"),
            "away_short_name": F.lit("a"),
            "match_no": F.col("id").cast("int"),
            "round": F.lit("r"),
        }
    )
    return scoring.predict_model_a(df)


def test_model_a_golden_rows(spark):
    rows = model_a(spark, MATCHES).orderBy("id").collect()
    impacts = [[r.impact for r in row.reasons] for row in rows]
    assert impacts == [[8, 8, 8, 7], [-2, -3, 1, -2, -4], [16, 9, 11, 10]]
    assert [(r.home_prob, r.draw_prob, r.away_prob) for r in rows] == [
        (67, 16, 17), (37, 15, 48), (72, 17, 11),
    ]
    assert [(r.home_edge, r.draw_edge, r.away_edge) for r in rows] == [
        (22, -10, -12), (3, -16, 13), (23, -10, -13),
    ]
    assert [(r.pick, r.confidence) for r in rows] == [("HOME", "A"), ("AWAY", "C"), ("HOME", "S")]
    best = best_by_edge(scoring.dashboard_rows(model_a(spark, MATCHES), "round"))
    assert [(r.id, r.edge) for r in best.collect()] == [(3, 23)]


def test_model_a_balanced_match_goes_away_and_votes_are_optional(spark):
    even = ("1", 5, 5, 3, 3, 0.5, 0.5, 0, 0, None, None, 30.0, 30.0)
    row = model_a(spark, [even]).first()
    assert (row.home_prob, row.draw_prob, row.away_prob, row.pick) == (42, 15, 43, "AWAY")
    assert (row.home_edge, row.draw_edge, row.pick_edge, row.confidence) == (None, None, 0, "C")


def test_model_a_bounds(spark):
    gaps = itertools.product((-20, -3, 0, 1, 20), (-15, 0, 7), (0.0, 0.3, 1.0), (-30, 0, 4), ("雪", None))
    rows = [
        (str(i), 20, 20 + a, 15 + b, 15, c, 0.3, d, 0, w, 40.0, 30.0, 30.0)
        for i, (a, b, c, d, w) in enumerate(gaps)
    ]
    for r in model_a(spark, rows).collect():
        assert r.home_prob + r.draw_prob + r.away_prob == 100
        assert r.pick != "DRAW" and r.home_prob <= 72
        assert r.draw_prob <= (27 if r.weather else 24)
        assert r.away_prob <= (56 if r.weather else 58)


STANDINGS = [
    ("鹿島", 2, 39, 15), ("神戸", 6, 31, 5), ("横浜Ｆ", 9, 26, 0), ("川崎", 8, 27, 3),
    ("浦和", 4, 35, 10), ("ＦＣ東京", 12, 22, -9), ("鹿島", 20, 0, -40),
]


def test_model_b_golden_rows(spark):
    fixtures = spark.createDataFrame(
        [(1, "鹿島", "神戸"), (2, "横浜F", "川 崎"), (3, "浦和", "FC東京"), (4, "浦和", "大宮")],
        "match_no int, home_team string, away_team string",
    ).withColumn("round", F.lit("r"))
    standings = spark.createDataFrame(
        STANDINGS, "team_name string, rank int, points int, goal_difference int"
    )
    inputs = attach_standings(fixtures, standings)
    predicted = scoring.predict_model_b(inputs)
    rows = predicted.orderBy("match_no").collect()
    scores = [[f.score for f in r.factors] for r in rows]
    assert scores == [[10, 6, 7, 5], [-2, -1, -2, 5], [20, 10, 13, 5], [0, 0]]
    assert [(r.total_score, r.outcome, r.probability, r.confidence) for r in rows] == [
        (28, "HOME", 78, "S"), (0, "DRAW", 50, "C"), (49, "HOME", 78, "S"), (0, "DRAW", 40, "C"),
    ]
    assert rows[1].factors[0].description == "川崎が順位面で優位です。"
    assert [r.match_no for r in best_by_probability(predicted).collect()] == [1]


def test_model_b_bounds(spark):
    totals = spark.range(-60, 61).withColumn("total", F.col("id"))
    rows = totals.select(
        "total",
        scoring.model_b_outcome(F.col("total")).alias("outcome"),
        scoring.model_b_probability(F.col("total")).alias("p"),
    ).collect()
    for r in rows:
        assert 50 <= r.p <= 78
        assert r.outcome != "DRAW" or r.p <= 63
        assert (r.p == 78) == (abs(r.total) >= 23)


@pytest.mark.parametrize("form, points", [("WWDLW", 10), ("", 0), ("LLLLL", 0), ("DX", 1)])
def test_form_points(one, form, points):
    assert one(scoring.form_points, form) == points


def test_tiers_and_grades(one):
    tiers = [one(scoring.edge_tier, e, "int") for e in (15, 14, 9, 0, -1)]
    assert tiers == ["S", "A", "B", "C", "pass"]
    grades = [
        one(lambda p, e=e: scoring.designed_confidence(p, F.lit(e)), p, "int")
        for p, e in ((60, 10), (60, 9), (55, 6), (49, 20))
    ]
    assert grades == ["S", "A", "B", "C"]


def test_a_filter_on_a_score_stays_cheap(spark):
    """Filters on results must not copy the steps they were built from."""
    picked = model_a(spark, MATCHES).where("confidence = 'S' and pick_edge > 5")
    assert picked.count() == 1
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000
