from kickpool import session
from pyspark.sql import functions as F

from kickpool.operators.backtest import grain_backtest, round_backtest
from kickpool.operators.lookup import round_bundles
from kickpool.operators.positions import in_ranges, last_before, with_positions
from kickpool.operators.ranking import rank_by_ranges


def test_hot_group_and_ties_over_many_ranges(spark):
    """A third of the rows in one group, a third without a group, and many equal rows."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(9_000).selectExpr(
            "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN NULL ELSE concat('g', id % 300) END AS g",
            "CASE WHEN id % 2 = 0 THEN 7 ELSE id % 40 END AS v",
            "id",
        )
        got = with_positions(rows, ["g"], [F.col("v").desc()])
        assert got.columns == ["g", "v", "id", "position", "size"]
        got = got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(r.id for r in got) == list(range(9_000))
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    assert len(groups["hot"]) == len(groups[None]) == 3_000
    for found in groups.values():
        found.sort(key=lambda r: r.position)
        assert [r.position for r in found] == list(range(len(found)))
        assert [r.v for r in found] == sorted((r.v for r in found), reverse=True)
        assert {r.size for r in found} == {len(found)}


def test_no_group_and_no_rows(spark):
    rows = spark.range(100).selectExpr("99 - id AS v")
    assert all(r.position == r.v and r.size == 100 for r in with_positions(rows, [], [F.col("v")]).collect())
    assert with_positions(rows.where("v < 0"), ["v"], [F.col("v")]).count() == 0


def small_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    return lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_as_of_join_with_a_hot_key(spark):
    """Nine tenths of all rows under one key, captures rare, ties in time, missing keys and times."""
    reset = small_ranges(spark)
    try:
        rows = spark.range(6_000).selectExpr(
            "CASE WHEN id % 10 > 0 THEN 'hot' WHEN id % 20 = 0 THEN concat('k', id % 70) END AS k",
            "CASE WHEN id % 31 > 0 THEN CAST(id * 37 % 1000 AS int) END AS t", "id", "'own' AS v2",
        )
        captures = spark.range(60).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('k', id % 70) END AS k",
            "CASE WHEN id % 11 > 0 THEN CAST(id * 53 % 900 AS int) DIV 50 * 50 END AS t", "id AS v",
        )
        got = last_before(rows, captures, ["k"], "t", "t", ["v"])
        assert got.columns == ["k", "t", "id", "v2", "v"]
        got = got.collect()
    finally:
        reset()
    known = [r for r in captures.collect() if r.k is not None and r.t is not None]
    assert len(got) == 6_000 and len({r.id for r in got}) == 6_000
    for r in got:
        earlier = [(c.t, c.v) for c in known if c.k == r.k and r.t is not None and c.t <= r.t]
        assert r.v == (max(earlier)[1] if earlier else None)
    assert last_before(rows.limit(0), captures, ["k"], "t", "t", ["v"]).count() == 0
    assert last_before(rows.limit(9), captures.limit(0), ["k"], "t", "t", ["v"]).where("v IS NULL").count() == 9


def test_rank_of_real_values_in_a_hot_round(spark):
    reset = small_ranges(spark)
    try:
        df = spark.range(8_000).selectExpr(
            "CASE WHEN id % 10 > 0 THEN 'hot' ELSE concat('r', id % 70) END AS round", "id AS match_no",
            "CASE WHEN id % 17 > 0 THEN CASE WHEN id % 3 = 0 THEN 0.25D ELSE id * 7919 % 1009 / 7.0D END END AS score",
        )
        got = rank_by_ranges(df, ["round"], "score", ["match_no"])
        order = "PARTITION BY round ORDER BY score DESC NULLS LAST"
        want = df.selectExpr("*", f"CAST(rank() OVER ({order}) AS bigint) AS place", f"CAST(row_number() OVER ({order}, match_no) AS bigint) AS position")
        assert got.exceptAll(want).count() == 0 and got.count() == 8_000
        ranged = in_ranges(df, [F.col("round").asc(), F.col("score").desc()])
        largest = ranged.groupBy("_part").count().agg(F.max("count")).first()[0]
        assert largest < 8_000 * 0.4, "a round with nine tenths of the rows is many tasks"
    finally:
        reset()


def test_bundles_have_a_bound(spark):
    """5,000 fixtures of one round without a number, and as many of one number."""
    fixtures = spark.range(10_000).selectExpr("'第1回' AS round", "CASE WHEN id < 5000 THEN 7 END AS match_no", "concat('t', id) AS home_team")
    rounds = spark.createDataFrame([("第1回", "a", "b")], "round string, sales_start string, sales_end string")
    bundles = round_bundles(fixtures, rounds, ("match_no", "home_team")).select("bundle_no", "sales_end", F.inline("fixtures"))
    found = bundles.collect()
    assert len({r.home_team for r in found}) == len(found) == 10_000 and {r.sales_end for r in found} == {"b"}
    sizes = {}
    for r in found:
        sizes[r.bundle_no] = sizes.get(r.bundle_no, 0) + 1
    assert sizes == {i: 1_000 for i in range(10)}
    assert all(r.match_no is None for r in found if r.bundle_no < 5)


def test_grains_are_the_single_backtests(spark):
    rows = spark.range(3_000).selectExpr(
        "CASE WHEN id % 7 > 0 THEN concat('s', id % 3) END AS season", "CASE WHEN id % 5 > 0 THEN id % 4 END AS tier",
        "CASE WHEN id % 2 = 0 THEN 'HOME' ELSE 'AWAY' END AS pick", "id % 21 - 10 AS pick_edge",
        "CASE WHEN id % 13 > 0 THEN CASE WHEN id % 3 = 0 THEN 'home' ELSE 'away' END END AS result_outcome",
    )
    got = grain_backtest(rows, [["season"], ["tier"], ["season", "tier"], []]).drop("positive_hit_rate").collect()
    assert len(got) == len({(r.grain, r.season, r.tier) for r in got})
    for grain in (["season"], ["tier"]):
        one = {r[grain[0]]: tuple(r)[1:] for r in round_backtest(rows, grain[0]).collect()}
        assert one == {r[grain[0]]: tuple(r)[3:] for r in got if r.grain == grain[0]}
    total = [r for r in got if r.grain == "total"]
    assert len(total) == 1 and total[0].match_count == rows.where("result_outcome IS NOT NULL").count()
    assert sum(r.match_count for r in got if r.grain == "season+tier") == total[0].match_count
    assert grain_backtest(rows.limit(0), [["season"], []]).count() == 0


def test_written_copies_can_be_released(spark):
    import os

    since = len(session.MADE)
    kept = session.fresh_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with_positions(spark.range(5).selectExpr("id AS v"), [], [F.col("v")]).collect()
    made = session.MADE[since:]
    assert len(made) == 2 and all(os.path.exists(p.removeprefix("file:")) for p in made)
    session.release(spark, since, keep=[kept])
    assert session.MADE[since:] == [kept] and [os.path.exists(p.removeprefix("file:")) for p in made] == [True, False]
