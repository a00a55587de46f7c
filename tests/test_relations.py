"""Lookup, ranking, pages, upsert and constraints on small inputs with all their corners."""

import pytest
from pyspark.sql import functions as F, types as T

from kickpool.functions import fixed_values as fv
from kickpool.operators import backtest, constraints, html_tables, lookup, pages, ranking, upsert
from kickpool.plans.rendered_pages import MENU
from kickpool.sources import schemas


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def html_pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page int, html string")


def test_schedule(spark):
    page = html_pages(
        spark,
        "<p>販売中</p> 第1640回 （2026/6/27-2026/7/4） <b>第1639回</b>（2026/6/1-2026/6/5）"
        "<style>終了 第1回（2026/1/1-2026/1/2）</style>",
        "終了　第7回&nbsp;（2025/1/1-2025/1/2）終了第6回（2025/1/1-2025/1/2）",
        "nothing",
    )
    found = pages.schedule_rounds(page, "page")
    assert rows(found, "page", "pos", "round", "status") == [
        (0, 0, "第1640回", "open"), (0, 1, "第1639回", "unknown"),
        (1, 0, "第7回", "closed"), (1, 1, "第6回", "closed"),
    ]
    expected = [(0, "第1640回"), (1, "第7回")]
    assert rows(pages.latest_rounds(page, "page"), "page", "round") == expected
    assert rows(ranking.latest_round(found, "page"), "page", "round") == expected
    assert pages.first_rounds(found, 1).count() == 2


def test_titles_and_health(spark):
    page = html_pages(
        spark, "<TITLE> a　</title>", "<title></title>", "<title>a\nb</title>", None
    )
    health = pages.page_health(page, clock=True)
    assert rows(health, "page", "title", "text_length", "ok", "error_message") == [
        (0, "a", 18, True, None), (1, "", 15, True, None), (2, "No title", 18, True, None),
        (3, "Fetch failed", 0, False, "Unknown fetch error"),
    ]
    assert health.where("fetched_at is null").count() == 0


def test_plain_text_variants(spark):
    html = "a<SCRIPT>x</script>b<style>y</style>c&nbsp;&amp;<i>d</i>\n　e"
    texts = html_pages(spark, html).select(
        *(pages.plain_text("html", v).alias(v) for v in ("main", "standings", "votes"))
    ).first()
    assert tuple(texts) == ("abc & d e", "ab c & d e", "a x b c &amp; d e")


def test_keyword_contexts(spark):
    text = spark.createDataFrame([(1, "aa" * 30), (2, "none"), (3, "x.y.x")], "id int, text string")
    hits = pages.keyword_contexts(text, "aaa", "id", before=1, after=4)
    assert hits.count() == 20
    assert rows(hits.where("hit_no <= 2"), "hit_no", "position", "context") == [
        (1, 0, "aaaa"), (2, 3, "aaaaa"),
    ]
    assert rows(pages.keyword_contexts(text, ".", "id"), "id", "position") == [(3, 1), (3, 3)]


def test_dictionary(spark):
    text = spark.createDataFrame([(1, "x鹿島 3 -4 浦和 5")], "id int, text string")
    found = pages.dictionary_extract(text, ["浦和", "鹿島", "神戸"], "id", before=2, after=6)
    assert rows(found, "term", "before", "numbers") == [("浦和", "4 ", [5]), ("鹿島", "x", [3])]
    first = pages.keyword_first_hits(text, ["浦和", "神戸"], "id", before=1, after=2)
    assert rows(first, "term", "found", "context") == [("浦和", True, " 浦和"), ("神戸", False, None)]


def test_standard_dictionaries(spark):
    text = spark.createDataFrame([(1, "1 鹿島アントラーズ 40 -3 2 ＦＣ東京 38")], "id int, text string")
    found = pages.dictionary_extract(text, fv.TEAM_NAMES, "id")
    assert rows(found, "term", "numbers") == [
        ("鹿島アントラーズ", [40, -3, 2, 38]), ("ＦＣ東京", [38]),
    ]
    hits = pages.keyword_first_hits(text, fv.DETAIL_KEYWORDS, "id").where("found")
    assert rows(hits, "term") == [("鹿",), ("ＦＣ",)]


FIXTURES = (
    "<tr><th>d<td>v<td>1<td>Ｆ 東京<td>1-0<td>鹿 島<td>1"
    "<tr><td>d<td>v<td>2<td>h<td><td>a<td>9"  # unplayed: the pool result moves to away
    "<tr><td>d<td>v<td>x<td>h<td>1-1<td>a"  # no number
    "<tr><td>d<td>v<td>3<td>h"  # too short
)


def test_fixture_extraction(spark):
    page = html_pages(spark, f"{MENU}{MENU}<table><thead><tr><td>1<td>2<td>3<td>4<td>5<td>6</thead>"
                      f"<tbody>{FIXTURES}</table>", MENU + MENU)
    found = html_tables.extract_fixtures(page, "page")
    assert rows(found, "match_no", "home_team", "away_team", "kickoff", "venue") == [
        (1.0, "Ｆ東京", "鹿島", "d", "v"), (2.0, "h", "9", "d", "v"),
    ]
    results = html_tables.extract_results(page, "page")
    assert rows(results, "match_no", "result", "pool_result") == [
        ("1", "1-0", "1"), ("2", "a", None), ("x", "1-1", None),
    ]


def test_standings_extraction(spark):
    filler = "<td>" * 7
    page = html_pages(
        spark,
        f"<table><tr>{'<td>1' * 12}</table><table>"
        f"<tr><td><td>2<td><a>x<span>ＦＣ 東京</span></a><td>30{filler}<td>-4"
        f"<tr><td><td>1<td><a> 鹿島 </a>z<td>40{filler}<td>+9"
        f"<tr><td><td>-<td>none<td>1{filler}<td>1<tr><td>1</table>",
    )
    found = html_tables.sort_standings(html_tables.extract_standings(page, "page"))
    assert [tuple(r)[3:] for r in found.collect()] == [(1, "鹿島", 40, 9), (2, "FC東京", 30, -4)]


def test_links(spark):
    page = html_pages(spark, "<a href=/toto>x</a><a>第1回</a><a href='/z'>y</a>")
    found = html_tables.followed_links(html_tables.links(page, "page"))
    assert rows(found, "link_idx", "text", "href") == [(0, "x", "/toto"), (1, "第1回", "")]


def test_rank_by_counts_equals_rank(spark):
    df = spark.range(2000).selectExpr("id", "id % 3 AS g", "cast(hash(id) % 7 AS int) AS a")
    ranked = ranking.rank_by_counts(df, ["g"], ["a"], size="n")
    expected = df.selectExpr(
        "id", "rank() OVER (PARTITION BY g ORDER BY a DESC) AS place", "count(*) OVER (PARTITION BY g) AS n"
    )
    assert rows(ranked, "id", "place", "n") == rows(expected)


def test_first_match_wins(spark):
    standings = spark.createDataFrame(
        [("A B", 3, 1, 1), ("AB", 2, 2, 2), ("Ａ", 1, 3, 3)],
        "team_name string, rank int, points int, goal_difference int",
    )
    first = lookup.first_standing_per_name(standings, [])
    assert rows(first, "name_key", "rank") == [("AB", 2), ("Ａ", 1)]


def test_round_bundles_are_blocks(spark):
    fixtures = spark.range(1, 26).selectExpr("'第1回' AS round", "id AS match_no")
    rounds = spark.createDataFrame([("第1回", "a", "b")], "round string, sales_start string, sales_end string")
    bundles = lookup.round_bundles(fixtures, rounds, ("match_no",), per_bundle=13)
    sizes = bundles.select("bundle_no", F.size("fixtures"), "sales_end")
    assert rows(sizes) == [(0, 13, "b"), (1, 12, "b")]


def test_round_fallback(spark):
    df = spark.createDataFrame(
        [("p", False, "m"), (None, False, "m"), ("p", True, "m"), ("p", True, None)],
        "p string, failed boolean, m string",
    )
    label = lookup.round_label_or_fallback(F.col("p"), F.col("failed"), F.col("m"))
    assert [r[0] for r in df.select(label).collect()] == ["p", "第XXXX回", "m", "第XXXX回"]


TARGET = "round string, match_no bigint, venue string, weather string, rest int"


def stored(spark):
    return spark.createDataFrame(
        [("r1", 1, "a", "w", 3), ("r1", 2, "b", None, 4), ("r2", 1, "c", "w", 4)], TARGET
    )


def test_merge(spark):
    payload = spark.createDataFrame(
        [("r1", 2, None), ("r3", 1, "n")], "round string, match_no bigint, venue string"
    )
    merged = upsert.merge_rows(stored(spark), payload, ["round", "match_no"], {"rest": 5})
    assert rows(merged) == [
        ("r1", 1, "a", "w", 3), ("r1", 2, None, None, 4), ("r2", 1, "c", "w", 4),
        ("r3", 1, "n", None, 5),
    ]


def test_upsert_table_rewrites_only_touched_rounds(spark, tmp_path):
    path = str(tmp_path / "m")
    stored(spark).write.partitionBy("round").parquet(path)
    untouched = {p.name for p in (tmp_path / "m" / "round=r2").glob("*.parquet")}
    payload = spark.createDataFrame(
        [("r1", 2, "x"), ("r3", 1, "n")], "round string, match_no bigint, venue string"
    )
    for _ in range(2):  # the second run changes nothing
        upsert.upsert_table(path, payload, ["round", "match_no"], "round", {"rest": 5})
    spark.catalog.refreshByPath(path)
    assert rows(spark.read.parquet(path), "round", "match_no", "venue", "weather", "rest") == [
        ("r1", 1, "a", "w", 3), ("r1", 2, "x", None, 4), ("r2", 1, "c", "w", 4),
        ("r3", 1, "n", None, 5),
    ]
    assert {p.name for p in (tmp_path / "m" / "round=r2").glob("*.parquet")} == untouched
    twice = payload.unionAll(payload)
    with pytest.raises(ValueError, match="duplicate"):
        upsert.upsert_table(path, twice, ["round", "match_no"], "round")


def test_defaults_only_for_absent_columns(spark):
    df = spark.createDataFrame([(1, None)], "match_no int, weather string")
    row = upsert.with_column_defaults(df, upsert.MATCH_DEFAULTS).first()
    assert (row.weather, row.home_rest_days, row.away_injury_level) == (None, 5, 0)


def test_constraints(spark):
    df = spark.createDataFrame(
        [("r", 1, "h", "home"), ("r", 1, None, "lost"), (None, 2, "h", None), ("s", 3, "h", "draw")],
        "round string, no int, home string, result string",
    )
    found = constraints.violations(
        constraints.row_violations(df, "t", ["round", "no"], ["round", "home"], {"result": ["home", "draw"]}),
        constraints.unique_violations(df, "t", ["round", "no"]),
        constraints.reference_violations(df, df.where("round = 'r'"), "t", ["round"], ["round", "no"]),
    )
    assert rows(found, "rule", "row_key", "row_count") == [
        ("allowed:result", "r|1", 1), ("not_null:home", "r|1", 1), ("not_null:round", "|2", 1),
        ("reference:round", "s|3", 1), ("unique:round,no", "r|1", 2),
    ]
    kept = constraints.cascade_delete(df, df.where("round = 'r'").select("round").distinct(), ["round"])
    assert rows(kept, "no") == [(1,), (1,), (2,)]


def test_backtest(spark):
    df = spark.createDataFrame(
        [("a", "HOME", "home", 5), ("a", "AWAY", "1", -1), ("a", "AWAY", None, 9), ("b", "DRAW", "0", 0)],
        "round string, pick string, result_outcome string, pick_edge int",
    )
    per_round = backtest.round_backtest(df)
    assert rows(per_round, "round", "match_count", "hit_count", "accuracy", "average_edge") == [
        ("a", 2, 1, 0.5, 2.0), ("b", 1, 1, 1.0, 0.0),
    ]
    total = backtest.overall_backtest(per_round).first()
    assert (total.hit_rate, total.best_hits, total.positive_hit_rate) == (2 / 3, 1, 1.0)
    assert total.mean_hits_per_13 == 26 / 3


def test_inspection(spark):
    from kickpool.plans.jobs import inspect_pages

    filler = "<td>" * 7
    landed = spark.createDataFrame(
        [
            ("yahooSchedule", "<title>s</title>終了 第1回 （2026/1/1-2026/1/2）"),
            ("jleagueStandings", f"<table></table><table><tr><td><td>1<td>鹿島<td>9{filler}<td>3</table>"),
            ("rakutenSchedule", None),
        ],
        "source_key string, html string",
    )
    report = inspect_pages(landed)
    assert rows(report["health"], "source_key", "ok") == [
        ("jleagueStandings", True), ("rakutenSchedule", False), ("yahooSchedule", True),
    ]
    assert rows(report["rounds"], "round", "status") == [("第1回", "closed")]
    assert rows(report["latest_round"], "round") == [("第1回",)]
    assert rows(report["standings"], "team_name", "rank") == [("鹿島", 1)]
    assert rows(report["counts"]) == [("jleagueStandings", "standings", 1), ("yahooSchedule", "rounds", 1)]


def test_table_rules(spark):
    matches = spark.createDataFrame([("r", 1), ("r", 2)], "round_no string, match_no int")
    good = ("r", 1, "v", 50.0, 20.0, 30.0, "home", "A", 5.0, "[]")
    bad = ("r", 3, "v", None, 20.0, 30.0, "none", "A", 5.0, "[]")
    df = spark.createDataFrame([good, good, bad], schemas.PREDICTIONS)
    found = constraints.table_violations(df, "predictions", {"matches": matches})
    assert rows(found, "rule", "row_key", "row_count") == [
        ("allowed:pick", "r|3|v", 1), ("not_null:home_prob", "r|3|v", 1),
        ("reference:round_no,match_no", "r|3|v", 1),
        ("unique:round_no,match_no,model_version", "r|1|v", 2),
    ]
    stored = spark.createDataFrame([], schemas.MATCHES)
    assert set(fv.IMPORT_COLUMNS) <= set(stored.columns)


TEXT_ROUNDS = ["01", "1", "1e3", "2024-01-01", "true", "007", "a b"]


@pytest.mark.parametrize("schema", [None, "round string, match_no int, venue string"])
def test_upsert_keeps_rows_of_rounds_that_look_like_other_types(spark, tmp_path, schema):
    path, key = str(tmp_path / "t"), ["round", "match_no"]
    shape = "round string, match_no int, venue string"
    first = [(r, n, "old") for r in TEXT_ROUNDS for n in (1, 2)]
    assert upsert.upsert_table(path, spark.createDataFrame(first, shape), key, "round", None, schema) == {
        "inserted": 14, "updated": 0, "unchanged": 0,
    }
    later = [(r, n, venue) for r in TEXT_ROUNDS for n, venue in ((2, "new"), (3, "more"))] + [("01", 1, "old")]
    assert upsert.upsert_table(path, spark.createDataFrame(later, shape), key, "round", None, schema) == {
        "inserted": 7, "updated": 7, "unchanged": 1,
    }
    stored = upsert.stored_table(spark, path, partitions={"round": T.StringType()})
    want = [(r, n, v) for r in TEXT_ROUNDS for n, v in ((1, "old"), (2, "new"), (3, "more"))]
    assert sorted(map(tuple, stored.select("round", "match_no", "venue").collect())) == sorted(want)


def test_upsert_counts_without_rows_and_without_partitions(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k string, x string"
    none = spark.createDataFrame([], shape)
    assert upsert.upsert_table(path, none, ["k"]) == {"inserted": 0, "updated": 0, "unchanged": 0}
    some = spark.createDataFrame([("1", "a"), ("2", None)], shape)
    assert upsert.upsert_table(path, some, ["k"])["inserted"] == 2
    assert upsert.upsert_table(path, some, ["k"]) == {"inserted": 0, "updated": 0, "unchanged": 2}
    assert upsert.upsert_table(path, none, ["k"]) == {"inserted": 0, "updated": 0, "unchanged": 0}
    changed = spark.createDataFrame([("2", "b"), ("3", None)], shape)
    assert upsert.upsert_table(path, changed, ["k"]) == {"inserted": 1, "updated": 1, "unchanged": 0}
    assert sorted(map(tuple, upsert.stored_table(spark, path).collect())) == [("1", "a"), ("2", "b"), ("3", None)]


def test_a_complete_copy_is_read_until_it_has_the_tables_name(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k string, x string"
    spark.createDataFrame([("1", "old")], shape).write.parquet(path)
    spark.createDataFrame([("1", "new")], shape).write.parquet(path + upsert.NEXT)
    assert upsert.stored_table(spark, path).first().x == "new"
    upsert.recover(spark, path)
    assert upsert.stored_table(spark, path).first().x == "new" and not (tmp_path / ("t" + upsert.NEXT)).exists()


def test_interrupted_move_of_partitions_is_finished(spark, tmp_path):
    path, key, shape = str(tmp_path / "t"), ["round", "match_no"], "round string, match_no int, venue string"
    spark.createDataFrame([(r, 1, "old") for r in ("01", "02", "03", "a/b:c%")], shape).write.partitionBy("round").parquet(path)
    # As after a crash in the middle of the move: one partition is there already, one not yet.
    spark.createDataFrame([("02", 1, "new"), ("a/b:c%", 1, "new")], shape).write.partitionBy("round").parquet(path + upsert.PARTS)
    upsert.remove_folder(spark, f"{path}/round=02")
    (tmp_path / ("t" + upsert.PARTS) / "round=02").rename(tmp_path / "t" / "round=02")
    assert upsert.upsert_table(path, spark.createDataFrame([("03", 1, "newer")], shape), key, "round")["updated"] == 1
    stored = upsert.stored_table(spark, path, partitions={"round": T.StringType()}).select("round", "venue")
    assert sorted(map(tuple, stored.collect())) == [("01", "old"), ("02", "new"), ("03", "newer"), ("a/b:c%", "new")]
    assert not (tmp_path / ("t" + upsert.PARTS)).exists()
