"""Operators in other shapes than the registered queries: no keys, repeats, nulls, ties, crashes."""

import pytest
from pyspark.sql import functions as F

from kickpool.operators import html_tables, lookup, markup, ranking, scoring, upsert
from kickpool.plans import jobs
from kickpool.sources import schemas
from kickpool.sources.text_tables import read_plain_csv, read_quoted_csv

MENU = "<table><tr><td>menu</table>"
FILL = "<td>" * 7


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def detail(*games):
    body = "".join(f"<tr><td>d<td>v<td>{n}<td>{h}<td>1-0<td>{a}" for n, h, a in games)
    return f"{MENU}{MENU}<table><tbody>{body}</table>"


def table_of(*teams):
    body = "".join(f"<tr><td><td>{rank}<td>{name}<td>{points}{FILL}<td>{gap}" for rank, name, points, gap in teams)
    return f"{MENU}<table>{body}</table>"


GOOD = table_of((2, "鹿島", 39, 15), (6, "浦和", 31, 5))


def test_extractors_without_keys(spark):
    pages = spark.createDataFrame([(detail((1, "鹿島", "浦和")),)], "html string")
    assert rows(html_tables.extract_fixtures(pages), "match_no", "home_team") == [(1.0, "鹿島")]
    assert rows(html_tables.extract_results(pages), "result") == [("1-0",)]
    standings = spark.createDataFrame([(GOOD,)], "html string")
    assert rows(html_tables.extract_standings(standings), "rank", "points") == [(2, 39), (6, 31)]
    assert html_tables.table_cells(pages).count() == 8
    assert rows(html_tables.table_previews(pages), "row_count") == [(1,), (1,), (1,)]
    links = spark.createDataFrame([("<a href=/x>t</a>",)], "html string")
    assert rows(html_tables.links(links)) == [(0, "t", "/x")]
    assert html_tables.dom_text(links).first().text == "t"
    dump = html_tables.rows_with_keyword(pages, "浦和")
    assert rows(dump, "page_row_idx", "cell_idx", "text")[5] == (2, 5, "浦和")


def test_job_without_scope_scores_the_fixture(spark):
    details = spark.createDataFrame([("第1回", detail((1, "鹿島", "浦和")))], "round string, html string")
    standings = spark.createDataFrame([(GOOD,)], "html string")
    best = jobs.best_picks(details, standings).first()
    assert (best.outcome, best.probability) == ("HOME", 78)


def test_equal_picks_follow_the_page(spark):
    page = detail((9, "鹿島", "浦和"), (2, "鹿島", "浦和"))
    details = spark.createDataFrame([("第1回", page)], "round string, html string")
    standings = spark.createDataFrame([(GOOD,)], "html string")
    assert jobs.best_picks(details, standings).first().match_no == 9


def test_current_round_on_newest_snapshots(spark):
    landing = "snapshot_id string, landed_at int, html string"
    schedules = spark.createDataFrame(
        [("s1", 1, "販売中 第7回 （2026/1/1-2026/1/2）"), ("s2", 2, "終了 第8回 （2026/1/1-2026/1/2） 販売中 第9回 （2026/1/3-2026/1/4）")],
        landing,
    )
    details = spark.createDataFrame(
        [("7", "d1", 1, detail((1, "浦和", "鹿島"))), ("9", "d2", 1, detail((5, "浦和", "鹿島"))), ("9", "d3", 2, detail((6, "鹿島", "浦和")))],
        "round_number string, " + landing,
    )
    standings = spark.createDataFrame(
        [("t1", None, table_of((1, "浦和", 90, 40), (20, "鹿島", 1, -40))), ("t2", 1, GOOD)], landing
    )
    best = jobs.current_round_picks(schedules, details, standings).collect()
    assert [(b.round, b.match_no, b.outcome, b.probability, b.status) for b in best] == [("第9回", 6.0, "HOME", 78, "open")]


def test_one_newest_snapshot_per_key(spark):
    pages = spark.createDataFrame(
        [("a", None, "1"), ("b", 1, "2"), ("b", 1, "3"), ("b", None, "9"), (None, 5, "4"), (None, 6, "5")],
        "key string, landed_at int, snapshot_id string",
    )
    assert rows(lookup.latest_snapshots(pages, ["key"]), "key", "snapshot_id") == [("a", "1"), ("b", "3"), (None, "5")]
    assert rows(lookup.latest_snapshots(pages, []), "snapshot_id") == [("5",)]


def test_each_page_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    pages = spark.range(6).select(F.col("id"), F.lit(GOOD).alias("html"))

    def reader(html):
        read.add(1)
        yield from markup.wide_body_rows(html, 1, 12, (1, 2, 3, 11), 2)

    fields = "table_idx int, row_idx int, texts array<string>, anchor_text string, span_text string"
    body = html_tables.read_markup(pages, ("id",), fields, reader).withColumn("rank", F.col("row_idx"))
    html_tables.sort_standings(body, "id").collect()
    assert read.value == 6


def test_full_width_blanks_belong_to_values():
    assert list(markup.page_links("<a href=/x　y>t</a>")) == [(0, "t", "/x　y")]


CREATED = "round_no string, match_no int, home_team string, away_team string"


def test_upsert_keeps_the_schema(spark, tmp_path):
    path = str(tmp_path / "m")
    key = ["round_no", "match_no"]
    first = spark.createDataFrame([("007", 1.0, "h", "a"), ("007", 2.0, "h", "a")], "round_no string, match_no double, home_team string, away_team string")
    upsert.upsert_table(path, first, key, "round_no", upsert.MATCH_DEFAULTS, schemas.MATCHES)
    results = spark.createDataFrame([("007", 1, "home", 3)], "round_no string, match_no int, result_outcome string, result_home_score int")
    upsert.upsert_table(path, results, key, "round_no", None, schemas.MATCHES)
    spark.catalog.refreshByPath(path)
    stored = upsert.stored_table(spark, path, spark.createDataFrame([], schemas.MATCHES).schema)
    assert rows(stored, "round_no", "match_no", "home_team", "result_outcome", "home_rest_days") == [
        ("007", 1, "h", "home", 5), ("007", 2, "h", None, 5),
    ]
    assert dict(stored.dtypes)["kickoff"] == "timestamp"
    for bad, message in (
        (results.withColumn("new", F.lit(1)), "does not have"),
        (results.withColumn("round_no", F.lit(" ")), "incomplete"),
        (results.withColumn("match_no", F.lit(None).cast("int")), "incomplete"),
    ):
        with pytest.raises(ValueError, match=message):
            upsert.upsert_table(path, bad, key, "round_no", None, schemas.MATCHES)


def test_unknown_payload_columns_are_refused_without_a_schema(spark):
    target = spark.createDataFrame([(1, "a")], "k int, x string")
    with pytest.raises(ValueError, match="does not have"):
        upsert.merge_rows(target, target.withColumn("y", F.lit(1)), ["k"])


def test_interrupted_replacement_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    upsert.upsert_table(path, spark.createDataFrame([("1", "a"), ("2", "b")], "k string, x string"), ["k"])
    # As after a crash between the removal of the old table and the writing of the new one.
    spark.read.parquet(path).write.parquet(path + upsert.NEXT)
    upsert.remove_folder(spark, path)
    upsert.upsert_table(path, spark.createDataFrame([("2", "c")], "k string, x string"), ["k"])
    spark.catalog.refreshByPath(path)
    assert rows(spark.read.parquet(path), "k", "x") == [("1", "a"), ("2", "c")]
    assert not (tmp_path / ("r" + upsert.NEXT)).exists()
    # As after a crash while the copy was written: it is not complete and does not count.
    (tmp_path / ("r" + upsert.NEXT)).mkdir()
    upsert.upsert_table(path, spark.createDataFrame([("3", "d")], "k string, x string"), ["k"])
    spark.catalog.refreshByPath(path)
    assert rows(spark.read.parquet(path), "k") == [("1",), ("2",), ("3",)]


def test_staging_is_removed(spark, tmp_path):
    import glob

    from kickpool.session import shared_dir

    def staged():
        return set(glob.glob(shared_dir(spark).removeprefix("file:") + "/payload-*"))

    before = staged()
    upsert.upsert_table(str(tmp_path / "t"), spark.createDataFrame([("1", "a")], "k string, x string"), ["k"])
    with pytest.raises(ValueError):
        upsert.upsert_table(str(tmp_path / "t"), spark.createDataFrame([("", "a")], "k string, x string"), ["k"])
    assert staged() <= before


def test_blank_round_refuses_the_import(spark, tmp_path):
    from kickpool.functions.fixed_values import IMPORT_COLUMNS

    line = ",1,,J1,,h,a" + "," * 20
    path = tmp_path / "blank.csv"
    path.write_text("\n".join([",".join(IMPORT_COLUMNS), line]))
    with pytest.raises(ValueError, match="not_blank:round_no"):
        jobs.import_matches_csv(spark, str(path), str(tmp_path / "r"), str(tmp_path / "m"))


@pytest.mark.parametrize("reader", [read_plain_csv, read_quoted_csv])
def test_files_with_other_headers_are_read_by_name(spark, tmp_path, reader):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n3,4\n")
    assert rows(reader(spark, str(tmp_path)), "a", "b") == [("1", "2"), ("4", "3")]


def test_edges_have_a_whole_order(spark):
    made = [("r", n, 50, 20, 30, e, e, None) for n, e in ((3, 5), (1, 5), (2, 7))]
    df = spark.createDataFrame(
        made,
        "round string, match_no int, home_prob int, draw_prob int, away_prob int, home_edge int, draw_edge int, away_edge int",
    )
    found = ranking.edge_ranking(df)
    assert [(r.match_no, r.outcome, r.place, r.position) for r in found.orderBy("position").collect()] == [
        (2, "DRAW", 1, 1), (2, "HOME", 1, 2), (1, "DRAW", 3, 3), (1, "HOME", 3, 4), (3, "DRAW", 3, 5), (3, "HOME", 3, 6),
    ]


def test_design_gaps(spark):
    df = spark.createDataFrame([(2, 5, 3, -1)], "home_rank int, away_rank int, home_net_goals int, away_net_goals int")
    assert rows(scoring.design_gaps(df), "rank_gap", "net_gap") == [(3, 4)]
