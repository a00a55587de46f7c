"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F, types as T

from kickpool.functions import fixed_values as fv
from kickpool.operators import lookup, matches, ranking, upsert
from kickpool.plans.catalog import QUERIES
from kickpool.sources import schemas
from kickpool.sources.text_tables import read_plain_csv

SF = "/root/testdata/sf0.001"
EAGER = {
    "csv_dashboard", "csv_import", "csv_many_layouts", "csv_plain", "csv_quoted", "edge_ranking", "import_counts", "results_update",
    "round_bundle", "score_ranking", "votes_as_of_kickoff",
    "snapshot_roundtrip", "upsert_table", "upsert_text_rounds",
}
READS_MARKUP = {
    "current_round_picks", "followed_links", "html_cells", "html_fixtures", "html_results", "html_row_dump",
    "html_standings", "html_table_preview", "keyword_first_hit", "landed_page_best_picks",
    "landed_page_predictions", "page_dom_text", "page_links",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan(spark, name):  # Python runs in the reader of markup and the automaton of dictionaries only
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "RoundRobinPartitioning" not in plan
    assert ("MapInArrow" in plan) == (name in READS_MARKUP | {"dictionary_table_extract"})
    for spec in re.findall(r"windowspecdefinition\((.*)", plan):
        assert not re.match(r"[^,]* (ASC|DESC) NULLS", spec), "window without a partition key"


@pytest.mark.parametrize("name", ["best_pick_by_probability", "best_pick_by_edge", "first_standing"])
def test_first_of_group_is_limited_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert re.search(r"WindowGroupLimit .* Partial", plan)


def test_only_used_columns_are_read(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(QUERIES["page_snapshots_latest"](spark, SF))
    narrow = "ReadSchema: struct<page_id:bigint,url:string>"
    assert narrow in plan
    scan = plan_of(QUERIES["table_scan"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in scan and "GreaterThan(o_totalprice,200000.0)" in scan
    assert "o_custkey" not in scan


def test_hot_round_keeps_every_result(spark):
    """A third of all rows in one round: picks and places stay those of plain SQL."""
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('r', id % 500) END AS round",
        "id AS match_no",
        "cast(pmod(hash(id), 41) AS int) AS probability",
        "cast(pmod(hash(id), 41) AS int) - 20 AS edge",
    )
    best = ranking.best_by_probability(df)
    top = df.groupBy("round").agg(F.max("probability").alias("probability"))
    expected = df.join(top, ["round", "probability"]).groupBy("round").agg(F.min("match_no"))
    assert set(map(tuple, best.select("round", "match_no").collect())) == set(
        map(tuple, expected.collect())
    )
    ranked = ranking.rank_by_counts(df, ["round"], ["edge"])
    wanted = df.selectExpr("match_no", "rank() OVER (PARTITION BY round ORDER BY edge DESC) AS place")
    assert ranked.select("match_no", "place").exceptAll(wanted).count() == 0
    assert ranked.count() == 30_000


def test_lookup_gives_the_same_without_broadcast(spark):
    """With broadcasting off, a team in a third of all fixtures is looked up all the same."""
    fixtures = spark.range(9_000).selectExpr(
        "id AS match_no",
        "CASE WHEN id % 3 = 0 THEN 'hot team' ELSE concat('t', id % 50) END AS home_team",
        "concat('t', id % 70) AS away_team",
    )
    standings = spark.range(60).selectExpr(
        "CASE WHEN id = 59 THEN 'hotteam' ELSE concat('t', id) END AS team_name",
        "cast(id AS int) AS rank", "1 AS points", "2 AS goal_difference",
    )
    found = lookup.attach_standings(fixtures, standings)
    columns = ("match_no", "home_rank", "away_rank")
    expected = set(map(tuple, found.select(*columns).collect()))
    assert len(expected) == 9_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup.attach_standings(fixtures, standings).select(*columns)
        assert "BroadcastHashJoin" not in plan_of(joined)
        assert set(map(tuple, joined.collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_parsed_import_is_compiled(spark, tmp_path):
    """The JVM interprets methods of more than 8,000 bytes for ever."""
    (tmp_path / "x.csv").write_text(",".join(fv.IMPORT_COLUMNS) + "\n" + ",".join("1" * 27) + "\n")
    parsed = matches.import_projection(read_plain_csv(spark, str(tmp_path / "x.csv")))
    parsed = upsert.conformed(parsed, T.StructType.fromDDL(schemas.MATCHES))
    shown = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(parsed._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8_000
