from kickpool.operators.upsert import stored_table
from kickpool.operators import pages
from kickpool.streaming.landing import PAGE_SCHEMA, page_stream, upsert_stream
from pyspark.sql import types as T


def test_page_operators_on_a_stream(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    html = "販売中 第1640回 （2026/6/27-2026/7/4）"
    frame = spark.createDataFrame([("s1", "k", None, html), ("s2", "k", None, None)], PAGE_SCHEMA)
    frame.write.parquet(landed)
    rounds = pages.latest_rounds(page_stream(spark, landed), "snapshot_id")
    query = (
        rounds.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert [tuple(r)[:2] for r in spark.read.parquet(out).collect()] == [("s1", "第1640回")]


def test_upsert_stream(spark, tmp_path):
    table, source = str(tmp_path / "t"), str(tmp_path / "s")
    schema = "round string, match_no bigint, venue string, seen int"
    before = [("r1", 1, "old", 0), ("r1", 2, "kept", 1), ("r1", 3, "newer", 9)]
    spark.createDataFrame(before, schema).write.partitionBy(
        "round"
    ).parquet(table)
    late = schema
    arrived = [("r1", 1, "b", 2), ("r1", 1, "a", 1), ("r2", 1, "n", 1), ("r1", 3, "older", 4)]
    spark.createDataFrame(arrived, late).coalesce(
        1
    ).write.parquet(source)
    stream = spark.readStream.schema(late).parquet(source)
    query = upsert_stream(stream, table, str(tmp_path / "c"), ["round", "match_no"], "round", "seen")
    query.awaitTermination(120)
    spark.catalog.refreshByPath(table)
    result = spark.read.parquet(table).select("round", "match_no", "venue").collect()
    assert sorted(map(tuple, result)) == [
        ("r1", 1, "b"), ("r1", 2, "kept"), ("r1", 3, "newer"), ("r2", 1, "n"),
    ]


def test_upsert_stream_keeps_rounds_that_look_like_numbers(spark, tmp_path):
    table, source = str(tmp_path / "t"), str(tmp_path / "s")
    schema = "round string, match_no bigint, venue string, seen int"
    rounds = ["01", "1", "1e3", "2024-01-01"]
    spark.createDataFrame([(r, n, "old", 0) for r in rounds for n in (1, 2)], schema).write.partitionBy("round").parquet(table)
    spark.createDataFrame([(r, 3, "new", 1) for r in rounds], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    upsert_stream(stream, table, str(tmp_path / "c"), ["round", "match_no"], "round", "seen").awaitTermination(120)
    found = stored_table(spark, table, partitions={"round": T.StringType()}).select("round", "match_no").collect()
    assert sorted(map(tuple, found)) == sorted((r, n) for r in rounds for n in (1, 2, 3))
