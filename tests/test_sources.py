import pytest

from kickpool.operators.lookup import latest_snapshots, source_registry, with_source_url
from kickpool.sources.snapshots import land_snapshots, read_page_table, read_snapshot_files
from kickpool.sources.tables import query_table, read_row_snapshot, scan, write_row_snapshot
from kickpool.sources.text_tables import data_lines, read_plain_csv, read_quoted_csv


def written(tmp_path, text, name="x.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_quoted_csv(spark, tmp_path):
    text = (
        '﻿a, b ,c,a\r\n'
        '"1,5" , x ,"y ""z""",2\r\n'
        'p"q,r"s,short\n'
        '　w　,"open, to the end,x\n'
        '1,2,3,4,5,6\n\n'
    )
    df = read_quoted_csv(spark, written(tmp_path, text))
    assert df.columns == ["a", "b", "c"]
    assert rows(df) == [
        ("", "open, to the end,x", ""),  # the last column named a counts, and is missing here
        ("", "short", ""),
        ("2", "x", "y z"),
        ("4", "2", "3"),
    ]


def test_quoted_csv_keeps_inner_quoting(spark, tmp_path):
    df = read_quoted_csv(spark, written(tmp_path, 'k,v\np"q,r"s,1\n"a,b",\n'))
    assert rows(df) == [("a,b", ""), ("pq,rs", "1")]


def test_long_quoted_field(spark, tmp_path):
    long = "x," * 50_000
    df = read_quoted_csv(spark, written(tmp_path, f'k,v\n"{long}",1\n'))
    assert rows(df) == [(long, "1")]


def test_plain_csv(spark, tmp_path):
    df = read_plain_csv(spark, written(tmp_path, 'k , v\r\n"a,b"\r\n\r\n c \r\n1,2,3\r\n'))
    assert df.columns == ["k", "v"]
    assert rows(df) == [('"a', 'b"'), ("1", "2"), ("c", "")]


def test_several_files_each_with_header(spark, tmp_path):
    paths = [written(tmp_path, f"k\n{i}\n", f"{i}.csv") for i in range(3)]
    assert rows(read_plain_csv(spark, paths)) == [("0",), ("1",), ("2",)]


def test_snapshot_files_and_latest(spark, tmp_path):
    (tmp_path / "alpha.html").write_text("<title>A\n</title>")
    (tmp_path / "beta.html").write_text("<b>")
    files = read_snapshot_files(spark, str(tmp_path))
    assert rows(files.select("source_key", "html")) == [
        ("alpha", "<title>A\n</title>"), ("beta", "<b>"),
    ]
    landed = str(tmp_path / "landed")
    versions = [("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), ("j", 1, "only")]
    for version in versions:
        land_snapshots(spark.createDataFrame([version], "key string, n int, html string"), landed)
    latest = latest_snapshots(read_page_table(spark, landed), ["key"], ["n"], "html")
    assert rows(latest.select("key", "html")) == [("j", "only"), ("k", "new")]


def test_registry_drops_unregistered_keys(spark):
    assert source_registry(spark).count() == 4
    keys = spark.createDataFrame([("jleagueMatches",), ("other",)], "source_key string")
    assert rows(with_source_url(keys)) == [("jleagueMatches", "https://www.jleague.jp/match/")]


def test_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id * 2 AS twice").write.parquet(path)
    assert rows(scan(spark, path, ("twice",), "id > 7")) == [(16,), (18,)]
    empty = scan(spark, None, schema=spark.range(1).schema)
    assert (empty.columns, empty.count()) == (["id"], 0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan(spark, str(tmp_path / "missing"))


def test_row_snapshot_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("", "b")], "x string, y string")
    path = str(tmp_path / "j")
    write_row_snapshot(df, path)
    assert set(map(tuple, read_row_snapshot(spark, path, df.schema).collect())) == {
        ("a", None), ("", "b"),
    }


def test_import_refuses_bad_rows(spark, tmp_path):
    from kickpool.functions.fixed_values import IMPORT_COLUMNS
    from kickpool.plans.jobs import import_matches_csv

    header = ",".join(IMPORT_COLUMNS)
    line = "第2回,{},,J1,,h,a" + "," * 20
    path = written(tmp_path, "\n".join([header, line.format(1), line.format("x")]))
    with pytest.raises(ValueError, match="not_null:match_no"):
        import_matches_csv(spark, path, str(tmp_path / "r"), str(tmp_path / "m"))
    good = written(tmp_path, "\n".join([header, line.format(1), line.format(2)]), "good.csv")
    import_matches_csv(spark, good, str(tmp_path / "r"), str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert rows(stored.select("round_no", "match_no", "weather", "home_rest_days")) == [
        ("第2回", 1, "未取得", None), ("第2回", 2, "未取得", None),
    ]
    assert rows(spark.read.parquet(str(tmp_path / "r")).select("title")) == [("第2回 toto",)]


def test_files_with_headers_of_their_own(spark, tmp_path):
    """Other order, other line ends, missing and repeated columns, blank lines first, no lines at all."""
    texts = ["a,b\n1,2\n3,\n", "b,a\r\n4,5\r\n\r\n6\r\n", "\n\r\na\n7", "a,b,c,a\n8,9,10,11", "", "a,b\r\n", "﻿a,b\r\n12,13"]
    paths = [written(tmp_path, text, f"{i}.csv") for i, text in enumerate(texts)]
    want = [("1", "2", None), ("3", "", None), ("5", "4", None), ("", "6", None), ("7", None, None), ("11", "9", "10"), ("12", "13", None)]
    for read in (read_plain_csv, read_quoted_csv):
        df = read(spark, paths)
        assert df.columns == ["a", "b", "c"]
        assert rows(df.na.fill("-")) == sorted(tuple("-" if v is None else v for v in r) for r in want)
    quoted = [written(tmp_path, 'k,"v,w"\n1,"x,y"\n', "q1.csv"), written(tmp_path, '"v,w",k\r\nz,2\r\n', "q2.csv")]
    assert rows(read_quoted_csv(spark, quoted).select("k", "`v,w`")) == [("1", "x,y"), ("2", "z")]


def test_one_layout_meets_no_join(spark, tmp_path):
    paths = [written(tmp_path, f"k,v{end}{i},x{end}", f"{i}.csv") for i, end in enumerate(("\n", "\r\n", "\n"))]
    df = read_plain_csv(spark, paths)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df) == [("0", "x"), ("1", "x"), ("2", "x")]


def test_a_file_of_many_blocks(spark, tmp_path):
    """Blocks after a file's first have no header of their own."""
    paths = [written(tmp_path, "a,b\n" + "".join(f"{i},x\n" for i in range(4_000)), "1.csv"), written(tmp_path, "b,a\ny,-1\n", "2.csv")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = read_plain_csv(spark, paths)
        assert data_lines(spark, paths).rdd.getNumPartitions() > 5
        assert rows(found) == sorted([(str(i), "x") for i in range(4_000)] + [("-1", "y")])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


ORDERS = "/root/testdata/sf0.001/orders.parquet"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_query_string_reaches_the_reader(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(query_table(spark, ORDERS, "select=o_orderkey&o_orderstatus=eq.F&o_totalprice=gt.200000&o_custkey=in.(1,2)"))
    assert "ReadSchema: struct<o_orderkey" in plan and "o_orderdate" not in plan
    for pushed in ("EqualTo(o_orderstatus,F)", "GreaterThan(o_totalprice,200000.0)", "In(o_custkey"):
        assert pushed in plan


def test_query_string_operators(spark, tmp_path):
    path = str(tmp_path / "t")
    shape = "n int, t string, d date, b boolean"
    from datetime import date

    some = [(1, "ab", date(2024, 1, 1), True), (2, "a,b", None, False), (3, None, date(2025, 1, 1), None), (None, "x y", None, True)]
    spark.createDataFrame(some, shape).write.parquet(path)

    def found(query):
        return [r.n for r in query_table(spark, path, query).collect()]

    for query, want in {
        "n=gte.2": [2, 3], "n=lt.2": [1], "n=lte.2": [1, 2], "n=neq.2": [1, 3], "n=not.eq.2": [1, 3], "t=is.null": [3],
        "t=not.is.null&n=not.is.null": [1, 2], "b=is.true&n=eq.1": [1], "b=is.false": [2], "b=eq.true&n=lt.9": [1], 'n=in.(1,3)': [1, 3],
        't=in.("a,b",zz)': [2], "t=like.a*": [1, 2], "t=ilike.*A*": [1, 2], "t=eq.x%20y": [None], "d=gt.2024-06-01": [3],
        "n=gt.0&n=lt.3": [1, 2], "n=not.in.(1,2)": [3],
    }.items():
        assert sorted(found(query), key=str) == sorted(want, key=str), query
    assert found("order=n.desc") == [None, 3, 2, 1] and found("order=n") == [1, 2, 3, None]
    assert found("order=n.desc.nullslast&limit=2") == [3, 2] and found("order=n.asc.nullsfirst&limit=1&offset=1") == [1]
    assert query_table(spark, path, "select=m:n,t").columns == ["m", "t"] and query_table(spark, path, "").columns == ["n", "t", "d", "b"]
    for wrong in ("select=zz", "zz=eq.1", "n=eq.x", "n=near.1", "d=eq.yesterday", "b=eq.7", "order=zz", "order=n.up", "limit=-1", "n=in.1,2", "n"):
        with pytest.raises(ValueError):
            query_table(spark, path, wrong)
    assert query_table(spark, None).count() == 0
    empty = query_table(spark, None, "select=n&n=eq.1", spark.read.parquet(path).schema)
    assert (empty.columns, empty.count()) == (["n"], 0)


def test_a_snapshot_landed_again_counts_once(spark, tmp_path):
    landed = str(tmp_path / "landed")
    shape = "key string, snapshot_id string, landed_at int, html string"
    batch = spark.createDataFrame([("k", "s1", 1, "old"), ("k", "s2", 2, "new"), ("j", "s3", 1, "only"), ("n", None, 1, "x")], shape)
    for _ in range(3):
        land_snapshots(batch, landed)
    land_snapshots(spark.createDataFrame([("k", "s1", 5, "old")], shape), landed)  # landed again later: the newest
    latest = latest_snapshots(read_page_table(spark, landed), ["key"])
    assert rows(latest.select("key", "html", "landed_at")) == [("j", "only", 1), ("k", "old", 5)]
    once = latest_snapshots(read_page_table(spark, landed), [])
    assert rows(once.select("snapshot_id", "html")) == [("s1", "old")]


def test_few_winners_are_sent_to_the_pages(spark, tmp_path):
    landed = str(tmp_path / "landed")
    spark.range(200).selectExpr("id % 5 AS key", "id AS snapshot_id", "id AS landed_at", "repeat('<p>', 5000) AS html").write.parquet(landed)
    latest = latest_snapshots(read_page_table(spark, landed), ["key"])
    assert latest.count() == 5
    plan = latest._jdf.queryExecution().executedPlan()
    latest.collect()
    text = plan.toString()
    assert "BroadcastHashJoin" in text and "ShuffledHashJoin" not in text
