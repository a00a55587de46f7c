from datetime import datetime, timedelta

from kickpool.operators.lookup import first_per_key
from kickpool.operators.upsert import stored_table
from kickpool.streaming.state import keep_best
from pyspark.sql import functions as F

SHAPE = "key string, n int, score double, landed_at timestamp, html string"
START = datetime(2026, 1, 1)


def row(key, n, score, hours, html):
    return (key, n, score, START + timedelta(hours=hours), html)


BATCHES = [
    [row("a", 1, 0.5, 0, "a1"), row("b", 1, None, 1, "b1"), row("a", 2, 0.7, 2, "a2"), row(None, 1, 0.1, 2, "none")],
    [row("a", 1, 0.5, 0, "a1"), row("a", 3, 0.7, 3, "a3"), row("b", 2, 0.2, 3, "b2"), row("c", None, 0.9, 3, "c")],  # repeats and more
    [row("b", 3, None, 4, "b3"), row("c", 1, 0.9, 1, "c1"), row("hot", 0, 0.0, 4, "h")] + [row("hot", i, i % 97 / 97, 4, f"h{i}") for i in range(1, 3_000)],
]


def run(spark, tmp_path, name, batches, order, **limits):
    source, table, checkpoint = (str(tmp_path / f"{name}-{part}") for part in ("s", "t", "c"))
    for batch in batches:
        spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)
        keep_best(stream, table, checkpoint, ["key"], order, "landed_at", **limits).awaitTermination(120)  # started anew each time
    return stored_table(spark, table)


def test_equals_the_batch_result_over_restarts_repeats_and_late_rows(spark, tmp_path):
    everything = spark.createDataFrame([r for b in BATCHES for r in b], SHAPE).where("key IS NOT NULL")
    order = [("score", "desc"), ("n", "desc")]
    batches = [[r for r in b if r[0] is not None] for b in BATCHES]
    found = run(spark, tmp_path, "best", batches, order)
    want = first_per_key(everything, ["key"], [F.col("score").desc_nulls_last(), F.col("n").desc_nulls_last()])
    assert sorted(map(tuple, found.select("key", "n", "html").collect())) == sorted(map(tuple, want.select("key", "n", "html").collect()))


def test_rows_too_late_are_dropped_and_keys_expire(spark, tmp_path):
    hours = 48
    batches = [
        [row("a", 1, 0.9, 0, "first"), row("b", 1, 0.9, 0, "kept")],
        [row("z", 1, 0.1, hours, "moves the time on")],
        [row("z", 2, 0.1, hours + 1, "again"), row("b", 2, 1.0, 1, "too late")],
        [row("a", 2, 0.2, hours + 2, "after expiry"), row("z", 3, 0.0, hours + 2, "worse")],
    ]
    found = run(spark, tmp_path, "late", batches, [("score", "desc")], late="1 hour", keep_seconds=3600)
    got = {r.key: r.html for r in found.collect()}
    assert got == {"a": "after expiry", "b": "kept", "z": "moves the time on"}
