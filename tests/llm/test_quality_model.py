import numpy as np
from conftest_data import MEDIUM
from kickpool.llm import quality_model as q
from kickpool.llm.common import table
from kickpool.llm.queries import QUERIES


def test_linear_time_identity():
    chance = np.random.default_rng(1)
    machine = q.Machine(0.3, chance.normal(size=q.SLOTS), chance.normal(size=(q.SLOTS, q.RANK)))
    rows = [q.slots_of(t)[0] for t in ("one two three", "", None, "A b! A b!\nA b!", "x # y")]
    got = machine.raw(rows)[0]
    for slots, value in zip(rows, got):
        x = q.values_of(slots)
        want = machine.bias + machine.linear[slots] @ x
        for i in range(len(slots)):
            for j in range(i + 1, len(slots)):
                want += machine.factors[slots[i]] @ machine.factors[slots[j]] * x[i] * x[j]
        assert abs(value - want) < 1e-9 * max(1, abs(want))


def test_fit_learns_a_pair_of_slots():
    chance = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(1500):
        a, b = chance.integers(0, 2, 2)
        rows.append(np.array(sorted({q.WORD_SLOTS + a, q.WORD_SLOTS + q.BINS + b})))
        labels.append(float(a == b))
    machine = q.fit(rows, np.array(labels), np.ones(len(rows)))
    assert (((machine.score(rows) >= 0.5) == np.array(labels)).mean()) > 0.95


def test_held_out_labels(spark):
    rows = QUERIES["op10_quality_model"](spark, MEDIUM).join(table(spark, MEDIUM, "labels"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert good and bad
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, 1), (0, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    machine = q.train(spark, odd_docs, labels)
    rows = q.score(spark, odd_docs, machine).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = q.keep_good(spark, odd_docs, machine)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.predicted for r in rows)
    assert q.score(spark, no_docs, machine).count() == 0
    untrained = q.train(spark, odd_docs, labels.limit(0))
    assert {round(r.score, 1) for r in q.score(spark, odd_docs, untrained).collect()} == {0.5}
    told = q.train(spark, odd_docs, labels, metadata=("source", "lang"))
    assert q.score(spark, odd_docs, told, metadata=("source", "lang")).count() == odd_docs.count()


def test_sample_is_the_lowest_hashes(spark):
    from kickpool.llm.common import HASH_RANGE, lowest_hashes
    from pyspark.sql import functions as F

    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 0).otherwise(1).alias("g"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    got = sorted((r.g, r.place, r.doc_id) for r in lowest_hashes(rows, "g", "doc_id", 50, sizes).collect())
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(HASH_RANGE))).collect()
    want = []
    for g in (0, 1):
        order = sorted((r.h, r.doc_id) for r in hashed if r.g == g)[:50]
        want += [(g, place, doc_id) for place, (_, doc_id) in enumerate(order, 1)]
    assert got == want
