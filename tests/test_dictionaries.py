from kickpool.operators import dictionaries

SHAPE = "k int, text string, term string, position string"


def brute(texts, terms, before, after):
    out = []
    for k, text in texts:
        for term in sorted({t for t in terms if t}):
            if text is not None and (at := text.find(term)) >= 0:
                out.append((k, term, at, text[max(at - before, 0) : at], text[at : at + after]))
    return sorted(out)


def test_overlaps_repeats_and_many_blocks(spark):
    texts = [(1, "ushers hershe"), (2, None), (3, ""), (4, "漢字😀he漢字"), (5, "he" * 50_000 + "xyz -12 and 7"), (6, "zz")]
    words = ["he", "she", "his", "hers", "s", "漢字", "字😀", "xyz", "he", "", None, "absent"] + [f"word{i}" for i in range(3_000)]
    frame = spark.createDataFrame([(*t, "x", "y") for t in texts], SHAPE)
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    want = brute(texts, words, 3, 20)
    for block_bytes in (1 << 20, 5_000):
        got = dictionaries.first_hits(frame, terms, "k", before=3, after=20, block_bytes=block_bytes)
        assert got.columns == ["k", "term", "position", "before", "after"]
        assert sorted(map(tuple, got.collect())) == want
    numbers = {r.term: r.numbers for r in dictionaries.table_extract(frame, terms, "k", after=14).collect() if r.k == 5}
    assert numbers["xyz"] == [-12, 7] and numbers["he"] == []


def test_blocks_are_bounded(spark):
    terms = spark.range(4_000).selectExpr("concat('term number ', id) AS term")
    blocks = dictionaries.term_blocks(terms, "term", 4_000)
    assert sum(map(len, blocks)) == 4_000 and max(sum(map(len, b)) for b in blocks) < 8_000


def test_empty_dictionary_and_no_texts(spark):
    frame = spark.createDataFrame([(1, "a", None, None)], SHAPE)
    none = spark.createDataFrame([("",), (None,)], "term string")
    assert dictionaries.first_hits(frame, none, "k").count() == 0
    some = spark.createDataFrame([("a",)], "term string")
    assert dictionaries.first_hits(frame.limit(0), some, "k").count() == 0


def test_numbers_are_sought_near_digits_only(spark):
    frame = spark.createDataFrame([(1, "ab none", None, None), (2, "ab 007 -2147483649 99999999999999999999", None, None)], SHAPE)
    terms = spark.createDataFrame([("ab",)], "term string")
    found = dictionaries.table_extract(frame, terms, "k")
    assert sorted((r.k, r.numbers) for r in found.collect()) == [(1, []), (2, [7, -2147483649, None])]
    assert "CASE WHEN RLIKE(after" in found._jdf.queryExecution().optimizedPlan().toString()
