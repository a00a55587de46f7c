import hashlib

import pytest

from compare import compare, oracle_connection
from conftest_data import SMALL
from kickpool.llm import warc
from kickpool.llm.queries import ORACLES, QUERIES
from kickpool.session import fresh_path

SCHEMA = "page_id bigint, url string, html string"


def test_against_sql(spark):
    assert compare(QUERIES["op9_warc"](spark, SMALL), oracle_connection(SMALL), ORACLES["op9_warc"]) == ""


def test_record_lines_in_payloads_and_long_payloads(spark):
    begin = "WARC/1.1\r\n"
    texts = [
        begin, "\r\n\r\n" + begin, begin * 5, "a\r\n\r\n" + begin + "WARC-Type: response\r\n\r\n", "\r\n" * 9, "é漢" * 100_000,
        "x" * (warc.CHUNK_BYTES - 4) + begin + "y" * warc.CHUNK_BYTES, "x" * 500_000, "\x00 \x85",
    ]
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nb", t) for i, t in enumerate(texts)], SCHEMA)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark, pages, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    for i, text in enumerate(texts):
        data = text.encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    chunks = {}
    for r in warc.stream_chunks(spark, path).orderBy("record_id", "chunk_no").collect():
        chunks.setdefault(r.record_id, []).append(r)
    assert sorted("".join(c.chunk for c in some) for some in chunks.values()) == sorted(texts)
    for some in chunks.values():
        sha = hashlib.sha1()
        for n, c in enumerate(some, 1):
            sha.update(c.chunk.encode())
            assert c.chunk_no == n and c.digest_so_far == f"sha1:{sha.hexdigest()}"
            assert len(c.chunk.encode()) <= warc.CHUNK_BYTES
    assert max(len(some) for some in chunks.values()) > 5


def test_files_are_archives(spark):
    """Plain reading by length: version line, header, block, two line ends."""
    import glob
    import gzip

    path = fresh_path(spark, "warc-test")
    pages = spark.createDataFrame([(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, None, None)], SCHEMA)
    warc.write_archives(spark, pages, path)
    kinds = []
    for name in glob.glob(f"{path}/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, data = data.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]
            kinds.append(fields[b"WARC-Type"])
    assert sorted(kinds) == [b"response", b"response", b"revisit"]


def test_odd_rows(spark):
    big, small = "b" * 1000, "s" * 999
    rows = [(1, None, big), (9, "u", big), (3, "u", big), (None, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (9, "u", big), (None, None, "c" * 2000), (None, None, "c" * 2000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", digest string, refers_to string")
    got = warc.round_trip(spark, pages).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got)
    assert kinds == sorted([
        ("1", "revisit", "9", 1000), ("3", "revisit", "9", 1000), ("None", "revisit", "9", 1000), ("9", "response", "None", 1000),
        ("9", "response", "None", 1000), ("4", "response", "None", 999), ("5", "response", "None", 999), ("6", "response", "None", 0),
        ("7", "response", "None", 0), ("None", "response", "None", 2000), ("None", "response", "None", 2000),
    ])
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_long_urls(spark):
    pages = [(i, "data:," + "u" * n, "<p>text</p>" * 200 + str(i)) for i, n in enumerate((16_000, 16_384, 100_000, 1_000_000))]
    pages.append((9, "é" * 100_000, "x" * 200_000))
    got = {r.page_id: r for r in warc.round_trip(spark, spark.createDataFrame(pages, SCHEMA)).collect()}
    assert {k: r.payload_digest for k, r in got.items()} == {i: hashlib.sha1(t.encode()).hexdigest() for i, _, t in pages}


def test_no_file_ends_within_a_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 2, raising=False)
    name = "spark.sql.files.maxRecordsPerFile"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        pages = spark.createDataFrame([(i, "u", str(i) * (3 * warc.CHUNK_BYTES)) for i in range(5)], SCHEMA).coalesce(1)
        got = warc.round_trip(spark, pages).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, 3 * warc.CHUNK_BYTES) for i in range(5)]


ENDINGS = ["", "x", "\n", "\r", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "\r\n\r\nW", "\r\n\r\nWARC/1.1", "WARC/1.1", "WARC/1.1\r", "WARC/1.1\r\n"]


def same_pages(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(spark, pages).collect()}
    want = {i: (len(t.encode()), hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows}
    assert got == want


def test_every_ending_at_every_offset_of_a_read_buffer(spark):
    """Records one byte longer than a buffer, so their ends pass each offset within 60 bytes of one."""
    for ending in ENDINGS:
        size = 64_000 - len(ending)
        size += (64 << 10) + 1 - len("".join(warc.records_of(100, "u", 100, memoryview(b"x" * size), None)) + warc.END)
        same_pages(spark, [(i, "u", f"{i}" + "x" * (size - 3) + ending) for i in range(100, 230)])


def test_many_small_pages_of_each_ending(spark):
    rows = [(i, "http://a/WARC/1.1" if i % 3 else None, f"<p>{i}</p>" + ENDINGS[i % len(ENDINGS)]) for i in range(40_000)]
    same_pages(spark, rows)


def test_decisions_are_sent_only_while_small(spark, monkeypatch):
    rows = [(i, "u", "same " * 300) for i in range(50)] + [(99, "u", "other " * 300)]
    pages = spark.createDataFrame(rows, SCHEMA)

    def exchanges():
        found = warc.decide(spark, pages)
        plan = pages.join(found, ["page_id"], "left")._jdf.queryExecution().executedPlan().toString()
        return "BroadcastHashJoin" in plan

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges()
        monkeypatch.setattr(warc, "SENT_BYTES", 100)
        assert not exchanges()
        assert {r.record_type for r in warc.round_trip(spark, pages).collect()} == {"response", "revisit"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bytes_after_a_block_raise():
    record = "".join(warc.records_of(1, "u", 0, memoryview(b"text"), None))[len(warc.BREAK) :]
    fields, block = warc.parsed(memoryview((record + warc.END).encode()))
    assert bytes(block) == b"text" and fields["Page-Id"] == "1"
    for wrong in (record, record + warc.END + "x", record + "x" + warc.END, record[:-1] + warc.END):
        with pytest.raises(ValueError):
            warc.parsed(memoryview(wrong.encode()))
