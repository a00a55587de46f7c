"""WARC archives through a chunked record table.

Writing: a payload becomes rows of record and chunk number with at most ``CHUNK_BYTES`` bytes,
cut from the column's buffer, each carrying the SHA-1 of all bytes up to its end; no payload is
copied whole. A chunk is one WARC record: the first a ``response``, the others ``continuation``
segments. Spark's text writer puts the records into gzip files in the cluster's shared folder.
Reading: such a file is never split, so a record's segments come in order, and one pass joins
their digests and lengths without a shuffle. ``stream_chunks`` gives the chunk rows again.

The reader parts records at the line that begins one. No part of that line but its whole can be
its beginning, so a read buffer may end anywhere within it; and it occurs nowhere else: chunks are
also cut inside such a line, and where the record's end would complete one. Whatever follows a
block but its record's end raises. Of equal payloads of ``REVISIT_BYTES`` or more, the row with
the largest id is written, the others are ``revisit`` records that refer to it. They are found on
narrow rows (id, length, digest), aggregated before the shuffle. These decisions are sent to the
payloads while they take up to ``SENT_BYTES``; beyond it payloads move once, to meet them.

Defined results: a null payload is empty; a null id takes part, but is referred to by no row and
refers to the largest id; if all ids of a group are null, or the largest occurs twice, each of
those rows is a response; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.llm.common import written
from kickpool.session import fresh_path

EOL = "\r\n"
VERSION = "WARC/1.1"
END = EOL + EOL
BREAK = (VERSION + EOL).encode()
CHUNK_BYTES = 64 << 10
REVISIT_BYTES = 1000
HEAD_BYTES = 16 << 10
SENT_BYTES = 8 << 20
OUT_BYTES = 4 << 20


def cuts(payload: memoryview) -> Iterator[int]:
    """Ends of the chunks of a payload: on character borders, and inside any record-begin line."""
    begin, n = 0, len(payload)
    while begin < n:
        end = min(begin + CHUNK_BYTES, n)
        while end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        line = bytes(payload[begin : end + len(BREAK) - 1]).find(BREAK)
        if 0 <= line and begin + line < end:
            end = begin + line + 1
        elif bytes(payload[max(end - len(VERSION), begin) : end]) == VERSION.encode():
            end -= len(VERSION) - 1  # the record's end would make it such a line
        yield end
        begin = end
    if not n:
        yield 0


def digest_chunks(payload: memoryview) -> Iterator[tuple[int, memoryview, str, bool]]:
    """``chunk number, bytes, digest so far, whether it is the last``."""
    sha, begin = hashlib.sha1(), 0
    for number, end in enumerate(cuts(payload), 1):
        sha.update(payload[begin:end])
        yield number, payload[begin:end], sha.hexdigest(), end == len(payload)
        begin = end


def buffers(column: pa.Array) -> Iterator[memoryview]:
    """UTF-8 bytes of each text of an Arrow column, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    data = memoryview(data) if data is not None else memoryview(b"")
    at = memoryview(offsets).cast("q")[column.offset : column.offset + len(column) + 1]
    for i in range(len(column)):
        yield data[at[i] : at[i + 1]] if column[i].is_valid else memoryview(b"")


def header(fields: list[tuple[str, object]]) -> str:
    lines = [f"{name}: {value}" for name, value in fields if value is not None]
    lines = [line + " " if line.endswith(VERSION) else line for line in lines]
    return EOL.join([VERSION, *lines]) + END


def one_line(text: str | None) -> str | None:
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def records_of(page_id, url, number: int, payload: memoryview, refers_to) -> Iterator[str]:
    """WARC records of a page, in order. ``number`` tells rows with equal ids apart."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{number}>"
    common = [("Page-Id", page_id), ("WARC-Target-URI", one_line(url)), ("Content-Type", "text/html; charset=utf-8")]
    if refers_to is not None:
        *_, (_, _, digest, _) = digest_chunks(payload)
        yield header(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common,
             ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
             ("WARC-Payload-Digest", f"sha1:{digest}"), ("Refers-To-Page", refers_to), ("Content-Length", 0)]
        )
        return
    for segment, chunk, digest, last in digest_chunks(payload):
        kind = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
        if segment > 1:
            kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{segment}>"), ("WARC-Segment-Origin-ID", name)]
        if segment > 1 or not last:
            kind.append(("WARC-Segment-Number", segment))
        if last:
            kind += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Segment-Total-Length", len(payload))]
        yield header([*kind, ("Digest-So-Far", f"sha1:{digest}"), ("Content-Length", len(chunk))]) + str(chunk, "utf-8")


def decide(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the rows that revisit another."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select("page_id", F.octet_length(payload).alias("bytes"), F.sha1(payload).alias("digest"))
    narrow = written(spark, narrow.where(F.col("bytes") >= REVISIT_BYTES), "warc-payloads")
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    found = narrow.join(largest.where("n > 1 AND refers_to IS NOT NULL"), "digest")
    found = found.where("NOT page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct()
    found = written(spark, found, "warc-revisits")
    ids = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("page_id", "refers_to")]
    size = found.agg(F.sum(ids[0] + ids[1] + 64)).first()[0] or 0
    return F.broadcast(found) if size <= SENT_BYTES else found.hint("shuffle_hash")


def write_archives(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """One WARC record, or row of segments, for each row of ``pages`` (``page_id, url, html``)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    revisits = decide(spark, pages).alias("r")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest")).alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    rows = rows.join(revisits, same, "left").select("p.page_id", "p.url", "p.html", "r.refers_to")
    rows = rows.withColumn("number", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            ids, urls, _, refers, numbers = (c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns))
            for i, data in enumerate(buffers(batch.column(2))):
                for record in records_of(ids[i], urls[i], numbers[i], data, refers[i]):
                    made.append(record)
                    size += len(record)
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])

    lines = rows.mapInArrow(run, "value string")
    writer = lines.write.option("lineSep", END).option("compression", "gzip")
    # One file a task, whatever the session says: a file never ends between the segments of a record.
    writer.option("maxRecordsPerFile", 0).text(path)


def parsed(value: memoryview) -> tuple[dict[str, str], memoryview]:
    """Header fields and block of a record as it is read."""
    size = HEAD_BYTES
    while (end := (head := bytes(value[:size])).find(END.encode())) < 0:
        if size >= len(value):
            raise ValueError("record without the end of its header")
        size *= 4
    fields = dict(line.split(": ", 1) for line in head[:end].decode("utf-8").split(EOL))
    begin, length = end + len(END), int(fields["Content-Length"])
    if bytes(value[begin + length :]) != END.encode():
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut short or followed by other bytes")
    return fields, value[begin : begin + length]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records without their first line; what stands before a file's first record is empty."""
    return spark.read.option("lineSep", BREAK.decode()).text(path).where("value <> ''")


def stream_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of the archives: ``record_id, chunk_no, record_type, chunk, digest_so_far``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in buffers(batch.column(0)):
                fields, block = parsed(value)
                name = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                number = int(fields.get("WARC-Segment-Number", 1))
                digest = fields.get("Digest-So-Far", fields.get("WARC-Payload-Digest"))
                out.append((name, number, fields["WARC-Type"], str(block, "utf-8"), digest))
            columns = [pa.array(list(c)) for c in zip(*out)]
            columns[1] = columns[1].cast(pa.int64())
            names = ["record_id", "chunk_no", "record_type", "chunk", "digest_so_far"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return read_lines(spark, path).mapInArrow(
        run, "record_id string, chunk_no bigint, record_type string, chunk string, digest_so_far string"
    )


def read_archives(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Lengths and digests are taken from the bytes read; a difference to a header raises. Those of
    a revisit are the ones read for the record it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sha, size = None, None, 0
        for batch in batches:
            out = []
            for value in buffers(batch.column(0)):
                fields, block = parsed(value)
                if fields["WARC-Type"] != "continuation":
                    if first is not None:
                        raise ValueError(f"record {first['WARC-Record-ID']} lacks its end")
                    first, sha, size = fields, hashlib.sha1(), 0
                elif first is None or fields["WARC-Segment-Origin-ID"] != first["WARC-Record-ID"]:
                    raise ValueError(f"segment {fields['WARC-Record-ID']} without its record")
                sha.update(block)
                size += len(block)
                told = fields.get("WARC-Payload-Digest")
                if told is None:
                    continue
                revisit, digest = first["WARC-Type"] == "revisit", told.removeprefix("sha1:")
                if not revisit and sha.hexdigest() != digest:
                    raise ValueError(f"digest of {first['WARC-Record-ID']} differs")
                out.append((first.get("Page-Id"), None if revisit else size, digest, first["WARC-Type"], first.get("Refers-To-Page")))
                first = None
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
        if first is not None:
            raise ValueError(f"record {first['WARC-Record-ID']} lacks its end")

    read = read_lines(spark, path).mapInArrow(
        run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    )
    read = read.withColumn("page_id", F.col("page_id").cast(id_kind))
    read = written(spark, read.withColumn("refers_to", F.col("refers_to").cast(id_kind)), "warc-read")
    lengths = read.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")
    )
    revisits = read.where("record_type = 'revisit'").join(
        lengths.distinct(), ["refers_to", "payload_digest"], "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        read.where("record_type <> 'revisit'")
        .select(columns)
        .unionByName(revisits.withColumn("payload_bytes", F.col("full")).select(columns))
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives of ``pages`` in the shared folder, and what reading them back gives."""
    path = fresh_path(spark, "warc")
    write_archives(spark, pages, path)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())
