"""SimHash near duplicates by pigeonhole blocks.

A text is lower-cased (A-Z only) and split at ASCII white space; its shingles of four words,
repeats included, are hashed with XXH64 (seed 42). A fingerprint bit is set if it is set in
more than half of the hashes. Fingerprints link at ``MAX_BITS`` or fewer differing bits;
documents in one connected component are one group.

How it scales
* Equal fingerprints are one node (partial aggregation), so copies cost nothing later on.
* The 64 bits are cut into six blocks. Fingerprints with at most four differing bits agree in
  at least two blocks, so every pair meets in one of the 15 buckets named by two blocks.
* A bucket of more than ``SPLIT_BUCKET`` distinct fingerprints is divided once more: its members
  agree in two blocks, so close ones differ in at most four of the other bits. These are cut into
  six blocks again, of which close pairs share two, and each of the 15 choices is a bucket of its
  own. Far fingerprints part by 14 more bits, and no pair is lost.
* Buckets are streamed in sorted order. Each returns the edges of a spanning forest after
  exact Hamming checks, at most one edge per fingerprint, never all pairs of a bucket.
* Components are found by star contraction, with each round written to the shared folder.

Defined results
* null, empty or blank text: fingerprint zero, linked like any other
* fewer than four words: the whole sequence is one shingle
* repeated rows, equal and null ``doc_id``: one result row per input row; a component whose
  ids are all null has a null id, else nulls are passed over for the smallest id
* empty table: no rows; further columns of the input are not looked at
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kickpool.llm.common import discard, map_slices, written
from kickpool.session import fresh_path

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
SHARED_BLOCKS = len(BLOCK_BITS) - MAX_BITS  # blocks in which any close pair agrees
SMALL_BUCKET = 32
SPLIT_BUCKET = 4096
REST_BITS = (8, 8, 7, 7, 7, 7)  # of what two blocks leave, 44 bits or fewer
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    begins, ends = begins[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(begins), CHUNK):
        hashes = b"".join(
            [digest(joined[i:j], SEED) for i, j in zip(begins[at : at + CHUNK], ends[at : at + CHUNK])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(begins)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_hash: Column | None = None) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row's text as a signed 64-bit number.

    With ``text_hash`` (a 64-bit number), a column of that name follows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [] if text_hash is None else ["text_hash"]
    chosen = docs.select("doc_id", "text", *([] if text_hash is None else [text_hash.alias("text_hash")]))

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t) for t in rows.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(made.view(np.int64)), *rows.columns[2:]], names=["doc_id", "fp", *more]
        )

    schema = ", ".join([f"doc_id {kind}", "fp bigint", *(f"{c} bigint" for c in more)])
    return map_slices(chosen, work, schema)


def bucket_keys(fp: str) -> list:
    """One key per choice of ``SHARED_BLOCKS`` blocks: the choice's number, then the bits."""
    keys = []
    starts = np.cumsum((0, *BLOCK_BITS))
    chosen = list(combinations(range(len(BLOCK_BITS)), SHARED_BLOCKS))
    for number, choice in enumerate(chosen):
        key = F.lit(number).cast("bigint")
        for block in choice:
            width = BLOCK_BITS[block]
            bits = F.shiftrightunsigned(F.col(fp), int(starts[block])).bitwiseAND(
                F.lit((1 << width) - 1).cast("bigint")
            )
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return keys


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the components of one bucket, by breadth-first search."""
    left = fps
    members, roots = [], []
    while len(left) > 1:
        frontier, left, found = left[:1], left[1:], [left[:1]]
        while len(frontier) and len(left):
            near = np.zeros(len(left), bool)
            for one in frontier:
                rest = np.flatnonzero(~near)
                if not len(rest):
                    break
                near[rest] = np.bitwise_count(left[rest] ^ one) <= MAX_BITS
            frontier, left = left[near], left[~near]
            found.append(frontier)
        found = np.concatenate(found)
        if len(found) > 1:
            root = found.min()
            found = found[found != root]
            members.append(found)
            roots.append(np.full(len(found), root, np.uint64))
    if not members:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(members), np.concatenate(roots)


def bucket_edges(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside the buckets of sorted rows. Small buckets are compared lag by lag together."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(first, len(keys)))
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    left, right = [], []
    for lag in range(1, int(min(SMALL_BUCKET, sizes.max(initial=0)))):
        a = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        a = a[np.bitwise_count(fps[a] ^ fps[a + lag]) <= MAX_BITS]
        left.append(fps[a + lag])
        right.append(fps[a])
    for at in np.flatnonzero(sizes > SMALL_BUCKET):
        a, b = forest(fps[first[at] : first[at] + sizes[at]])
        left.append(a)
        right.append(b)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of all buckets of a partition sorted by key; an open bucket waits for its rest."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_edges(k, f)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
        if len(keys) and keys[0] != keys[-1]:
            cut = int(np.searchsorted(keys, keys[-1]))
            yield edges(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield edges(keys, fps)


def rest_of(fp: str, choice: tuple[int, ...]) -> Column:
    """The bits outside the chosen blocks, as one number."""
    starts = np.cumsum((0, *BLOCK_BITS))
    rest = F.lit(0).cast("bigint")
    for block, width in enumerate(BLOCK_BITS):
        if block not in choice:
            bits = F.shiftrightunsigned(F.col(fp), int(starts[block])).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            rest = F.shiftleft(rest, width).bitwiseOR(bits)
    return rest


def divided(rows: DataFrame) -> DataFrame:
    """Rows ``number, key, fp`` of large buckets under the keys of their parts."""
    choices = list(combinations(range(len(BLOCK_BITS)), SHARED_BLOCKS))
    rest = F.lit(None).cast("bigint")
    for number, choice in enumerate(choices):
        rest = F.when(F.col("number") == number, rest_of("fp", choice)).otherwise(rest)
    rows = rows.withColumn("rest", rest)
    starts = np.cumsum((0, *REST_BITS))
    parts = [
        F.shiftrightunsigned("rest", int(at)).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        for at, width in zip(starts, REST_BITS)
    ]
    # A hash of choice, bucket and bits: where two meet, the bucket is only larger.
    keys = [F.xxhash64("number", "key", F.lit(n), *(parts[i] for i in pair)) for n, pair in enumerate(combinations(range(6), 2))]
    return rows.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect distinct fingerprints ``fp`` within ``MAX_BITS`` bits."""
    rows = nodes.select(F.posexplode(F.array(*bucket_keys("fp"))).alias("number", "key"), "fp")
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_BUCKET).select("key")
    large = written(nodes.sparkSession, large, "large-buckets")
    small = rows.join(large, "key", "left_anti").select("key", "fp")
    buckets = small.union(divided(rows.join(large, "key", "left_semi")))
    buckets = buckets.repartition("key").sortWithinPartitions("key", "fp")
    return buckets.mapInArrow(block_links, "a bigint, b bigint")


def star_components(spark: SparkSession, edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` (smallest node) for every node of an edge list.

    Rounds of large-star and small-star steps; a step is an aggregation and a join on the node,
    and neighbours are never gathered. Ends when a round changes nothing.
    """
    schema = edges.schema

    def stage(rows: DataFrame) -> tuple[str, DataFrame]:
        path = fresh_path(spark, label)
        rows.write.parquet(path)
        return path, spark.read.schema(schema).parquet(path)

    path, edges = stage(edges.where("a <> b").distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.where("a <> b").union(lowest.select("a", F.col("low").alias("b")))
        last, (path, edges) = path, stage(small.distinct())
        discard(spark, last)  # a round is read from its own files alone
        state = edges.agg(
            F.count("*"),
            F.expr("bit_xor(xxhash64(a, b))"),
            F.expr("sum(cast(shiftrightunsigned(xxhash64(b, a), 32) AS decimal(38,0)))"),
        ).first()
        if state == before:
            break
        before = state
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select("component", "component").distinct())


def fingerprint_components(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``fp, component``: each distinct fingerprint and the smallest one in its component."""
    nodes = written(spark, rows.select("fp").distinct(), "simhash-nodes")
    joined = star_components(spark, links(nodes), "simhash-components")
    labelled = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    return labelled.select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs`` (``doc_id, text``)."""
    rows = written(spark, fingerprints(docs), "simhash-fingerprints")
    labelled = fingerprint_components(spark, rows)
    lowest = rows.groupBy("fp").agg(F.min("doc_id").alias("low_id")).join(labelled, "fp")
    smallest = lowest.groupBy("component").agg(F.min("low_id").alias("component_id"))
    by_fp = lowest.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns: of each component one row.

    It is the one with the smallest ``doc_id`` (nulls last), of equal ids the one with the
    smallest hash of its text, of rows equal in both any one.
    """
    rows = written(spark, fingerprints(docs, F.xxhash64("text")), "simhash-fingerprints")
    identity = ("doc_id", "text_hash")
    # The first of each fingerprint, combined before the shuffle, then the first of each component.
    first = F.min(F.struct(F.isnull("doc_id").alias("late"), *identity)).alias("first")
    by_fp = rows.groupBy("fp").agg(first).join(fingerprint_components(spark, rows), "fp")
    kept = by_fp.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    counted = rows.groupBy(*identity).agg(F.count("*").alias("rows")).where("rows > 1")
    counted = counted.select(*(F.col(c).alias(f"_{c}") for c in identity), "rows")
    equal = kept["doc_id"].eqNullSafe(counted["_doc_id"]) & (kept["text_hash"] == counted["_text_hash"])
    kept = kept.join(counted, equal, "left").select(
        F.col("doc_id").alias("__id"),
        F.col("text_hash").alias("__hash"),
        F.coalesce("rows", F.lit(1)).alias("__rows"),
    )
    kept = kept.hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"]) == kept["__hash"])
    found = docs.join(kept, same)
    single = found.where("__rows = 1").select(*(docs[c] for c in docs.columns))
    several = found.where("__rows > 1").dropDuplicates(["__id", "__hash"])
    return single.union(several.select(*(docs[c] for c in docs.columns)))
