"""Prefix trie of conversations: one row per distinct sequence of first turns.

Conversations are rebuilt on narrow rows (digest of role and text, length of the text), divided
into strata of ``BLOCK_TURNS`` turns keyed by a hash of all turns before, so no conversation is
ever one array. Equal sequences of a stratum become one row with its count and smallest id, before
the shuffle as far as possible. These rows are divided into ranges of (stratum, sequence); each
range builds ternary search trees over a dictionary of its own (``ternary``), at most
``RUN_TURNS`` turns at a time, and gives its nodes with members, leaves and savings.

Boundary-node merging: nodes on the border of a range come as paths with what hangs on them in
this range. Parts of one node are added up; a merged node's figures are its own plus those of the
merged nodes below it. Each merged node counts for the first path it lies on, so its figures reach
the nodes above as sums from a path's end, over all paths through them: two joins and a window
over a path, no loop over levels. Strata below a sequence's end are added the same way, through
the conversations that have them.

``ends_sha256`` is streamed: ids in ranges of (end, id); groups inside a range are hashed there,
those on its border come as pieces of text, which one pass per end reads in order.

Defined results: rows without ``conv_id`` belong to no conversation; turns of one number stand in
the order of their digests; repeated rows are turns of their own; a conversation whose rebuilt
turns are none belongs to the root alone; an empty table gives no rows, so no root; columns but the
four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kickpool.llm import merkle
from kickpool.llm.common import crc_of, written
from kickpool.llm.ternary import DIGEST, Tree
from kickpool.operators.positions import with_positions

BLOCK_TURNS = 256
RUN_TURNS = 1 << 19
SHARED = 100  # conversations that may take their first turns from the first of them
HEADS = 6  # how many first turns at most, plus one
PIECE_IDS = 10_000
NODE = (
    "run bigint, border boolean, side int, k bigint, px bigint, py bigint, depth bigint, conv_id bigint, n bigint, "
    "children bigint, leaves bigint, saved bigint, more boolean, chars bigint, ekey string, parent bigint, key string, above string"
)
OUTPUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conv_id, length, k, seq, chars``: the blocks of all rebuilt conversations, the last of which
    may be empty. ``seq`` holds the turns' digests in a row."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", F.unhex(said).alias("m"), F.char_length(text).cast("bigint").alias("chars")
    )
    turns = with_positions(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("m").asc()])
    turns = written(spark, turns.drop("turn"), "trie-turns")
    h = crc_of("conv_id") % HEADS
    first = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("position") < HEADS - 1))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("position", "m", "chars"))).alias("heads")
    )
    convs = turns.where("position = 0").select("conv_id", F.col("size").alias("own"), h.cast("int").alias("h"))
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    convs = convs.withColumn("base", base).join(heads, "base", "left")
    convs = convs.withColumn("heads", F.when(F.col("heads").isNotNull(), F.slice("heads", 1, F.col("h"))))
    filled = F.greatest(F.size("heads"), F.lit(0)).cast("bigint")
    length = (F.col("filled") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")
    convs = convs.withColumn("filled", filled).select("conv_id", "h", "heads", "filled", length)
    convs = written(spark, convs, "trie-convs")

    own = turns.where(F.col("position") >= h).join(convs.drop("heads"), "conv_id")
    own = own.select("conv_id", "length", (F.col("filled") + F.col("position") - F.col("h")).alias("j"), "m", "chars")
    given = convs.select("conv_id", "length", F.inline("heads")).withColumnRenamed("position", "j")
    blocks = own.unionByName(given).groupBy("conv_id", "length", F.expr(f"j div {BLOCK_TURNS}").alias("k"))
    blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("j", "m", "chars"))).alias("turns"))
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.m)), ""))
    blocks = blocks.select("conv_id", "length", "k", seq.alias("seq"), F.transform("turns", lambda t: t.chars).alias("chars"))
    # A conversation that fills its blocks ends at the root of the next stratum.
    empty = convs.where(f"length % {BLOCK_TURNS} = 0").select(
        "conv_id", "length", F.expr(f"length div {BLOCK_TURNS}").alias("k"), F.lit(b"").alias("seq"),
        F.array().cast("array<bigint>").alias("chars"),
    )
    return blocks.unionByName(empty)


def with_strata(blocks: DataFrame) -> DataFrame:
    """Blocks with the key ``px, py`` of their stratum and that of the next, ``nx, ny``."""
    x, y = F.xxhash64(F.lit(1), "k", "seq"), F.xxhash64("seq", "k", F.lit(2))
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    long = F.col("length") >= BLOCK_TURNS
    none = F.lit(0).cast("bigint")
    rows = blocks.withColumn("x", x).withColumn("y", y)
    deep = rows.where(long).withColumn("px", F.coalesce(F.bit_xor("x").over(before), none))
    deep = deep.withColumn("py", F.coalesce(F.bit_xor("y").over(before), none))
    rows = rows.where(~long).withColumn("px", none).withColumn("py", none).unionByName(deep)
    nx, ny = F.col("px").bitwiseXOR(F.col("x")), F.col("py").bitwiseXOR(F.col("y"))
    ends = F.col("length") < (F.col("k") + 1) * BLOCK_TURNS
    return rows.select("conv_id", "k", "px", "py", "seq", "chars", nx.alias("nx"), ny.alias("ny"), ends.alias("ends"))


def end_key() -> Column:
    return F.md5(F.concat(F.encode(F.concat_ws(":", "k", "px", "py", F.lit("")), "utf-8"), F.col("seq")))


def sequences_of(blocks: DataFrame) -> DataFrame:
    """Distinct sequences of each stratum with count, smallest id, and whether some end or go on."""
    found = blocks.groupBy("k", "px", "py", "seq", "chars", "nx", "ny").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.count_if("ends").alias("ended")
    )
    return found.select(
        "k", "px", "py", "seq", "chars", "n", "conv_id", F.when(F.col("ended") > 0, end_key()).alias("ekey"),
        (F.col("n") > F.col("ended")).alias("more"), "nx", "ny",
    )


def shard_nodes(spark: SparkSession, sequences: DataFrame) -> DataFrame:
    """Rows of ``NODE`` from the trees of all ranges, written."""
    order = ["k", "px", "py", "seq"]
    rows = sequences.select(*order, "chars", "n", "conv_id", "ekey", "more", "children", "leaves", "saved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in NODE.split(", ")]
        made, held, turns = TaskContext.get().partitionId() << 33, [], 0
        kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
        types = [kinds[field.split()[1]] for field in NODE.split(", ")]

        def tables() -> Iterator[pa.RecordBatch]:
            out = []
            for node in Tree(held).figures(made):
                out.append(node)
                if len(out) == 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(row)
                turns += 1 + len(row[3]) // DIGEST
                if turns >= RUN_TURNS:
                    yield from tables()
                    made, held, turns = made + 1, [], 0
        if held:
            yield from tables()

    ranged = written(spark, rows, "trie-sequences").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(spark, ranged.mapInArrow(run, NODE), "trie-nodes")


def merged(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Whole nodes ``k, px, py, depth, conv_id, n, children, leaves, saved, parent, ekey``."""
    paths = nodes.where("border")
    sums = paths.groupBy("key").agg(
        *[F.min(c).alias(c) for c in ("k", "px", "py", "depth", "conv_id", "chars", "above", "ekey")],
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.max("more").alias("more"),
        F.min(F.struct("run", "side")).alias("first"),
    )
    below = sums.groupBy(F.col("above").alias("key")).agg(F.count("*").alias("joined"))
    sums = sums.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("joined", F.lit(0)))
    childless = (F.col("children") == 0) & ~F.col("more")
    sums = sums.withColumns(
        {
            "leaves": F.col("leaves") + F.when(childless, 1).otherwise(0),
            "saved": F.col("saved") + (F.col("n") - 1) * F.col("chars"),
        }
    ).drop("joined", "above", "more", "chars")
    sums = written(spark, sums, "trie-sums")

    on_paths = paths.select("key", "run", "side").join(
        sums.select("key", "depth", "conv_id", "leaves", "saved", "first"), "key"
    )
    own = F.col("first") == F.struct("run", "side")
    path = Window.partitionBy("run", "side").orderBy("depth")
    to_end = path.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    on_paths = on_paths.select(
        "key", "run", "side", "depth", "conv_id",
        F.lag("conv_id").over(path).alias("parent"),
        F.sum(F.when(own, F.col("leaves")).otherwise(0)).over(to_end).alias("leaves"),
        F.sum(F.when(own, F.col("saved")).otherwise(0)).over(to_end).alias("saved"),
    )
    on_paths = written(spark, on_paths, "trie-paths")
    totals = on_paths.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("parent").alias("parent"))
    columns = ["k", "px", "py", "depth", "conv_id", "n", "children", "leaves", "saved", "parent", "ekey"]
    border = sums.drop("leaves", "saved").join(totals, "key").select(columns)

    inner = nodes.where("NOT border")
    upper = on_paths.select("run", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("found"))
    hanging = inner.where("side IS NOT NULL").join(upper, ["run", "side", "depth"])
    hanging = hanging.withColumn("parent", F.col("found")).select(columns)
    return inner.where("side IS NULL").select(columns).unionByName(hanging).unionByName(border)


def with_lower_strata(spark: SparkSession, blocks: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequences with what the strata below their ends hold: ``children, leaves, saved``, and the
    ``ekey`` of conversations that end there without a further turn."""
    none = {name: F.lit(0).cast("bigint") for name in ("children", "leaves", "saved")}
    if not blocks.agg(F.max("k")).first()[0]:
        return sequences.withColumns(none)
    keys = ["k", "px", "py"]
    nodes = merged(spark, shard_nodes(spark, sequences.where("k > 0").withColumns(none)))
    roots = nodes.where("depth = 0").select(*keys, F.col("conv_id").alias("first"), "children", "leaves", "saved", "ekey")
    roots = written(spark, roots, "trie-roots")
    down = Window.partitionBy("conv_id").orderBy(F.desc("k"))
    own = F.col("conv_id") == F.col("first")
    held = blocks.where("k > 0").select("conv_id", *keys).join(roots, keys)
    held = held.select(*keys, *[F.sum(F.when(own, F.col(c)).otherwise(0)).over(down).alias(c) for c in ("leaves", "saved")])
    totals = held.groupBy(keys).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = totals.join(roots.select(*keys, "children", "ekey"), keys)
    lower = totals.select((F.col("k") - 1).alias("k"), F.col("px").alias("nx"), F.col("py").alias("ny"), "ekey", *none)
    going = sequences.where("more").drop("ekey").join(lower, ["k", "nx", "ny"])
    return going.unionByName(sequences.where("NOT more").withColumns(none))


def end_digests(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """``ekey, ends_sha256``: digest of the ids that end at a node, in order."""
    ids = blocks.where("ends").select(end_key().alias("ekey"), "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now, held, number = TaskContext.get().partitionId(), None, None, [], 0
        out = []

        def close(border: bool) -> None:
            nonlocal number
            text = ",".join(held)
            if border or number:  # pieces of one group follow each other
                out.append((now, None, part, number, text))
                number += 1
            else:
                out.append((now, hashlib.sha256(text.encode()).hexdigest(), None, None, None))
            held.clear()

        def taken() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            batch = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(batch, names=["ekey", "digest", "part", "number", "text"])

        for batch in batches:
            for ekey, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if ekey != now:
                    if held:
                        close(now == first)
                    first, now, number = first or ekey, ekey, 0
                elif len(held) == PIECE_IDS:
                    close(True)
                held.append(str(conv_id))
            if out:
                yield taken()
        if held:
            close(True)
            yield taken()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for ekey, text in zip(*(c.to_pylist() for c in batch.columns)):
                if ekey != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = ekey, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["ekey", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["ekey", "ends_sha256"])

    ranged = ids.repartitionByRange("ekey", "conv_id").sortWithinPartitions("ekey", "conv_id")
    made = ranged.mapInArrow(pieces, "ekey string, digest string, part bigint, number bigint, text string")
    made = written(spark, made, "trie-ends")
    borders = made.where("digest IS NULL").repartition("ekey").sortWithinPartitions("ekey", "part", "number")
    borders = borders.select("ekey", "text").mapInArrow(streamed, "ekey string, ends_sha256 string")
    return made.where("digest IS NOT NULL").select("ekey", F.col("digest").alias("ends_sha256")).unionByName(borders)


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per node, with the columns of ``OUTPUT``."""
    blocks = written(spark, with_strata(rebuilt(spark, conversations)), "trie-blocks")
    sequences = written(spark, sequences_of(blocks), "trie-distinct")
    nodes = merged(spark, shard_nodes(spark, with_lower_strata(spark, blocks, sequences)))
    nodes = nodes.where("depth > 0 OR k = 0").select(
        "conv_id",
        (F.col("k") * BLOCK_TURNS + F.col("depth")).alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ekey",
    )
    ended = nodes.where("ekey IS NOT NULL").join(end_digests(spark, blocks), "ekey").select(OUTPUT)
    empty = F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256")
    return ended.unionByName(nodes.where("ekey IS NULL").select(*OUTPUT[:-1], empty))


SQL = f"""
WITH crc_table AS ({merkle.CRC_TABLE}),
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id, m, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS r FROM said),
convs AS (
  SELECT conv_id, conv_id - conv_id % {SHARED} AS base, {merkle.crc_sql("conv_id")} % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_table),
given AS (SELECT c.conv_id, r AS depth, m, chars FROM convs c JOIN t ON t.conv_id = c.base AND r <= h),
filled AS (SELECT conv_id, count(*) AS n FROM given GROUP BY 1),
turns AS (
  SELECT * FROM given UNION ALL
  SELECT conv_id, coalesce(n, 0) + r - h, m, chars FROM t JOIN convs USING (conv_id) LEFT JOIN filled USING (conv_id) WHERE r > h
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
prefixes AS (
  SELECT conv_id, depth, chars, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS p,
    max(depth) OVER (PARTITION BY conv_id) AS total FROM turns),
steps AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM prefixes),
nodes AS (
  SELECT depth, p, min(above) AS above, count(*) AS n, min(conv_id) AS c, max(total) = depth AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends
  FROM steps GROUP BY depth, p),
shares AS (
  SELECT depth, p,
    sum(CASE WHEN conv_id = c THEN (n - 1) * chars ELSE 0 END) OVER w AS saved,
    sum(CASE WHEN conv_id = c AND leaf THEN 1 ELSE 0 END) OVER w AS leaves
  FROM steps JOIN nodes USING (depth, p) WINDOW w AS (PARTITION BY conv_id ORDER BY depth DESC)),
totals AS (SELECT depth, p, sum(saved) AS saved, sum(leaves) AS leaves FROM shares GROUP BY 1, 2),
children AS (SELECT depth - 1 AS depth, above AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2)
SELECT v.c AS conv_id, CAST(depth AS BIGINT) AS depth, u.c AS parent_conv_id, v.n AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM nodes v JOIN totals USING (depth, p) LEFT JOIN children k USING (depth, p)
LEFT JOIN (SELECT depth + 1 AS depth, p AS above, c FROM nodes) u USING (depth, above)
"""

