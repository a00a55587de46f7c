"""Chat formatting: logged snapshots collapse to maximal conversations, which are rendered.

A log may hold a conversation many times, each time a few turns longer. Every row is hashed with
its turn number; the XOR of a conversation's row hashes up to a turn is its rolling prefix hash
(two independent 64-bit hashes and the row count). A conversation whose full hash is a shorter
prefix hash of another is dropped by an anti-join; of equal ones the smallest id stays. Only
then are texts fetched and rendered, with a mark before and after each turn.

DataFrame functions only. Prefixes are computed on narrow rows in blocks of ``BLOCK_TURNS`` turn
numbers, whose totals are carried over, so a conversation of any length is never sorted or
rendered in one task; it is returned in parts of one block each. Both sides of the anti-join are
distinct, so widely shared first turns and conversations are no hot keys.

Defined results
* rows without ``conv_id`` belong to no conversation and are not rendered
* exact repeats of a row count once; rows of one turn number are ordered by hash; a null turn
  comes last
* null role: ``unknown``; null text: empty, in comparing as in rendering; a text cannot contain a mark (``<|`` becomes ``< |``)
* an empty table gives no rows; further columns are not looked at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_TURNS = 1024
LAST_BLOCK = 1 << 40
PARTS_OF_LAST = 58  # shift of the hash that divides rows without a turn number
BEGIN, END = "<|im_start|>", "<|im_end|>"
UNKNOWN_ROLE = "unknown"


def row_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("role", F.lit(UNKNOWN_ROLE)), F.coalesce("text", F.lit("")))


def with_block(rows: DataFrame) -> DataFrame:
    turn = F.col("turn").cast("bigint")
    last = F.lit(LAST_BLOCK) + F.shiftrightunsigned("a", PARTS_OF_LAST)
    return rows.withColumn("block", F.coalesce(F.floor(turn / BLOCK_TURNS), last))


def maximal_blocks(conversations: DataFrame) -> DataFrame:
    """``conv_id, block, part``: the blocks of the conversations that stay."""
    rows = conversations.where("conv_id IS NOT NULL")
    rows = rows.select("conv_id", "turn", row_hash(1).alias("a"), row_hash(2).alias("b"))
    rows = with_block(rows).distinct()
    bound = F.coalesce(F.col("turn").cast("bigint"), F.lit(-1))
    rows = rows.withColumn("x", F.xxhash64(bound, "a")).withColumn("y", F.xxhash64("b", bound))

    blocks = rows.groupBy("conv_id", "block").agg(
        F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.count("*").alias("bn")
    )
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("bx").over(before), F.lit(0)).alias("x0"),
        F.coalesce(F.bit_xor("by").over(before), F.lit(0)).alias("y0"),
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"),
        F.count("*").over(before).alias("part"),
        F.bit_xor("bx").over(whole).alias("full_x"),
        F.bit_xor("by").over(whole).alias("full_y"),
        F.sum("bn").over(whole).alias("full_n"),
    )
    so_far = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "a", "b")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id",
        "block",
        F.bit_xor("x").over(so_far).alias("px"),
        F.bit_xor("y").over(so_far).alias("py"),
        F.count("*").over(so_far).alias("pn"),
    )
    prefixes = rows.join(blocks, ["conv_id", "block"]).select(
        (F.col("n0") + F.col("pn")).alias("n"),
        F.col("x0").bitwiseXOR(F.col("px")).alias("x"),
        F.col("y0").bitwiseXOR(F.col("py")).alias("y"),
        "full_n",
    )
    proper = prefixes.where("n < full_n").select("n", "x", "y").distinct()
    first = blocks.groupBy(F.col("full_n").alias("n"), F.col("full_x").alias("x"), F.col("full_y").alias("y"))
    kept = first.agg(F.min("conv_id").alias("conv_id")).join(proper, ["n", "x", "y"], "left_anti")
    return blocks.select("conv_id", "block", "part").join(kept.select("conv_id"), "conv_id", "left_semi")


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def render(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, text`` of the maximal conversations of ``conv_id, turn, role, text``."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    rows = with_block(rows.withColumn("a", row_hash(1)).withColumn("b", row_hash(2)))
    rows = rows.join(maximal_blocks(conversations), ["conv_id", "block"])
    turn = F.concat(
        F.lit(BEGIN),
        unmarked(F.coalesce("role", F.lit(UNKNOWN_ROLE))),
        F.lit("\n"),
        unmarked(F.coalesce("text", F.lit(""))),
        F.lit(END + "\n"),
    )
    one = F.struct(F.isnull("turn").alias("late"), "turn", "a", "b", turn.alias("shown"))
    parts = rows.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_set(one)).alias("turns"))
    return parts.select(
        "conv_id",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t.shown), "").alias("text"),
    )


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '{UNKNOWN_ROLE}') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, turn,
    string_agg(md5(coalesce(CAST(turn AS VARCHAR), '') || '/' || role || '/' || text), '') OVER (PARTITION BY conv_id ORDER BY turn) AS prefix,
    count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS n,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM t),
kept AS (
  SELECT min(conv_id) AS conv_id FROM p WHERE n = total
    AND prefix NOT IN (SELECT prefix FROM p WHERE n < total)
  GROUP BY prefix)
SELECT conv_id, CAST(floor(turn / {BLOCK_TURNS}) AS BIGINT) AS part, count(*) AS n_turns,
  string_agg('{BEGIN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{END}' || chr(10),
    '' ORDER BY turn) AS text
FROM t JOIN kept USING (conv_id) GROUP BY 1, 2
"""
