"""Merkle manifest of a table: leaf and node digests, roots per source, proofs, checks.

A leaf is the SHA-256 of a row's fields. Per source the leaves stand in the order of their ids,
and every ``FANOUT`` consecutive nodes make a parent until one is left, the subroot; the subroots,
in the order of their sources, make the root the same way.

Slot pivot: conditional aggregates over a parent's group spread its children into ``FANOUT``
columns. The columns in a row, hashed, are the parent; those left and right of the own slot are
the siblings. The aggregates are taken over windows, so each child has them beside it and no join
is needed. ``LEVELS`` levels are climbed after one shuffle by (source, block of consecutive
leaves): the windows of a block share their partitioning, and one sort serves all of them. A
block holds at most ``FANOUT ** LEVELS`` rows, so a hot source is many tasks. A block's first row
then stands for it in the next climb. On the way down each block's steps are joined to its rows;
steps are pairs of left and right siblings, so a changed leaf can be folded up through them.

Positions come from ranges of (source, id) and prefix counts; no task orders a whole source.

Defined results: rows without id come first in their source, and none of them is tampered with;
rows of one id stand in the order of their leaves; repeated rows are leaves of their own; a source
of one row is its own subroot, and a single subroot is the root; an empty table gives no rows;
columns but the five fields are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kickpool.llm.common import crc_of, written
from kickpool.operators.positions import with_positions

FANOUT = 3
LEVELS = 6
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def leaf_of(fields: dict[str, Column]) -> Column:
    shown = []
    for value in fields.values():
        value = value.cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*shown), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """``doc_id, key, digest, tampered``; the key orders sources, the missing one first."""
    fields = {name: F.col(name) for name in FIELDS}
    changed = F.coalesce(crc_of("doc_id") % 2 == 0, F.lit(False))
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"),
        leaf_of(fields).alias("digest"),
        leaf_of(fields | {"text": text}).alias("tampered"),
    )


def climbed(nodes: DataFrame) -> DataFrame:
    """Nodes with the ``top`` of their block and the ``steps`` up to it."""
    rows = nodes.withColumn("top", F.col("digest")).withColumn("steps", F.array().cast(STEPS))
    for level in range(1, LEVELS + 1):
        rows = rows.withColumn(f"p{level}", F.expr(f"position div {FANOUT**level}"))
    rows = rows.repartition("key", f"p{LEVELS}")
    for level in range(1, LEVELS + 1):
        parent = Window.partitionBy("key", *[f"p{i}" for i in range(LEVELS, level - 1, -1)])
        slot = F.expr(f"position div {FANOUT ** (level - 1)} % {FANOUT}")
        children = [
            F.coalesce(F.max(F.when(slot == s, F.col("top"))).over(parent), F.lit("")) for s in range(FANOUT)
        ]
        rows = rows.select("*", slot.alias("slot"), *[c.alias(f"c{s}") for s, c in enumerate(children)])
        left = F.concat(*[F.when(F.lit(s) < F.col("slot"), F.col(f"c{s}")).otherwise("") for s in range(FANOUT)])
        right = F.concat(*[F.when(F.lit(s) > F.col("slot"), F.col(f"c{s}")).otherwise("") for s in range(FANOUT)])
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        several = F.col("size") > FANOUT ** (level - 1)  # nodes of this level: more than one
        joined = F.sha2(F.concat(*[f"c{s}" for s in range(FANOUT)]), 256)
        rows = rows.withColumns(
            {
                "top": F.when(several, joined).otherwise(F.col("top")),
                "steps": F.when(several, F.concat("steps", step)).otherwise(F.col("steps")),
            }
        ).drop("slot", *[f"c{s}" for s in range(FANOUT)])
    return rows


def levels_of(spark: SparkSession, nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their blocks, the blocks of these, and so on to one node for each key.

    The loop runs once for ``LEVELS`` levels, so its length is the logarithm of the largest group.
    """
    levels = [nodes]
    size = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        block = climbed(levels[-1]).where(F.col("position") % BLOCK == 0)
        block = block.select(
            "key",
            F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"),
            F.expr(f"position div {BLOCK}").alias("position"),
            F.col("top").alias("digest"),
        )
        levels.append(written(spark, block, "merkle-level"))
        size = -(-size // BLOCK)
        if size <= 1:
            return levels


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first level's nodes with all steps: ``above`` (``key, position, more``, and columns to
    hand down) belongs to the last level."""
    handed = [name for name in above.columns if name not in ("key", "position", "more")]
    for depth, nodes in enumerate(reversed(levels[:-1])):
        upper = above.select(F.col("key").alias("_key"), F.col("position").alias("_at"), "more", *handed)
        met = (F.col("key") == F.col("_key")) & (F.col(f"p{LEVELS}") == F.col("_at"))
        below = climbed(nodes).join(upper, met).withColumn("steps", F.concat("steps", "more"))
        last = depth == len(levels) - 2
        own = nodes.columns if last else ["key", "position"]
        above = below.select(*own, F.col("steps").alias("more"), *handed)
    return above


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``proof`` (the siblings' digests in a row) is what ``proof_sha256`` hashes.
    """
    leaves = written(spark, leaves_of(docs), "merkle-leaves")
    placed = with_positions(leaves, ["key"], [F.col(c).asc_nulls_first() for c in ("doc_id", "digest", "tampered")])
    placed = written(spark, placed, "merkle-placed")
    per_source = levels_of(spark, placed)
    subroots = with_positions(per_source[-1].select(F.col("key").alias("name"), "digest"), [], [F.col("name").asc()])
    subroots = written(spark, subroots.withColumn("key", F.lit("")), "merkle-subroots")
    over_sources = levels_of(spark, subroots)
    top = over_sources[-1].select("key", "position", F.array().cast(STEPS).alias("more"), F.col("digest").alias("root"))
    above = descended(over_sources, top).select(
        F.col("name").alias("key"), F.lit(0).cast("bigint").alias("position"), "more", F.col("digest").alias("subroot"), "root"
    )
    rows = descended(per_source, above)
    proof = F.array_join(F.transform("more", lambda s: F.concat(s.left, s.right)), "")
    folded = F.aggregate("more", F.col("tampered"), lambda a, s: F.sha2(F.concat(s.left, a, s.right), 256))
    rows = rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof"), folded.alias("folded_root")
    )
    return rows.withColumn("proof_sha256", F.sha2("proof", 256)).withColumn("verified", F.col("folded_root") == F.col("root"))


# CRC-32 of a decimal number as text, for DuckDB: a table by bits, then one step a digit.
CRC_TABLE = (
    "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]), "
    "lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crcs"
)


def crc_sql(value: str) -> str:
    """SQL of the CRC-32 of an integer's decimal text; ``crcs`` must be in scope."""
    codes = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    reduced = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))"
    return f"xor({reduced}, CAST(4294967295 AS BIGINT))"


def field_sql(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def climb_sql(name: str, start: str) -> str:
    """Recursive nodes ``src, lvl, pos, h, n`` from ``start``, and their siblings."""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT src, lvl + 1, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + {FANOUT - 1}) // {FANOUT}
  FROM {name} WHERE n > 1 GROUP BY src, lvl, pos // {FANOUT}),
{name}_steps AS (
  SELECT src, lvl, pos,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY src, lvl, pos // {FANOUT} ORDER BY pos))"""


SQL = f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE}),
leaves AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS src, {leaf_sql("text")} AS leaf,
    CASE WHEN {crc_sql("doc_id")} % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS pos,
    count(*) OVER (PARTITION BY src) AS n FROM leaves),
{climb_sql("nodes", "SELECT src, 0 AS lvl, pos, leaf AS h, n FROM placed")},
subroots AS (
  SELECT src AS name, h, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
{climb_sql("tops", "SELECT '' AS src, 0 AS lvl, pos, h, n FROM subroots")},
top AS (SELECT h AS root FROM tops WHERE n = 1),
steps AS (
  SELECT p.src, p.pos, 0 AS tree, s.lvl, s.l, s.r FROM placed p JOIN nodes_steps s
    ON s.src = p.src AND s.pos = p.pos // CAST(pow({FANOUT}, s.lvl) AS BIGINT)
  UNION ALL
  SELECT p.src, p.pos, 1, s.lvl, s.l, s.r FROM placed p JOIN subroots b ON b.name = p.src JOIN tops_steps s
    ON s.pos = b.pos // CAST(pow({FANOUT}, s.lvl) AS BIGINT)),
proofs AS (
  SELECT src, pos, string_agg(l || r, '' ORDER BY tree, lvl) AS proof,
    list(l || '|' || r ORDER BY tree, lvl) AS pairs FROM steps GROUP BY src, pos),
folded AS (
  SELECT p.doc_id, p.leaf, b.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(p.tampered, coalesce(pairs, [])),
      lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM placed p JOIN subroots b ON b.name = p.src CROSS JOIN top LEFT JOIN proofs q ON q.src = p.src AND q.pos = p.pos)
SELECT *, folded_root = root AS verified FROM folded
"""
