"""Dictionaries that are tables: many terms found in one reading of each text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kickpool.functions.text import integers_in

BLOCK_BYTES = 16 << 20  # of terms in one automaton, about 20 times as many in memory
OUT_ROWS = 1 << 14


def term_blocks(terms: DataFrame, term: str, block_bytes: int) -> list[list[str]]:
    """The distinct terms in blocks of about ``block_bytes``, dealt by hash. Empty ones fall out."""
    distinct = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    total = distinct.agg(F.sum(F.octet_length("term"))).first()[0]
    if not total:
        return []
    n = -(-total // block_bytes)
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(n)))
    return [[r.term for r in dealt.where(F.col("block") == i).select("term").toLocalIterator()] for i in range(n)]


def first_hits(
    texts: DataFrame,
    terms: DataFrame,
    *keys: str,
    term: str = "term",
    text: str = "text",
    before: int = 100,
    after: int = 220,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every text × term of the dictionary that it holds: ``term, position`` of the first hit
    (from 0, in code points), and the text ``before`` and ``after`` it.

    The terms are the states of an automaton with links for failed steps, so a text is read once
    for all of a block, however many terms that has, and overlapping hits are all found. A block
    has a bound in bytes and is sent to the executors; a larger dictionary takes one reading of
    the texts a block. Texts stay in their tasks, and per text one hit a term is kept. A NULL
    text holds nothing; repeated terms count once.
    """
    spark = texts.sparkSession
    shape = texts.select(*keys).schema.add("term", T.StringType()).add("position", T.LongType())
    shape = shape.add("before", T.StringType()).add("after", T.StringType())
    found = [_block_hits(texts.select(*keys, text), block, before, after, shape) for block in term_blocks(terms, term, block_bytes)]
    if not found:
        return spark.createDataFrame([], shape)
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits


def _block_hits(texts: DataFrame, block: Sequence[str], before: int, after: int, shape: T.StructType) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, word in enumerate(words):
            automaton.add_word(word, number)
        automaton.make_automaton()
        for batch in batches:
            rows, places, cut = [], [], ([], [], [])

            def made() -> pa.RecordBatch:
                kept = [column.take(pa.array(rows, pa.int64())) for column in batch.columns[:-1]]
                more = [pa.array(cut[0], pa.string()), pa.array(places, pa.int64()), *(pa.array(c, pa.string()) for c in cut[1:])]
                return pa.RecordBatch.from_arrays([*kept, *more], names=shape.fieldNames())

            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                value = value.as_py()
                first: dict[int, int] = {}  # number of a word: where its first hit ends
                for end, number in automaton.iter(value) if value else ():
                    if number not in first:
                        first[number] = end
                for number, end in first.items():
                    word = words[number]
                    at = end - len(word) + 1
                    rows.append(i)
                    places.append(at)
                    for column, part in zip(cut, (word, value[max(at - before, 0) : at], value[at : at + after])):
                        column.append(part)
                if len(rows) >= OUT_ROWS:
                    yield made()
                    rows, places, cut = [], [], ([], [], [])
            if rows:
                yield made()

    return texts.mapInArrow(run, shape)


def table_extract(texts: DataFrame, terms: DataFrame, *keys: str, **options) -> DataFrame:
    """``first_hits`` with the integers in the text from the hit on.

    Hits without a digit near them skip the longer pattern.
    """
    none = F.array().cast("array<bigint>")
    numbers = F.when(F.col("after").rlike("[0-9]"), integers_in("after")).otherwise(none)
    return first_hits(texts, terms, *keys, **options).withColumn("numbers", numbers)
