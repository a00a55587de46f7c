"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of all but letters and digits; in scripts without blanks each
letter is a word. Three fixed masks, each taking
five of nine positions, are hashed at every position of the test items and of the documents; a
position that a mask ignores may differ. Together the masks hit every window of 12 words with two
substitutions and every window of 15 with three. A common hash names a diagonal of a document and
an item; on it the longest window with at least ``SIMILARITY`` equal words is taken exactly, and
it counts if it has ``MIN_WORDS`` words, or the whole item where that is shorter.

Items shorter than ``MIN_WORDS`` have runs of words as seeds. An item shorter than a mask spans
(9) is one run and must occur exactly. One of 9 to 11 words may differ in one or two words, so it
is divided into two or three runs, of which one must be unchanged. Documents are hashed only for
lengths of runs that the test set has.

The distinct texts of the test set are taken in blocks of about ``BLOCK_CHARS`` characters, dealt
by their digests, so what is sent to the workers has a bound however large the test set is and
however many items are alike; each block passes over all documents. Hashes of documents are not
shuffled.

Defined results: null and empty texts, and those without letter or digit, overlap with nothing;
equal items are all reported; repeated rows are reported each; ids may be of any type; an empty table on either side gives no rows (or removes nothing).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.llm.common import claim, map_slices, written

MASKS = ((0, 3, 5, 6, 8), (0, 5, 6, 7, 8), (0, 1, 2, 4, 8))
SPAN = 9
MIN_WORDS = 12
SIMILARITY = 0.8
BLOCK_CHARS = 4 << 20
CACHE_WORDS = 300_000
CHUNK = 1 << 19
NOT_WORD = re.compile(r"[\W_]+")
# Thai, Lao, Myanmar, Khmer, kana, Han.
NO_BLANKS = re.compile(
    "([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])"
)
MIX = np.random.default_rng(7).integers(0, 1 << 63, (len(MASKS), 5), np.uint64) * np.uint64(2) + np.uint64(1)
RUN_MIX = np.random.default_rng(8).integers(0, 1 << 63, SPAN, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Hash of each word as it is compared; 0 for a word without letter or digit."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        core = NOT_WORD.sub("", word.lower())
        made = (xxhash.xxh64_intdigest(core.encode("utf-8", "surrogatepass")) >> 1 or 1) if core else 0
        self[word] = made
        return made


HASHES = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    text = text or ""
    if not text.isascii() and NO_BLANKS.search(text):
        text = NO_BLANKS.sub(r" \1 ", text)
    words = text.split()
    made = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    return made[made != 0]


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the mask's positions at each start."""
    n = max(len(hashes) - SPAN + 1, 0)
    total = np.zeros(n, np.uint64)
    for at, factor in zip(MASKS[mask], MIX[mask]):
        total += hashes[at : at + n] * factor
    return total ^ (total >> np.uint64(29))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words at each start."""
    n = max(len(hashes) - length + 1, 0)
    total = np.full(n, length, np.uint64)
    for at in range(length):
        total += hashes[at : at + n] * RUN_MIX[at]
    return total ^ (total >> np.uint64(29))


def runs(n: int) -> list[tuple[int, int]]:
    """``begin, end`` of the runs of an item of ``n`` words, one of which any overlap holds."""
    if n >= MIN_WORDS:
        return []
    parts = 1 if n < SPAN else 1 + int(n * (1 - SIMILARITY) + 1e-9)
    borders = [n * i // parts for i in range(parts + 1)]
    return list(zip(borders, borders[1:]))


def longest_window(equal: np.ndarray) -> tuple[int, int]:
    """Longest stretch ``[i, j)`` in which at least ``SIMILARITY`` of the places are equal."""
    gain = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - SIMILARITY, -SIMILARITY) + 1e-12)))
    best_after = np.maximum.accumulate(gain[::-1])[::-1]
    ends = len(gain) - np.searchsorted(best_after[::-1], gain, "left") - 1
    i = int(np.argmax(ends - np.arange(len(gain))))
    return i, int(ends[i])


@dataclass
class Items:
    """A block of test items, with the sorted seed hashes of all of them."""

    ids: list
    words: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    shift: np.uint64
    known: np.ndarray
    lengths: list[int]  # of runs
    exact: np.ndarray  # words of each item that must occur exactly, else 0

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        rows = [(i, w) for i, w in ((i, word_hashes(t)) for i, t in rows) if len(w)]
        hashes, item, at = [np.empty(0, np.uint64)], [np.empty(0, int)], [np.empty(0, int)]
        for number, (_, words) in enumerate(rows):
            for mask in range(len(MASKS)) if len(words) >= MIN_WORDS else ():
                made = seeds(words, mask)
                hashes.append(made)
                item.append(np.full(len(made), number))
                at.append(np.arange(len(made)))
            for begin, end in runs(len(words)):
                hashes.append(run_hashes(words[begin:end], end - begin))
                item.append(np.array([number]))
                at.append(np.array([begin]))
        hashes, item, at = np.concatenate(hashes), np.concatenate(item), np.concatenate(at)
        order = np.argsort(hashes, kind="stable")
        bits = min(26, max(16, int(len(hashes) * 64).bit_length()))
        known = np.zeros(1 << bits, bool)
        shift = np.uint64(64 - bits)
        known[hashes >> shift] = True
        lengths = sorted({end - begin for _, w in rows for begin, end in runs(len(w))})
        exact = np.array([len(w) if len(w) < SPAN else 0 for _, w in rows], int)
        ids, words = [i for i, _ in rows], [w for _, w in rows]
        return Items(ids, words, hashes[order], item[order], at[order], shift, known, lengths, exact)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``position, item, position in the item`` of each common seed hash."""
        found = []
        for begin in range(0, len(hashes), CHUNK):
            part = hashes[begin : begin + CHUNK + SPAN - 1]
            kinds = [seeds(part, mask) for mask in range(len(MASKS))]
            for made in kinds + [run_hashes(part, length)[:CHUNK] for length in self.lengths]:
                place = np.flatnonzero(self.known[made >> self.shift])
                low = np.searchsorted(self.hashes, made[place], "left")
                n = np.searchsorted(self.hashes, made[place], "right") - low
                entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                found.append((np.repeat(place + begin, n), self.item[entry], self.at[entry]))
        if not found:
            return (np.empty(0, int),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def overlaps(self, texts: list[str | None]) -> Iterator[tuple]:
        """``row, item id, doc start, item start, words, equal words`` of verified windows.

        Positions count words that have a letter or digit. One window per text and item, the
        longest.
        """
        claim(HASHES)
        docs = [word_hashes(t) for t in texts]
        begins = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(int)
        place, item, at = self.hits(np.concatenate([np.empty(0, np.uint64), *docs]))
        if not len(place):
            return
        row = np.searchsorted(begins, place, "right") - 1
        whole = place + self.exact[item] <= begins[row + 1]
        row, item, place, at = row[whole], item[whole], place[whole], at[whole]
        diagonals = np.unique(np.stack([row, item, place - begins[row] - at], axis=1), axis=0)
        # Of an item that must occur exactly, the last place is enough.
        last = np.ones(len(diagonals), bool)
        last[:-1] = (diagonals[1:, :2] != diagonals[:-1, :2]).any(axis=1)
        diagonals = diagonals[last | (self.exact[diagonals[:, 1]] == 0)]
        best: dict[tuple, tuple] = {}
        for row, item, diagonal in diagonals.tolist():
            doc, words = docs[row], self.words[item]
            first = max(diagonal, 0)
            last = min(diagonal + len(words), len(doc))
            equal = doc[first:last] == words[first - diagonal : last - diagonal]
            i, j = longest_window(equal)
            n = int(equal[i:j].sum())
            if j - i >= min(MIN_WORDS, len(words)) and n >= SIMILARITY * (j - i) - 1e-9:
                made = (j - i, n, first + i, first + i - diagonal)
                best[row, item] = max(best.get((row, item), made), made)
        for (row, item), (size, n, start, item_start) in best.items():
            yield row, self.ids[item], start, item_start, size, n


def distinct_texts(items: DataFrame) -> DataFrame:
    """``item_key, text``: each different text once, under a digest."""
    return items.where("text IS NOT NULL").select(F.sha2("text", 256).alias("item_key"), "text").distinct()


def item_chars(items: DataFrame) -> int:
    return distinct_texts(items).agg(F.sum(F.length("text"))).first()[0] or 0


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Distinct test texts in blocks of about ``BLOCK_CHARS``, dealt by their digests."""
    texts = distinct_texts(items)
    blocks = math.ceil(item_chars(items) / BLOCK_CHARS)
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("item_key"), F.lit(max(blocks, 1))))
    for block in range(blocks):
        yield [tuple(r) for r in dealt.where(F.col("block") == block).select("item_key", "text").collect()]


def overlaps(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified overlaps: ``doc_id, item_id, doc_start, item_start, n_words, n_equal, similarity``.

    Windows are found with distinct test texts, in one reading of the documents a block; the ids
    of the items that have a text are joined to what was found.
    """
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "item_key", "doc_start", "item_start", "n_words", "n_equal", "similarity"]
    schema = (
        f"doc_id {doc_kind}, item_key string, doc_start bigint, item_start bigint, "
        "n_words bigint, n_equal bigint, similarity double"
    )
    texts = docs.select("doc_id", "text")
    made = None
    for rows in item_blocks(items):
        block = spark.sparkContext.broadcast(Items.of(rows))

        def work(batch: pa.RecordBatch, block=block) -> pa.RecordBatch | None:
            found = list(block.value.overlaps(batch.column(1).to_pylist()))
            if not found:
                return None
            row, key, start, item_start, size, n = map(list, zip(*found))
            numbers = (pa.array(x, pa.int64()) for x in (start, item_start, size, n))
            similarity = pa.array([b / a for a, b in zip(size, n)])
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(key, pa.string()), *numbers, similarity], names=names
            )

        part = map_slices(texts, work, schema)
        made = part if made is None else made.union(part)
    ids = items.where("text IS NOT NULL").select(F.sha2("text", 256).alias("item_key"), "item_id")
    if made is None:
        made = spark.createDataFrame([], schema)
    return made.join(ids, "item_key").select("doc_id", "item_id", *names[2:])


def remove_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, without a verified overlap with any test item.

    A test set of one block is a filter in the documents' own tasks. For more, each block gives
    the digests of the texts that overlap with it, and an anti-join drops these texts: tasks stay
    as they are, however large the test set.
    """
    text_at = docs.columns.index("text")
    if item_chars(items) <= BLOCK_CHARS:
        for rows in item_blocks(items):  # one, or none
            block = spark.sparkContext.broadcast(Items.of(rows))

            def work(batch: pa.RecordBatch, block=block) -> pa.RecordBatch:
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in block.value.overlaps(batch.column(text_at).to_pylist())]] = False
                return batch.filter(pa.array(keep))

            docs = map_slices(docs, work, docs.schema)
        return docs
    dirty, digest = None, F.sha2("text", 256)
    texts = docs.select(digest.alias("text_key"), "text").where("text IS NOT NULL")
    for rows in item_blocks(items):
        block = spark.sparkContext.broadcast(Items.of(rows))

        def found(batch: pa.RecordBatch, block=block) -> pa.RecordBatch | None:
            hit = sorted({f[0] for f in block.value.overlaps(batch.column(1).to_pylist())})
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64()))], names=["text_key"])

        part = written(spark, map_slices(texts, found, "text_key string"), "contaminated")
        dirty = part if dirty is None else dirty.union(part)
    return docs.join(dirty.distinct(), digest == F.col("text_key"), "left_anti")

