"""Quality scores from a factorisation machine.

Features of a whole text are its distinct words, hashed into ``WORD_SLOTS`` slots and scaled by
the root of their number, and structure statistics (length, case, symbols, repeats, lines), each
in ``BINS`` steps with a slot per step. Named metadata columns can join as hashed values. The
machine adds to a linear model every pairwise interaction of features through ``RANK`` factors,
scored in linear time: half of (sum of factors)^2 - sum of squared factors.

Training sees a bounded sample, ``PER_CLASS`` labelled rows of each class with the smallest hash
of their id, weighted back to the true class sizes. A sampled row reaches the driver as a bit per
slot. Scoring reads every whole text and needs no shuffle.

Defined results: null and empty texts are scored by their structure slots; without training rows
every score is 0.5; a document labelled twice counts once, with its lowest label; repeated rows
and null ids are scored like any other row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.llm.common import claim, lowest_hashes, map_slices

PER_CLASS = 2000
WORD_SLOTS = 1 << 15
BINS = 16
RANK = 8
EPOCHS = 12
BATCH = 64
RATE = 0.02
DECAY = 1e-4
SEED = 11
THRESHOLD = 0.3
CACHE_WORDS = 300_000
STATISTICS = 12
METADATA_SLOTS = 1 << 10
SLOTS = WORD_SLOTS + STATISTICS * BINS + METADATA_SLOTS
CHUNK = 1 << 20


class Slots(dict):
    """Slot of each word, forgotten when too many are known."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS
        return slot


WORDS = Slots()


def byte_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    for at in range(0, len(data), CHUNK):
        counts += np.bincount(np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at), minlength=256)
    return counts


def statistics(text: str, words: list[str], distinct: int) -> np.ndarray:
    """Structure statistics of a text, each scaled to 0..1."""
    data = text.encode("utf-8", "surrogatepass")
    of = byte_counts(data)
    total, n = max(len(data), 1), max(len(words), 1)
    upper, lower = of[65:91].sum(), of[97:123].sum()
    digits = of[48:58].sum()
    ends = of[[33, 44, 46, 58, 59, 63]].sum()  # ! , . : ; ?
    symbols = of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum() - ends
    lines = [line for line in text.split("\n") if line.strip()]
    repeats = sum(map(str.__eq__, words[1:], words[:-1]))
    return np.array(
        [
            np.log2(1 + len(words)) / 16,
            len(text) / n / 24,
            upper / max(upper + lower, 1),
            digits / total * 4,
            ends / n,
            of[33] / n,
            symbols / total * 4,
            of[124] / n,
            of[128:].sum() / total * 2,
            distinct / n,
            repeats / n,
            1 - len(set(lines)) / max(len(lines), 1),
        ]
    )


def slots_of(text: str | None, metadata: list[str] = ()) -> tuple[np.ndarray, int]:
    """Distinct slots of a text, words first, and how many are words."""
    text = text or ""
    words = text.split()
    kinds = set(words)
    hashed = np.unique(np.fromiter(map(WORDS.__getitem__, kinds), np.int64, len(kinds)))
    steps = np.clip(np.ceil(statistics(text, words, len(kinds)) * (BINS - 1)), 0, BINS - 1).astype(np.int64)
    told = [
        zlib.crc32(value.encode("utf-8", "surrogatepass")) % METADATA_SLOTS for value in metadata
    ]
    slots = np.concatenate(
        (
            hashed,
            WORD_SLOTS + np.arange(STATISTICS) * BINS + steps,
            WORD_SLOTS + STATISTICS * BINS + np.unique(np.array(told, np.int64)),
        )
    )
    return slots, len(hashed)


def values_of(slots: np.ndarray) -> np.ndarray:
    """Words weigh one over the root of their number, all else one."""
    word = slots < WORD_SLOTS
    return np.where(word, 1 / np.sqrt(max(int(word.sum()), 1)), 1.0)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        """Value of each row before the logistic function, and what its gradient needs."""
        slots = np.concatenate(rows)
        x = np.concatenate([values_of(r) for r in rows])
        begins = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        weighted = self.factors[slots] * x[:, None]
        sums = np.add.reduceat(weighted, begins)
        squares = np.add.reduceat(weighted**2, begins)
        value = self.bias + np.add.reduceat(self.linear[slots] * x, begins)
        return value + 0.5 * (sums**2 - squares).sum(axis=1), (slots, x, begins, weighted, sums)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Machine:
    """Logistic loss, Adam steps over small batches; the same sample gives the same machine."""
    chance = np.random.default_rng(SEED)
    machine = Machine(0.0, np.zeros(SLOTS), chance.normal(0, 0.02, (SLOTS, RANK)))
    if not len(rows):
        return machine
    mean = np.clip(np.average(labels, weights=weights), 0.01, 0.99)
    machine.bias = float(np.log(mean / (1 - mean)))
    table = np.hstack([machine.linear[:, None], machine.factors])
    first, second = np.zeros_like(table), np.zeros_like(table)
    for epoch in range(EPOCHS):
        order = chance.permutation(len(rows))
        for step in range(0, len(rows), BATCH):
            at = order[step : step + BATCH]
            machine.linear, machine.factors = table[:, 0], table[:, 1:]
            value, (slots, x, begins, weighted, sums) = machine.raw([rows[i] for i in at])
            error = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - labels[at]) * weights[at] / len(at)
            sizes = np.diff(np.append(begins, len(slots)))
            each = np.repeat(error, sizes)
            slope = np.empty((len(slots), 1 + RANK))
            slope[:, 0] = each * x
            slope[:, 1:] = (each * x)[:, None] * (np.repeat(sums, sizes, axis=0) - weighted)
            used, place = np.unique(slots, return_inverse=True)
            total = np.zeros((len(used), 1 + RANK))
            np.add.at(total, place, slope)
            total += DECAY * table[used]
            first[used] = 0.9 * first[used] + 0.1 * total
            second[used] = 0.99 * second[used] + 0.01 * total**2
            table[used] -= RATE * first[used] / (np.sqrt(second[used]) + 1e-6)
            machine.bias -= RATE * float(error.sum())
    machine.linear, machine.factors = table[:, 0].copy(), table[:, 1:].copy()
    return machine


def featured(rows: pa.RecordBatch, text_at: int, metadata_at: list[int]) -> list[np.ndarray]:
    claim(WORDS)
    told = [[(rows.schema.names[i], v) for v in rows.column(i).to_pylist()] for i in metadata_at]
    return [
        slots_of(text, [f"{name}={value}" for name, value in (column[i] for column in told)])[0]
        for i, text in enumerate(rows.column(text_at).to_pylist())
    ]


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ()
) -> Machine:
    """Machine from ``doc_id, text`` rows and their ``doc_id, quality`` labels (0 or 1)."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.withColumn("quality", (F.col("quality") > 0).cast("int"))
    counted = marked.groupBy("quality").agg(F.count("*").alias("n"))  # two classes
    sizes = {row.quality: row.n for row in counted.collect()}
    sample = lowest_hashes(marked, "quality", "doc_id", PER_CLASS, counted)
    sample = docs.select("doc_id", "text", *metadata).join(
        F.broadcast(sample.select("doc_id", "quality")), "doc_id"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text", "quality", *metadata]

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        bits = []
        for slots in featured(rows, 1, list(range(3, len(columns)))):
            present = np.zeros(SLOTS, bool)
            present[slots] = True
            bits.append(np.packbits(present).tobytes())
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(2).cast(pa.int64()), pa.array(bits, pa.binary())],
            names=["doc_id", "quality", "bits"],
        )

    made = map_slices(sample.select(columns), work, f"doc_id {kind}, quality bigint, bits binary")
    made = made.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("bits").alias("bits"))
    found = made.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8))[:SLOTS]) for r in found]
    answers = np.array([float(r.quality > 0) for r in found])
    sampled = {q: sum(r.quality == q for r in found) for q in sizes}
    weights = np.array([sizes[r.quality] / max(sampled[r.quality], 1) for r in found])
    return fit(rows, answers, weights / weights.mean() if len(weights) else weights)


def score(
    spark: SparkSession, docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, score, predicted`` of each row of ``docs`` (``doc_id, text``)."""
    shared = spark.sparkContext.broadcast(machine)
    kind = docs.schema["doc_id"].dataType.simpleString()
    metadata_at = list(range(2, 2 + len(metadata)))

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = shared.value.score(featured(rows, 1, metadata_at))
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(made), pa.array((made >= THRESHOLD).astype(np.int32))],
            names=["doc_id", "score", "predicted"],
        )

    return map_slices(
        docs.select("doc_id", "text", *metadata),
        work,
        f"doc_id {kind}, score double, predicted int",
    )


def keep_good(spark: SparkSession, docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows of ``docs``, all columns, that score ``THRESHOLD`` or more."""
    shared = spark.sparkContext.broadcast(machine)
    text_at = docs.columns.index("text")

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pa.array(shared.value.score(featured(rows, text_at, [])) >= THRESHOLD))

    return map_slices(docs, work, docs.schema)
