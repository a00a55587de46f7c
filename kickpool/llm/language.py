"""Language identification with string kernels.

A text is lower-cased; runs of non-letters become one blank. It is read in segments of about
``SEGMENT`` signs. The blended spectrum of a segment is the set of its character n-grams of one to
three signs. Those of blanks and the ``SIGNS - 2`` most frequent letters of the sample have a number
each; those with any other letter are hashed by code points into ``WIDE`` numbers, so no letter
counts as another, of whatever script. The kernel of two segments is the number of shared n-grams over the root of the
product of the set sizes. Presence in segments, not in the text as a whole, lets the language of
most of a text decide where a passage of another one stands in it.

``LANDMARKS`` segments of training texts give the Nystroem map. A text is the mean of its mapped
segments, weighted by length; one-versus-rest kernel ridge regression gives a value per language.
Texts are scored in batches of segments: presence rows times landmark columns, times coefficients
(the last two are multiplied once).

Training sees a bounded sample of every language: ``PER_LANGUAGE`` labelled rows each, those with the
smallest hash of their id; ``SAMPLE_ROWS`` over the languages, but ``LEAST_ROWS`` each at least, if
there are many. Only landmark segments and kernel
rows (a number per landmark) reach the driver, never texts. Scoring reads every whole text and
needs no shuffle.

Defined results: null text or text without a letter gives ``und`` with score 0; without training
rows every text is ``und``; repeated rows and null ids are scored like any other row; an empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.llm.common import lowest_hashes, map_slices, written

PER_LANGUAGE = 300
SAMPLE_ROWS = 128 * PER_LANGUAGE
LEAST_ROWS = 20
LANDMARKS = 128
RIDGE = 1e-3
SHARPNESS = 8.0
MIN_SCORE = 0.3
UNKNOWN = "und"
SEGMENT = 1000
# Signs: 0 blank, 1 any other letter (told apart by code point), then the most frequent letters of the sample.
SIGNS = 64
EXACT = SIGNS + SIGNS**2 + SIGNS**3
WIDE = 1 << 22
GRAMS = EXACT + WIDE
POINT_MIX = np.random.default_rng(9).integers(0, 1 << 63, 6, np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 20
BATCH = 64


@dataclass
class Alphabet:
    """Sign of each code point of the basic plane; letters above it have the sign of other letters."""

    signs: np.ndarray

    @staticmethod
    def of(letters: list[int]) -> Alphabet:
        signs = np.array([chr(c).isalpha() for c in range(1 << 16)], np.uint8)
        for sign, letter in enumerate(letters, 2):
            if letter < len(signs):
                signs[letter] = sign
        return Alphabet(signs)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Signs of a text between two blanks, blanks never in a row, and code points (0 for blanks)."""
        points = code_points(text)
        signs = np.zeros(len(points) + 2, np.intp)
        if len(points) and points.max() > 0xFFFF:
            signs[1:-1] = self.signs[np.minimum(points, 0xFFFF)]
            for at in np.flatnonzero(points > 0xFFFF):
                signs[at + 1] = chr(points[at]).isalpha()
        else:
            signs[1:-1] = self.signs[points]
        filled = signs != 0
        keep = np.ones(len(signs), bool)
        np.logical_or(filled[1:], filled[:-1], out=keep[1:])
        letters = np.zeros(len(signs), np.uint64)
        letters[1:-1] = points
        letters[~filled] = 0
        return signs[keep], letters[keep]

    def segments(self, text: str | None) -> Iterator[tuple[np.ndarray, int]]:
        """Distinct n-grams, sorted, and length of each segment of a whole text that has a letter."""
        text = text or ""
        found = np.zeros(EXACT, bool)
        eights = found.view(np.uint64)
        for at in range(0, len(text), CHUNK):
            signs, letters = self.read(text[at : at + CHUNK])
            others = bool((signs == 1).any())
            count = max(1, round(len(signs) / SEGMENT))
            borders = np.linspace(0, len(signs), count + 1).astype(int).tolist()
            for begin, end in zip(borders, borders[1:]):
                part = signs[begin : end + 2]
                if others and (part == 1).any():
                    yield mixed_grams(part, letters[begin : end + 2]), end - begin
                elif part.any():
                    pairs = part[:-1] * SIGNS + part[1:]
                    found[part] = True
                    found[SIGNS + pairs] = True
                    found[SIGNS + SIGNS**2 + pairs[:-1] * SIGNS + part[2:]] = True
                    used = np.flatnonzero(eights != 0)  # few of the groups of eight n-grams
                    group, place = np.nonzero(found.reshape(-1, 8)[used])
                    eights[used] = 0
                    yield 8 * used[group] + place, end - begin


def mixed_grams(signs: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Distinct n-grams of a segment; those with another letter are hashed."""
    pairs = signs[:-1] * SIGNS + signs[1:]
    exact = (signs, SIGNS + pairs, SIGNS + SIGNS**2 + pairs[:-1] * SIGNS + signs[2:])
    made = []
    for n, grams in enumerate(exact, 1):
        size = len(signs) - n + 1
        other, total = np.zeros(size, bool), np.full(size, n, np.uint64)
        for i in range(n):
            other |= signs[i : i + size] == 1
            total += (letters[i : i + size] + np.uint64(1)) * POINT_MIX[n * (n - 1) // 2 + i]
        total ^= total >> np.uint64(31)
        total *= POINT_MIX[0]
        made.append(np.where(other, EXACT + (total >> np.uint64(42)).astype(np.intp), grams))
    return np.unique(np.concatenate(made))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Landmarks:
    """Segments that all others are compared with."""

    columns: np.ndarray  # column of each n-gram, one past the last if no landmark has it
    table: np.ndarray  # columns x landmarks, scaled by the landmarks' sizes

    @staticmethod
    def of(grams: list[np.ndarray]) -> Landmarks:
        vocabulary = np.unique(np.concatenate([np.empty(0, np.int64), *grams]))
        columns = np.full(GRAMS, len(vocabulary), np.int32)
        columns[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
        table = np.zeros((len(vocabulary), len(grams)), np.float32)
        for place, found in enumerate(grams):
            table[columns[found], place] = 1 / np.sqrt(len(found))
        return Landmarks(columns, table)

    def times(self, texts: list[list[tuple[np.ndarray, int]]], right: np.ndarray) -> np.ndarray:
        """Mean over each text's segments of presence rows times ``right`` (columns x any).

        A batch of presence rows is kept as its non-zero columns, so the product adds rows of
        ``right``.
        """
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = [segment for text in texts for segment in text]
        size = np.array([n for _, n in flat], np.float64)
        total, weight = np.zeros((len(texts), right.shape[1])), np.bincount(owner, size, len(texts))
        right = np.vstack([right, np.zeros((1, right.shape[1]), right.dtype)])
        for at in range(0, len(flat), BATCH):
            grams = [g for g, _ in flat[at : at + BATCH]]
            counts = np.array([len(g) for g in grams])
            begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
            made = np.add.reduceat(right[self.columns[np.concatenate(grams)]], begins)
            made *= (size[at : at + BATCH] / np.sqrt(counts))[:, None]
            np.add.at(total, owner[at : at + BATCH], made)
        return total / np.maximum(weight, 1)[:, None]


@dataclass
class Model:
    alphabet: Alphabet
    languages: list[str]
    landmarks: Landmarks
    scores: np.ndarray  # landmark table times coefficients
    constant: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        read = [list(self.alphabet.segments(t)) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        values = SHARPNESS * (self.landmarks.times(read, self.scores) + self.constant)
        values = np.exp(values - values.max(axis=1, keepdims=True))
        best, score = values.argmax(axis=1), values.max(axis=1) / values.sum(axis=1)
        known = np.array([len(r) > 0 for r in read], bool)
        named = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return named, np.where(known, score, 0.0)


def letter_counts(sample: DataFrame) -> DataFrame:
    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        points = np.concatenate([code_points(t or "") for t in rows.column(0).to_pylist()])
        values, counts = np.unique(points, return_counts=True)
        keep = np.array([chr(v).isalpha() for v in values], bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(values[keep].astype(np.int64)), pa.array(counts[keep].astype(np.int64))],
            names=["point", "n"],
        )

    made = map_slices(sample.select("text"), work, "point bigint, n bigint")
    return made.groupBy("point").agg(F.sum("n").alias("n"))


def sample_rows(labelled: DataFrame) -> DataFrame:
    """``doc_id, lang, text, place`` of the bounded training sample, places within a language."""
    ids = labelled.select("doc_id", "lang")
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    languages = max(sizes.count(), 1)
    each = min(PER_LANGUAGE, max(LEAST_ROWS, SAMPLE_ROWS // languages))
    chosen = lowest_hashes(ids, "lang", "doc_id", each, sizes)
    chosen = chosen.groupBy("doc_id").agg(F.min("place").alias("place"))
    return labelled.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text", "place")


def train(spark: SparkSession, labelled: DataFrame) -> Model:
    """Model from ``doc_id, lang, text`` rows with a language."""
    labelled = labelled.select("doc_id", "lang", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    sample = written(spark, sample_rows(labelled), "language-sample")
    letters = letter_counts(sample).orderBy(F.col("n").desc(), "point").limit(SIGNS - 2).collect()
    alphabet = Alphabet.of([row.point for row in letters])
    kind = sample.schema["doc_id"].dataType.simpleString()

    def middle(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for text in rows.column(2).to_pylist():
            segments = list(alphabet.segments(text))
            made.append(segments[len(segments) // 2][0] if segments else [])
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "lang", "grams"]
        )

    languages = sample.select("lang").distinct().count()
    first = sample.where(F.col("place") <= max(1, LANDMARKS // max(languages, 1)))
    found = map_slices(first, middle, f"doc_id {kind}, lang string, grams array<bigint>")
    found = found.where(F.size("grams") > 0).groupBy("doc_id").agg(F.min("grams").alias("grams"))
    chosen = found.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    grams = [np.array(row.grams) for row in chosen]
    landmarks = Landmarks.of(grams)

    def kernels(rows: pa.RecordBatch) -> pa.RecordBatch:
        read = [list(alphabet.segments(t)) for t in rows.column(2).to_pylist()]
        made = landmarks.times(read, landmarks.table)
        return pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                rows.column(1),
                pa.array([k.tolist() if r else None for k, r in zip(made, read)], pa.list_(pa.float64())),
            ],
            names=["doc_id", "lang", "kernel"],
        )

    made = map_slices(sample, kernels, f"doc_id {kind}, lang string, kernel array<double>")
    made = made.where("kernel IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("lang", "kernel")).alias("row")
    )
    rows = made.select("doc_id", "row.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit(alphabet, grams, np.array([r.kernel for r in rows]), [r.lang for r in rows])


def fit(
    alphabet: Alphabet, grams: list[np.ndarray], kernel: np.ndarray, labels: list[str]
) -> Model:
    """Nystroem features of the sample's kernel rows, then one ridge regression per language."""
    languages = sorted(set(labels))
    landmarks = Landmarks.of(grams)
    if not languages:
        return Model(alphabet, [], landmarks, np.empty((0, 0)), np.empty(0))
    among = landmarks.times([[(g, 1)] for g in grams], landmarks.table)
    size, axes = np.linalg.eigh(among)
    use = size > 1e-6 * size[-1]
    nystroem = axes[:, use] / np.sqrt(size[use])
    features = np.hstack([kernel @ nystroem, np.ones((len(kernel), 1))])
    target = np.array([[1.0 if label == one else -1.0 for one in languages] for label in labels])
    share = 1 / np.array([labels.count(label) for label in labels])
    share *= len(labels) / share.sum()
    left = features.T @ (features * share[:, None]) + RIDGE * len(labels) * np.eye(features.shape[1])
    solved = np.linalg.solve(left, features.T @ (target * share[:, None]))
    scores = landmarks.table @ (nystroem @ solved[:-1])
    return Model(alphabet, languages, landmarks, scores.astype(np.float32), solved[-1])


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs`` (``doc_id, text``)."""
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        named, score = shared.value.predict(rows.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(named, pa.string()), pa.array(score)],
            names=["doc_id", "lang_pred", "score"],
        )

    return map_slices(
        docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double"
    )


def keep_identified(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is known with ``MIN_SCORE`` or more."""
    shared = spark.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        named, score = shared.value.predict(rows.column(text_at).to_pylist())
        keep = (np.array(named, object) != UNKNOWN) & (score >= MIN_SCORE)
        return rows.filter(pa.array(keep.astype(bool)))

    return map_slices(docs, work, docs.schema)

