"""Quality rules: fixed base rules, then robust multivariate outliers.

Per document, words and counts are taken from the whole text. Documents that pass the base rules
give a vector of transformed statistics; per language and source, a minimum-covariance-determinant
estimate of centre and scatter is made, and documents far from the centre by Mahalanobis distance
are rejected: the cut-off is the chi-squared value that ``LEVEL`` of normal rows would exceed, and
the scatter is scaled so that normal rows do.

A statistic that is zero in most sound texts has no scatter, so one duplicate line would be
infinitely far. Counts of one document have a variance of their own: the square root of a share
of n units varies by ``1 / 4n``. In the distance of a document, no variance is taken to be smaller
than that. It shrinks with the text's length; there is no other floor but ``FLOOR``, which only
keeps the scatter invertible.

The estimate covers all rows. It starts from medians and quartiles and takes ``STEPS``
concentration steps; a step sums counts, values and products per group and distance bin (partial
aggregation, so a hot source is summed where it lies) and re-estimates each group from the bins
that hold its nearest ``SUPPORT`` share. A group's bins are the only thing gathered, at most
``2 * BIN_LIMIT + 1`` rows. Groups under ``MIN_GROUP`` rows are pooled by language, and pools
still under it are pooled together; a pool under ``MIN_ROWS`` rows rejects nothing.

Defined results: a null, empty or blank text has no words and fails the base rules; null language
or source is a value of its own; repeated rows and null ids are judged like any other row; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kickpool.llm.common import map_slices, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SUPPORT = 0.75
STEPS = 6
MIN_GROUP = 100
MIN_ROWS = 30
BIN_WIDTH = 0.125  # of the logarithm to base 2 of a squared distance
BIN_LIMIT = 200
STATISTICS = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
FLOOR = (0.001,) * len(STATISTICS)  # keeps a scatter invertible
LEVEL = 1e-6
CUTOFF = 38.258  # chi-squared with six degrees of freedom, exceeded with probability LEVEL
# Variance of normal rows over that of their nearest SUPPORT share: SUPPORT / P(chi2_8 <= 7.841),
# where chi2_6 <= 7.841 with probability SUPPORT.
CONSISTENCY = 1.3616
REPEAT_WORDS = 6  # words of the smallest repeat: two windows of three
D = len(STATISTICS)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, counts = np.unique(
        pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True
    )
    twice = np.zeros(len(words) + 2, bool)
    twice[2:-2] = counts[window] > 1
    return int((twice[:-2] | twice[1:-1] | twice[2:]).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_letters,
    n_marks`` of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    joined = b"".join(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined.decode("utf-8", "surrogatepass")),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(joined) - len(joined.translate(None, bytes(range(65, 91)))),
        len(joined) - len(joined.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)))),
        len(joined) - len(joined.translate(None, b"!?.,;:")),
    )


COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_letters",
    "n_marks",
)


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each row."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([counts(t) for t in rows.column(3).to_pylist()], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays(
            [*rows.columns[:3], *(pa.array(made[:, i].copy()) for i in range(len(COUNTS)))],
            names=["doc_id", "lang", "source", *COUNTS],
        )

    schema = ", ".join(
        [*(f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source")), *(f"{c} bigint" for c in COUNTS)]
    )
    return map_slices(docs.select("doc_id", "lang", "source", "text"), work, schema)


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def transformed() -> list[Column]:
    """Logarithm of a mean, square roots of shares: near symmetric where texts are sound."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    shares = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1))),
        F.sqrt(F.col("n_marks") / words),
    )
    return [share.alias(f"x{i}") for i, share in enumerate(shares)]


def group_keys(rows: DataFrame) -> DataFrame:
    """``lang, source, key``: a group of its own, or the pool that a small group joins."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)
    sizes = sizes.withColumn("pool", F.sum(small).over(Window.partitionBy("lang")))
    name = (
        F.when(F.col("n") >= MIN_GROUP, F.to_json(F.struct("lang", "source")))
        .when(F.col("pool") >= MIN_GROUP, F.to_json(F.struct("lang")))
        .otherwise("{}")
    )
    return sizes.select("lang", "source", name.alias("key"))


def distance() -> Column:
    """Squared Mahalanobis distance of ``x*`` from centre ``m*`` with inverse scatter ``w``."""
    total = F.lit(0.0)
    for at, (i, j) in enumerate(PAIRS):
        part = (F.col(f"x{i}") - F.col("m")[i]) * (F.col(f"x{j}") - F.col("m")[j]) * F.col("w")[at]
        total = total + (part if i == j else 2 * part)
    return F.greatest(total, F.lit(0.0))


def solve(key: str, n: int, mean: np.ndarray, scatter: np.ndarray) -> tuple:
    """A row of estimates."""
    scatter = scatter + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(scatter)
    return key, int(n), mean.tolist(), [float(inverse[i, j]) for i, j in PAIRS]


ESTIMATE = "key string, n bigint, m array<double>, w array<double>"


def first_estimates(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as independent deviations."""
    quartiles = [
        F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}")
        for i in range(D)
    ]
    made = rows.groupBy("key").agg(F.count("*").alias("n"), *quartiles)
    deviation = [(F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in range(D)]
    w = [
        1 / (deviation[i] * deviation[i] + FLOOR[i] ** 2) if i == j else F.lit(0.0) for i, j in PAIRS
    ]
    return made.select(
        "key", "n", F.array(*(F.col(f"q{i}")[1] for i in range(D))).alias("m"), F.array(*w).alias("w"),
    )


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step for every group."""
    near = rows.join(estimates.select("key", "m", "w"), "key")
    step = F.floor(F.log2(distance() + 1e-9) / BIN_WIDTH)
    near = near.withColumn("bin", F.greatest(F.lit(-BIN_LIMIT), F.least(F.lit(BIN_LIMIT), step)))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in PAIRS]
    binned = near.groupBy("key", "bin").agg(F.count("*").alias("n"), *sums, *products)

    def step_of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        seen, total = group.n.cumsum().to_numpy(), int(group.n.sum())
        taken = group.iloc[: int(np.searchsorted(seen, SUPPORT * total)) + 1]
        n = int(taken.n.sum())
        mean = np.array([taken[f"s{i}"].sum() for i in range(D)]) / n
        scatter = np.zeros((D, D))
        for i, j in PAIRS:
            scatter[i, j] = scatter[j, i] = taken[f"p{i}_{j}"].sum() / n - mean[i] * mean[j]
        row = solve(group.key.iloc[0], total, mean, scatter)
        return pd.DataFrame([row], columns=["key", "n", "m", "w"])

    return binned.groupBy("key").applyInPandas(step_of, ESTIMATE)


UNITS = ("n_words", "n_words", "n_lines", "n_words", "n_letters", "n_words")


def final_distances(x: np.ndarray, units: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x``, each with its own estimates ``m`` and ``w``.

    ``units``: what each statistic of the document is a share of.
    """
    inverse = np.empty((len(x), D, D))
    for at, (i, j) in enumerate(PAIRS):
        inverse[:, i, j] = inverse[:, j, i] = w[:, at]
    scatter = CONSISTENCY * np.linalg.inv(inverse)
    counting = 1 / (4 * np.maximum(units, 1.0))
    counting[:, STATISTICS.index("repeats")] *= REPEAT_WORDS
    diagonal = np.arange(D)
    scatter[:, diagonal, diagonal] = np.maximum(scatter[:, diagonal, diagonal], counting)
    apart = x - m
    return np.einsum("ni,ni->n", apart, np.linalg.solve(scatter, apart[:, :, None])[:, :, 0])


def with_distance(rows: DataFrame) -> DataFrame:
    """``rows`` with the last column ``distance``, null where there are no estimates."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {name: batch.column(at) for at, name in enumerate(batch.schema.names)}
        use = np.flatnonzero(column["m"].is_valid().to_numpy(zero_copy_only=False))
        made = np.full(batch.num_rows, np.nan)
        if len(use):
            take = lambda name: column[name].take(pa.array(use))
            x = np.column_stack([take(f"x{i}").to_numpy(zero_copy_only=False) for i in range(D)])
            units = np.column_stack([take(u).to_numpy(zero_copy_only=False) for u in UNITS])
            m, w = (np.array(take(name).to_pylist()) for name in ("m", "w"))
            made[use] = final_distances(x, units, m, w)
        distances = pa.array(made, pa.float64(), mask=np.isnan(made))
        return pa.RecordBatch.from_arrays([*batch.columns, distances], names=[*batch.schema.names, "distance"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_slices(rows, work, f"{kinds}, distance double")


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``, ``distance``, ``kept``."""
    counted = written(spark, base_counts(docs), "quality-counts")
    counted = counted.withColumn("base_failed", base_failed()).select("*", *transformed())
    sound = counted.where("NOT base_failed")
    keys = written(spark, group_keys(sound), "quality-groups")
    same = F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source"))

    def with_key(rows: DataFrame, how: str) -> DataFrame:
        return rows.alias("a").join(keys.alias("b"), same, how).select("a.*", "b.key")

    rows = with_key(sound, "inner").select("key", *(f"x{i}" for i in range(D)))
    rows = written(spark, rows, "quality-vectors")
    estimates = written(spark, first_estimates(rows), "quality-estimates")
    for _ in range(STEPS):
        estimates = written(spark, concentrate(rows, estimates), "quality-estimates")
    judged = with_key(counted, "left").join(estimates.withColumnRenamed("n", "group_rows"), "key", "left")
    needed = ("doc_id", *COUNTS, "base_failed", "group_rows", *(f"x{i}" for i in range(D)), "m", "w")
    judged = with_distance(judged.select(*needed))
    far = (F.col("group_rows") >= MIN_ROWS) & (F.col("distance") > CUTOFF)
    kept = F.when(F.col("base_failed"), False).otherwise(~F.coalesce(far, F.lit(False)))
    return judged.select(
        "doc_id",
        *COUNTS[:5],
        "base_failed",
        kept.alias("kept"),
        F.when(~F.col("base_failed"), F.col("distance")).alias("distance"),
    )
