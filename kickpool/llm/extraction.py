"""Main text of web pages by gradient-boosted trees over block features.

A page is read into a tree of blocks (``html_tree``). Trees give each block the log odds of being
main text from its subtree density, links, depth, siblings, tags and attribute tokens. Decoding
goes over the whole tree: nothing below a dropped block is kept, and of all choices that obey
this, the one with the largest sum of log odds, weighted by text, is taken.

Training sees a bounded sample: ``SAMPLE_PAGES`` pages, those of at most ``SAMPLE_CHARS``
characters before others, then those of up to twice as many and so on, each class by the hash of
the id; and ``VARIANTS`` layouts composed from each. Extraction reads every whole page, in time
that grows with its length, and needs no shuffle.

Defined results: a null or empty page, or one without text, gives an empty text; if no page tells
where its article is, all blocks count as main text; repeated rows and null ids are read like any
other row; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.llm import boosting
from kickpool.llm.common import map_slices
from kickpool.llm.html_training import Composer, parts_of, teach
from kickpool.llm.html_tree import Block, features, joined, read

SAMPLE_PAGES = 120
SAMPLE_CHARS = 32_000
VARIANTS = 6
SEED = 5


def decode(blocks: list[Block], logits: np.ndarray) -> list[bool]:
    """Kept blocks: the best choice in which nothing below a dropped block is kept."""
    weight = np.array([0.2 + min(b.chars, 2500) ** 0.5 / 10 for b in blocks])
    keep = np.clip(logits, -5, 5) * weight
    keep[0] = 0.01 if len(blocks) > 1 else 1.0
    drop = -keep
    for number in range(len(blocks) - 1, 0, -1):
        up = blocks[number].parent
        keep[up] += max(keep[number], drop[number])
        drop[up] += drop[number]
    kept = [True] * len(blocks)
    for number, block in enumerate(blocks[1:], 1):
        kept[number] = kept[block.parent] and keep[number] > drop[number]
    # Text that stands straight in the body is main text where no block is.
    kept[0] = not any(kept[1:])
    return kept


@dataclass
class Extractor:
    trees: boosting.Trees | None

    def extract(self, pages: list[str | None]) -> list[str]:
        read_pages = [read(page or "") for page in pages]
        rows = [features(blocks) for blocks, _ in read_pages]
        if self.trees is None:
            logits = np.ones(sum(map(len, rows)))
        else:
            logits = self.trees.logit(np.array([row for some in rows for row in some]))
        out, at = [], 0
        for blocks, pieces in read_pages:
            out.append(joined(pieces, decode(blocks, logits[at : at + len(blocks)])))
            at += len(blocks)
        return out


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, answers and weights of the blocks of real and composed pages."""
    told = [p for p in map(parts_of, pages) if p]
    rows, answers, weights = [], [], []

    def add(blocks: list[Block]) -> None:
        for block, row in zip(blocks, features(blocks)):
            if block.truth is not None and block.sum_chars:
                rows.append(row)
                answers.append(block.truth)
                weights.append(1 + min(block.chars, 400) ** 0.5 / 10)

    for page in pages:
        blocks, _ = read(page)
        teach(blocks)
        add(blocks)
    if told:
        composer = Composer(SEED, told)
        for good, _ in told:
            for _ in range(VARIANTS):
                add(read(composer.page(good), truths=True)[0])
    return np.array(rows), np.array(answers, float), np.array(weights)


def train(pages: DataFrame) -> Extractor:
    """Model from a bounded sample of ``page_id, html`` rows."""
    some = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull()).select("page_id", "html")
    longer = F.greatest(F.ceil(F.log2(F.length("html") / SAMPLE_CHARS)), F.lit(0)).alias("longer")
    hashed = F.xxhash64("page_id").alias("hashed")
    # The ids are chosen on narrow rows: every task sends its candidates, so they carry no page.
    chosen = some.select("page_id", longer, hashed).orderBy("longer", "hashed", "page_id").limit(SAMPLE_PAGES)
    chosen = chosen.select("page_id").distinct()
    some = some.join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    return train_on([row.html for row in some.orderBy(F.xxhash64("page_id"), "page_id").collect()])


def train_on(pages: list[str]) -> Extractor:
    rows, answers, weights = training_rows(pages)
    if not len(rows) or answers.min() == answers.max():
        return Extractor(None)
    return Extractor(boosting.fit(rows, answers, weights))


def main_texts(spark: SparkSession, pages: DataFrame, model: Extractor) -> DataFrame:
    """``page_id, url, text`` of each row of ``pages`` (``page_id, url, html``)."""
    shared = spark.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = shared.value.extract(rows.column(2).to_pylist())
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )

    return map_slices(
        pages.select("page_id", "url", "html"),
        work,
        f"page_id {kinds['page_id']}, url {kinds['url']}, text string",
    )
