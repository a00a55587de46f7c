"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths above ``C/(k+1)`` up to
``C/k``, and a bin of class k is filled with exactly k pieces. As documents may be cut, a length
is cut to its class's largest member, ``floor(C/k)``, and the rest is classed again; the rest
shrinks with the square of the length, so a document gives about three pieces. Rests of at most
``WHOLE`` tokens stay whole.

Each worker fills its bins alone while it reads its share of the table: no shuffle, no shared
state. At its end, the pieces of its unfilled bins are laid end to end and cut at the capacity;
what is left over is cut at powers of two, which need no padding. Memory: one open bin per class.

Defined results: a null or empty text is the end token alone; repeated rows and null ids are
packed like any other row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kickpool.llm.common import claim, slices
from kickpool.llm.tokens import word_ids

CAPACITY = 2048
WHOLE = 64
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
# Sequence numbers of one worker's share; shares are told apart by the bits above.
SHARE_BITS = 33
OUT_BYTES = 4 << 20


def pieces_of(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(class, piece length)`` of a document, in order."""
    cut = [(1, capacity)] * (length // capacity)
    left = length % capacity
    while left:
        kind = capacity // left
        size = left
        if left > WHOLE and kind * left < capacity:
            kind += 1
            size = capacity // kind
        cut.append((kind, size))
        left -= size
    return cut


class Packer:
    """Bins of one worker. A piece is ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, share: int, capacity: int = CAPACITY) -> None:
        self.next, self.capacity = share << SHARE_BITS, capacity
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []
        self.bytes = 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, self.next, offset))
            offset += len(ids) // 4
            self.bytes += len(ids)
        self.next += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for kind, size in pieces_of(total, self.capacity):
            bin_ = self.open.setdefault(kind, [])
            bin_.append((doc_id, start, ids[4 * start : 4 * (start + size)], total))
            start += size
            if len(bin_) == kind:
                self.close(self.open.pop(kind))

    def finish(self) -> None:
        """Unfilled bins end to end, cut at the capacity, the last part at powers of two."""
        left = [piece for kind in sorted(self.open) for piece in self.open[kind]]
        self.open = {}
        remaining = sum(len(p[2]) // 4 for p in left)
        size, room, now = 0, 0, []
        for doc_id, start, ids, total in left:
            while ids:
                if not room:
                    size = self.capacity if remaining >= self.capacity else 1 << (remaining.bit_length() - 1)
                    room = size
                part = ids[: 4 * room]
                now.append((doc_id, start, part, total))
                taken = len(part) // 4
                ids, start, room, remaining = ids[4 * taken :], start + taken, room - taken, remaining - taken
                if not room:
                    self.close(now)
                    now = []

    def take(self) -> list[tuple]:
        rows, self.rows, self.bytes = self.rows, [], 0
        return rows


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        claim(encoder)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        id_type = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take())) or [[] for _ in names]
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names
            )

        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, encoder.encode(text) + end)
                if packer.bytes > OUT_BYTES:
                    yield out()
        if id_type is not None:
            packer.finish()
            yield out()

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )
