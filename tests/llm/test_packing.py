import random

import numpy as np
import public_tokenizers
from conftest_data import SMALL
from kickpool.llm import packing
from kickpool.llm.common import table
from kickpool.llm.tokens import WordIds
from tokenizers import Tokenizer

PATH = public_tokenizers.path(packing.VOCABULARY)


def check(rows, texts):
    """Every id in one piece, sequences gapless and within bounds; returns the share of padding."""
    tokenizer = Tokenizer.from_file(PATH)
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(docs.pop(doc_id), key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == ids.tobytes()
        at = 0
        for p in pieces:
            assert (p.start, p.doc_tokens, 4 * p.length) == (at, len(ids), len(p.ids))
            at += p.length
    assert not docs
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
        total += at
    return padding / max(total, 1)


def test_whole_table(spark):
    docs = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.pack(docs).collect(), texts) < 0.01


def test_random_texts_have_the_tokenizer_ids():
    tokenizer, words = Tokenizer.from_file(PATH), WordIds(PATH)
    chance = random.Random(1)
    signs = [*"abcXYZ'stmdrevl_,.!#0123 \n\t²½ªºµßÑé<|>^`´", "\x1c", "́", "Σ", "İ", "漢", " ", "'s", "<|endoftext|>", " "]
    for _ in range(3000):
        text = "".join(chance.choices(signs, k=chance.randint(0, 30)))
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.encode(text) == want, text


def test_classes():
    for length in range(1, 5000):
        cut = packing.pieces_of(length)
        assert sum(size for _, size in cut) == length
        assert all(kind == packing.CAPACITY // size for kind, size in cut)
        assert all(kind * size <= packing.CAPACITY for kind, size in cut)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    empty = [r for r in rows if r.doc_tokens == 1]
    assert sorted(str(r.doc_id) for r in empty) == ["0", "1", "2", "None"]
    assert sum(r.length for r in rows if r.doc_id == 5) == 3 * next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(no_docs).count() == 0
