"""Token ids of whole texts by a public word BPE, with a bounded cache of words per worker.

The vocabulary divides texts at white space, and between letters, digits and marks, before
anything else, so a text's ids are its pieces' ids in a row. Pieces repeat, so each Python worker
keeps their ids. New pieces of a Latin text are encoded together in one call and cut at the tokens
that end a piece; other texts are divided at white space only, new words encoded alone.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

# Two generations of at most so many words each: memory stays bounded, frequent words stay.
CACHE_WORDS = 400_000
# The code points that the vocabulary's pattern language takes as white space.
BLANK_POINTS = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029)
BLANK_POINTS = (*BLANK_POINTS, 0x202F, 0x205F, 0x3000)
BLANKS = re.compile("[^" + "".join(map(chr, BLANK_POINTS)) + "]+")
# str.split() also splits at these four, which the pattern does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
# The vocabulary's own division of a text (a fixed value), for lower-case Latin text.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
WORD_END = "</w>"


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array(
            [(self.tokenizer.id_to_token(i) or "").endswith(WORD_END) for i in range(size)]
        )
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def clear(self) -> None:
        """Forget all words."""
        self.young, self.old = {}, {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[str], joint: bool) -> None:
        """Ids of words that are not among the young ones; ``joint``: blanks can part them."""
        new = []
        for word in words:
            known = self.old.get(word)
            if known is None:
                new.append(word)
            else:
                self.young[word] = known
        if joint and new:
            ids = self.ids(" ".join(new))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(new):
                flat, begins = ids.tobytes(), (4 * np.concatenate(([0], cuts))).tolist()
                self.young.update(zip(new, [flat[i:j] for i, j in zip(begins[:-1], begins[1:])]))
                return
        self.young.update((word, self.ids(word).tobytes()) for word in new)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text; null is empty."""
        text = text or ""
        odd = SEPARATORS.search(text)
        # One case mapping and no composition below this code point, so lower case can come first.
        joint = not odd and "<|" not in text and latin(text)
        if joint:
            words = PIECES.findall(text.lower())
        else:
            words = BLANKS.findall(text) if odd else text.split()
        kinds = set(words)
        missing = kinds.difference(self.young)
        if missing:
            if len(self.young) > CACHE_WORDS:
                self.old, self.young, missing = self.young, {}, kinds
            self.learn(missing, joint)
        return b"".join(map(self.young.__getitem__, words))


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
