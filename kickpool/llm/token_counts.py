"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

A byte-fallback BPE model of sentencepiece gives the pieces and their scores; the merging is done
here. The distinct pre-tokens of a slice lie end to end in one numpy array. Each round finds every
sequence's lowest-rank pair by a segmented minimum, joins it in all sequences at once, drops the
sequences without any pair left, and counts their symbols: a piece is one token, a sign that the
model lacks as many as it has bytes.

A pre-token ends where no piece of the model goes on: before a blank after another sign, and
between two neighbours that no piece holds side by side. This loses no merge. Within a sequence the
leftmost pair of the lowest rank goes first. Others of that rank join in the same round where the
order cannot matter: non-overlapping ones if no piece that holds the joined one has a lower rank,
else those so far from the one before that no piece of a lower rank which holds one of them comes
near one that holds the other (a joined piece grows by its neighbours only). What is left of a
sequence after ``ROUNDS`` rounds, as of a long text without blanks whose pieces depend on each
other, is joined pair by pair from a heap in the same order. Very long runs of blanks are shortened by whole pieces of
blanks, where the model joins blanks last and up to one length.

Rows stay in their tasks. Counts of short pre-tokens are kept in a cache of two generations. A
long text is handled in runs of ``RUN_SIGNS`` signs that end between pre-tokens, so memory grows
with the text itself only.

Defined results: a null text has 0 bytes and 0 tokens, as an empty one; special strings and
control signs within texts are ordinary text; repeated rows, null ids and an empty table give
their rows as they come; columns but ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kickpool.llm.common import map_slices

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_WORDS = 400_000
CACHED_SIGNS = 48  # longer pre-tokens are counted anew
RUN_SIGNS = 1 << 20
BLANK = "▁"
LETTERS = "A-Za-z"
NONE = np.iinfo(np.int64).max
ROUNDS = 256  # every sequence of up to so many signs ends within them


class PieceModel:
    """Pieces, ranks and pairs of a model; symbols are numbered, single signs by code point."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: dict[int, tuple[int, int]] | None = None
        size = self.library.vocab_size()
        special = (self.library.is_byte, self.library.is_control, self.library.is_unknown, self.library.is_unused)
        plain = [i for i in range(size) if not any(test(i) for test in special)]
        pieces = [self.library.id_to_piece(i) for i in plain]
        scores = np.array([self.library.get_score(i) for i in plain])
        # Equal scores share a rank; a lower rank is joined first.
        ranks = np.unique(-scores, return_inverse=True)[1]
        rank = dict(zip(pieces, ranks.tolist()))
        number = {piece: i for i, piece in enumerate(pieces)}
        self.size = len(pieces)
        signs = sorted(piece for piece in pieces if len(piece) == 1)
        self.sign_points = np.array([ord(s) for s in signs], np.int64)
        self.sign_numbers = np.array([number[s] for s in signs], np.int64)

        made, reach = [], np.array([len(piece) for piece in pieces], np.int64)
        for piece in pieces:
            here, length = rank[piece], len(piece)
            for begin in range(length - 1):
                for end in range(begin + 2, length + (begin > 0)):
                    # A piece inside one of a lower rank can grow to that one's length at once.
                    if rank.get(part := piece[begin:end], -1) >= here:
                        reach[number[part]] = max(reach[number[part]], length)
            for cut in range(1, length):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    made.append((left * self.size + right, number[piece], here))
        made.sort()
        self.keys, self.results, self.pair_ranks = (np.array(c, np.int64) for c in zip(*made))
        lengths = np.array([len(piece) for piece in pieces], np.int64)
        # Signs that joined ones of this rank must lie apart, 0 if they only must not overlap.
        self.apart = np.zeros(int(ranks.max()) + 1, np.int64)
        np.maximum.at(self.apart, ranks, np.where(reach > lengths, 2 * reach, 0))

        points = [np.array([ord(s) for s in piece], np.int64) for piece in pieces if len(piece) > 1]
        self.inside = np.unique(np.concatenate([(p[:-1] << 21) | p[1:] for p in points]))
        self.words_part = not any(BLANK in piece.lstrip(BLANK) for piece in pieces)
        # A pattern of pre-tokens: signs of no longer piece stand alone, and a word of letters ends
        # before a sign that follows a letter in no piece. Other ends are found in the arrays.
        pairs = {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}
        joined = set("".join(pairs)) | {BLANK}
        marks = [chr(i) for i in range(128) if not re.match(f"[{LETTERS}]", chr(i))]
        alone = "".join(re.escape(m) for m in marks if m not in joined)
        after = {p[1] for p in pairs if re.match(f"[{LETTERS}]", p)}
        ends = "".join(re.escape(m) for m in marks if m in joined and m not in after)
        word = f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")
        self.words = re.compile(f"{BLANK}*[{LETTERS}]+(?=[{ends}])|{word}" if ends else word)
        # Blanks join last, from the left, up to one length: then a longer run has one piece more.
        blanks = {p: rank[p] for p in pieces if len(p) > 1 and not p.strip(BLANK)}
        self.blank_run = max(map(len, blanks)) if set(blanks.values()) == {int(ranks.max())} else 0
        if self.blank_run:
            runs = [BLANK * n for n in range(self.blank_run, 4 * self.blank_run)]
            counts = merged_counts(runs, self)
            if (counts[self.blank_run :] != counts[: -self.blank_run] + 1).any():
                self.blank_run = 0

    def pair_table(self) -> dict[int, tuple[int, int]]:
        """Rank and piece of each pair, made when the first long sequence needs it."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.pair_ranks.tolist(), self.results.tolist())))
        return self.table

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE`` if it makes no piece) and the piece it makes."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left < self.size) & (right < self.size)
        return np.where(hit, self.pair_ranks[at], NONE), np.where(hit, self.results[at], -1)


def heap_count(symbols: list[int], weights: list[int], model: PieceModel) -> int:
    """Tokens of one sequence, its pairs joined one by one, the leftmost of the lowest rank first."""
    pairs, size, end = model.pair_table(), model.size, len(symbols)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))

    def entry(left: int):
        right = after[left] if left >= 0 else end
        if right < end and symbols[left] < size and symbols[right] < size:
            found = pairs.get(symbols[left] * size + symbols[right])
            if found is not None:
                return (found[0], left, symbols[left], symbols[right], found[1])
        return None

    heap = [e for e in map(entry, range(end)) if e is not None]
    heapq.heapify(heap)
    while heap:
        _, left, a, b, made = heapq.heappop(heap)
        right = after[left]
        if symbols[left] != a or right >= end or symbols[right] != b:
            continue
        symbols[left], symbols[right], weights[right] = made, -1, 0
        after[left] = after[right]
        if after[left] < end:
            before[after[left]] = left
        for e in (entry(before[left]), entry(left)):
            if e is not None:
                heapq.heappush(heap, e)
    return sum(weights)


def merged_counts(words: list[str], model: PieceModel) -> np.ndarray:
    """Tokens of each pre-token."""
    total = np.zeros(len(words), np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.minimum(np.searchsorted(model.sign_points, points), len(model.sign_points) - 1)
    known = model.sign_points[at] == points
    symbol = np.where(known, model.sign_numbers[at], model.size)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    weight = np.where(known, 1, width)

    # Sequences: parts of pre-tokens between neighbours that no piece holds.
    key = (points[:-1] << 21) | points[1:]
    found = np.minimum(np.searchsorted(model.inside, key), len(model.inside) - 1)
    goes_on = (model.inside[found] == key) & (word[1:] == word[:-1])
    first = np.r_[True, ~goes_on]
    sequence = np.cumsum(first) - 1
    owner = word[first]
    place = np.arange(len(symbol))  # where a symbol begins, in signs
    rounds = 0
    while len(symbol):
        if rounds == ROUNDS:
            borders = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1], True])
            for a, b in zip(borders[:-1], borders[1:]):
                total[owner[sequence[a]]] += heap_count(symbol[a:b].tolist(), weight[a:b].tolist(), model)
            break
        rounds += 1
        linked = sequence[1:] == sequence[:-1]
        rank, makes = model.pairs(symbol[:-1], symbol[1:])
        rank, makes = np.r_[np.where(linked, rank, NONE), NONE], np.r_[makes, -1]
        begins = np.flatnonzero(np.r_[True, ~linked])
        sizes = np.diff(np.r_[begins, len(symbol)])
        lowest = np.minimum.reduceat(rank, begins)
        done = np.repeat(lowest == NONE, sizes)
        np.add.at(total, owner[sequence[done]], weight[done])
        joins = np.flatnonzero((rank == np.repeat(lowest, sizes)) & ~done)
        whose = sequence[joins]
        apart = model.apart[rank[joins]]
        other = np.r_[True, whose[1:] != whose[:-1]]
        # A row: pairs that follow each other. In a row of overlapping pairs each second one joins.
        row = np.flatnonzero(other | np.r_[True, np.diff(joins) > 1])
        within = np.arange(len(joins)) - np.repeat(row, np.diff(np.r_[row, len(joins)]))
        free = other | (np.diff(place[joins], prepend=0) >= apart)
        left = joins[np.where(apart > 0, free, within % 2 == 0)]
        symbol[left] = makes[left]
        stays = ~done
        stays[left + 1] = False
        symbol, sequence, weight, place = symbol[stays], sequence[stays], weight[stays], place[stays]
    return total


class Counter:
    """Counts of texts, with a bounded cache of pre-tokens."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def runs(self, text: str) -> Iterator[str]:
        """A normalised text in parts that end between pre-tokens."""
        begin = 0
        while begin < len(text):
            end = begin + RUN_SIGNS
            if end >= len(text) or not self.model.words_part:
                yield text[begin:]
                return
            # The next blank that another sign precedes.
            while 0 <= (end := text.find(BLANK, end)) and text[end - 1] == BLANK:
                end += 1
            end = end if end > 0 else len(text)
            yield text[begin:end]
            begin = end

    def shortened(self, word: str) -> tuple[str, int]:
        """A pre-token with fewer leading blanks, and how many pieces of blanks are left out."""
        longest = self.model.blank_run
        blanks = len(word) - len(word.lstrip(BLANK)) if longest else 0
        pieces = max(blanks // longest - 2, 0) if longest else 0
        return word[pieces * longest :], pieces

    def learn(self, words: Iterable[str]) -> None:
        new = []
        for word in words:
            known = self.old.get(word)
            if known is None:
                new.append(word)
            else:
                self.young[word] = known
        if new:
            self.young.update(zip(new, merged_counts(new, self.model).tolist()))

    def flush(self, held: list[tuple[int, list[str]]], totals: np.ndarray) -> None:
        """Add the tokens of the held pre-tokens to their texts' totals; new ones merge together."""
        kinds = set().union(*(words for _, words in held))
        missing = kinds.difference(self.young)
        if missing:
            if len(self.young) > CACHE_WORDS:
                self.old, self.young, missing = self.young, {}, kinds
            self.learn(missing)
        for at, words in held:
            totals[at] += sum(map(self.young.__getitem__, words))
        held.clear()

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text; null is empty."""
        texts = list(texts)
        totals, held, size = np.zeros(len(texts), np.int64), [], 0
        for at, text in enumerate(texts):
            for run in self.runs(self.model.library.normalize(text) if text else ""):
                words = self.model.words.findall(run) if self.model.words_part else [run]
                long = [w for w in words if len(w) > CACHED_SIGNS]
                if long:
                    words = [w for w in words if len(w) <= CACHED_SIGNS]
                    short, pieces = zip(*map(self.shortened, long))
                    totals[at] += sum(pieces) + merged_counts(list(short), self.model).sum()
                held.append((at, words))
                size += len(run)
                if size > RUN_SIGNS:
                    self.flush(held, totals)
                    size = 0
        self.flush(held, totals)
        return totals.tolist()


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``doc_id, text``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = pa.array(counter(path).counts(text.as_py() for text in batch.column(2)), pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], tokens], names=["doc_id", "n_bytes", "n_tokens"])

    counted = map_slices(rows, work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
