"""Ternary search tree over the turn ids of one range of sorted sequences, and its node figures.

The range's turns are encoded by a dictionary of their own, whose numbers keep the order of the
digests. Sequences of one stratum share a tree; the median of a range of them is inserted before
its halves, which balances the search trees below each node. Nodes are made after the node they
hang on, so going through them backwards is an iterative post-order: each hands its members,
leaves and savings to the node above.

The range's first and last sequence are its border: their nodes may go on in other ranges. They
come as two paths with the sums of what hangs on them inside this range alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np

DIGEST = 16  # bytes of a turn's digest
NO_CONV = 1 << 63


class Tree:
    """Trees of one range. ``rows`` are ``(k, px, py, seq, chars, n, conv_id, ekey, more, children,
    leaves, saved)`` in order of their first four; the last three hang below a sequence's end."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows
        digests = np.frombuffer(b"".join(r[3] for r in rows), f"S{DIGEST}")
        words, ids = np.unique(digests, return_inverse=True)
        chars = np.zeros(len(words), np.int64)
        if len(digests):
            chars[ids] = np.fromiter((c for r in rows for c in r[4]), np.int64, len(digests))
        self.ids, self.word_chars = ids.tolist(), chars.tolist()
        self.starts = np.cumsum([0] + [len(r[3]) // DIGEST for r in rows]).tolist()
        self.label, self.low, self.high, self.equal = [], [], [], []
        self.up, self.depth, self.stratum, self.row = [], [], [], []
        begin = 0
        while begin < len(rows):
            end = begin + 1
            while end < len(rows) and rows[end][:3] == rows[begin][:3]:
                end += 1
            self.plant(begin, end)
            begin = end

    def node(self, label: int, up: int, depth: int, stratum: int) -> int:
        self.label.append(label)
        self.low.append(-1)
        self.high.append(-1)
        self.equal.append(-1)
        self.up.append(up)
        self.depth.append(depth)
        self.stratum.append(stratum)
        self.row.append(-1)
        return len(self.label) - 1

    def plant(self, begin: int, end: int) -> None:
        root = self.node(-1, -1, 0, begin)
        ranges = [(begin, end)]
        while ranges:
            first, last = ranges.pop()
            if first < last:
                median = (first + last) // 2
                self.insert(median, root)
                ranges += [(median + 1, last), (first, median)]

    def insert(self, i: int, root: int) -> None:
        label, low, high, equal = self.label, self.low, self.high, self.equal
        above = root
        for x in self.ids[self.starts[i] : self.starts[i + 1]]:
            at = equal[above]
            if at < 0:
                at = equal[above] = self.node(x, above, self.depth[above] + 1, self.stratum[root])
            while (y := label[at]) != x:
                branch = low if x < y else high
                if branch[at] < 0:
                    branch[at] = self.node(x, above, self.depth[above] + 1, self.stratum[root])
                at = branch[at]
            above = at
        self.row[above] = i

    def path(self, i: int) -> list[int]:
        """Nodes of a sequence from its stratum's root on."""
        at = next(v for v in self.ends if self.row[v] == i)
        nodes = []
        while at >= 0:
            nodes.append(at)
            at = self.up[at]
        return nodes[::-1]

    def figures(self, run: int) -> Iterator[tuple]:
        """Rows of ``NODE`` for all nodes: inner ones whole, border ones as two paths of parts."""
        count = len(self.label)
        self.ends = [v for v in range(count) if self.row[v] >= 0]
        paths = [self.path(0), self.path(len(self.rows) - 1)]
        side = {v: 1 for v in paths[1]} | {v: 0 for v in paths[0]}
        n, conv = [0] * count, [NO_CONV] * count
        children, leaves, saved, more = [0] * count, [0] * count, [0] * count, [False] * count
        ekey: list[str | None] = [None] * count
        for v in self.ends:
            _, _, _, _, _, n[v], conv[v], ekey[v], more[v], children[v], leaves[v], saved[v] = self.rows[self.row[v]]
        for v in range(count - 1, -1, -1):
            up, border = self.up[v], v in side
            chars = self.word_chars[self.label[v]] if up >= 0 else 0
            if not border:
                saved[v] += (n[v] - 1) * chars
                if not children[v] and not more[v]:
                    leaves[v] = 1
            if up >= 0:
                n[up] += n[v]
                conv[up] = min(conv[up], conv[v])
                if not border:  # a border node's own figures are known after the merge only
                    children[up] += 1
                    leaves[up] += leaves[v]
                    saved[up] += saved[v]
        for v in range(count):
            if v in side:
                continue
            k, px, py = self.rows[self.stratum[v]][:3]
            up = self.up[v]
            known = up >= 0 and up not in side
            yield (
                run, False, None if up < 0 or known else side[up], k, px, py, self.depth[v], conv[v], n[v], children[v],
                leaves[v], saved[v], more[v], 0, ekey[v], conv[up] if known else None, None, None,
            )
        told = set()
        for which, nodes in enumerate(paths):
            k, px, py = self.rows[self.stratum[nodes[0]]][:3]
            digest, above = hashlib.md5(struct.pack(">qqq", k, px, py)), None
            last = self.rows[0 if which == 0 else -1][3]
            for d, v in enumerate(nodes):
                if d:
                    digest.update(last[(d - 1) * DIGEST : d * DIGEST])
                key, fresh = digest.hexdigest(), v not in told
                told.add(v)
                chars = self.word_chars[self.label[v]] if d else 0
                parts = (conv[v], n[v], children[v], leaves[v], saved[v], more[v]) if fresh else (None, 0, 0, 0, 0, False)
                yield (run, True, which, k, px, py, d, *parts, chars, ekey[v] if fresh else None, None, key, above)
                above = key
