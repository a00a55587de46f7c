import hashlib
import zlib

import pytest
from conftest_data import SMALL
from kickpool.llm import trie
from kickpool.llm.common import table
from kickpool.llm.queries import op12_prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, n bigint, depth string"


def brute(rows):
    """Every node from its members, by plain dictionaries."""
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv_id, []).append((turn is not None, turn or 0, mark, (role, text)))
    turns = {c: [t[3] for t in sorted(found)] for c, found in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members = {}
    for c, sequence in built.items():
        for d in range(len(sequence) + 1):
            members.setdefault(tuple(sequence[:d]), []).append(c)
    children, saved, leaves = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = saved.get(node, 0) + own
        leaves[node] = leaves.get(node, 0) or 1
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            saved[up] = saved.get(up, 0) + saved[node]
            leaves[up] = leaves.get(up, 0) + leaves[node]
    out = []
    for node, found in members.items():
        ends = sorted(c for c in found if len(built[c]) == len(node))
        out.append((
            min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children.get(node, 0), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, conversations):
    got = sorted((tuple(r) for r in trie.prefix_trie(spark, conversations).select(trie.OUTPUT).collect()), key=str)
    assert got == brute(conversations.select("conv_id", "turn", "role", "text").collect())
    return got


def test_whole_table(spark):
    rows = op12_prefix_trie(spark, SMALL)
    assert rows.columns == trie.OUTPUT
    got = sorted((tuple(r) for r in rows.collect()), key=str)
    assert got == brute(table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect())


@pytest.mark.parametrize("block, run", [(2, 1), (3, 40), (256, 60)])
def test_strata_borders_and_hot_copies(spark, monkeypatch, block, run):
    """Small strata and ranges; half of the conversations alike, one very long, one hot first turn."""
    monkeypatch.setattr(trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(trie, "RUN_TURNS", run)
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = []
    for c in range(240):
        kinds = ["a", "b"] if c % 2 else ["a", *str(c * 7919)[: c % 5]]
        rows += [(c, i, "user" if i % 2 else "bot", text, 1, None) for i, text in enumerate(kinds)]
    rows += [(300, i, "user", str(i % 3), 1, None) for i in range(40)]
    rows += [(301, i, "user", str(i % 3), 1, None) for i in range(33)]
    try:
        got = check(spark, spark.createDataFrame(rows, TURNS).repartition(5))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(r[1] for r in got) >= 33


def test_odd_rows(spark):
    rows = [
        (5, None, None, None, 1, "x"), (5, None, "", "", 1, "x"), (5, 1, "user", "hi", None, None), (5, 1, "user", "hi", None, None),
        (5, 1, "bot", "hé漢😀", 2, None), (None, 1, "user", "gone", 2, None), (-3, 2, "r", "negative", 2, None), (-3, 1, "r", "", 2, None),
        (100, 0, "system", "base", 0, None), (101, 0, "system", "other", 0, None), (101, 3, "user", "long " * 50_000, 0, None),
        (230, 0, "user", "one turn", 0, None), (231, 0, "user", "one turn", 0, None), (None, None, None, None, None, None),
    ]
    check(spark, spark.createDataFrame(rows, TURNS))
    assert trie.prefix_trie(spark, spark.createDataFrame([], TURNS)).count() == 0
