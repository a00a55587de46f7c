import hashlib
import zlib

import pytest
from conftest_data import SMALL
from kickpool.llm import merkle
from kickpool.llm.common import table
from kickpool.llm.queries import op11_merkle_manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute(rows):
    """``(doc_id, leaf, subroot, root, proof, folded_root)`` of dictionaries, level by level."""

    def tree(digests):
        paths, levels = [[] for _ in digests], list(digests)
        at = list(range(len(digests)))
        while len(levels) > 1:
            for i, path in enumerate(paths):
                run = levels[at[i] // 3 * 3 : at[i] // 3 * 3 + 3]
                path.append((run[: at[i] % 3], run[at[i] % 3 + 1 :]))
                at[i] //= 3
            levels = [h(*levels[i : i + 3]) for i in range(0, len(levels), 3)]
        return levels[0], paths

    groups = {}
    for row in rows:
        text = row["text"]
        if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups.setdefault(row["source"], []).append((row["doc_id"], leaf(row, row["text"]), leaf(row, text)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        trees[name] = tree([r[1] for r in groups[name]])
    if not names:
        return []
    root, upper = tree([trees[name][0] for name in names])
    out = []
    for name, above in zip(names, upper):
        for (doc_id, own, changed), path in zip(groups[name], trees[name][1]):
            proof, folded = "", changed
            for left, right in path + above:
                proof += "".join(left + right)
                folded = h(*left, folded, *right)
            out.append((doc_id, own, trees[name][0], root, h(proof), folded, folded == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, docs):
    got = [tuple(r) for r in merkle.manifest(spark, docs).select(COLUMNS).collect()]
    want = brute([r.asDict() for r in docs.select(*merkle.FIELDS).collect()])
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_whole_table(spark):
    rows = op11_merkle_manifest(spark, SMALL)
    assert rows.columns == COLUMNS or set(rows.columns) == set(COLUMNS)
    got = sorted((tuple(r) for r in rows.select(COLUMNS).collect()), key=str)
    want = brute([r.asDict() for r in table(spark, SMALL, "documents").collect()])
    assert got == sorted(want, key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 800])
def test_sizes_of_sources_and_blocks(spark, n, monkeypatch):
    """One hot source, a missing one, one of a single row; several climbs with small blocks."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    docs = spark.range(n).selectExpr(
        "id AS doc_id", "concat('line', char(10), id) AS text", "id AS n_chars", "'en' AS lang",
        "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id = 1 THEN 'ü' WHEN id % 4 = 1 THEN concat('s', id % 13) END AS source",
    )
    check(spark, docs)


def test_odd_rows(spark, odd_docs, no_docs):
    got = check(spark, odd_docs)
    assert len(got) == odd_docs.count()
    assert merkle.manifest(spark, no_docs).count() == 0
