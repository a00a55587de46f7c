import random
import re

import numpy as np
import xxhash
from conftest_data import SMALL
from hypothesis import given, settings, strategies as st
from kickpool.llm import simhash
from kickpool.llm.common import table
from kickpool.llm.queries import QUERIES


def by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps):
    """Smallest member of each fingerprint's component, all pairs compared."""
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    fps = {i: by_hand(t) for i, t in docs.items()}
    label = groups_by_hand(sorted(set(fps.values())))
    smallest = {}
    for i in sorted(docs):
        smallest.setdefault(label[fps[i]], i)
    rows = QUERIES["op3_simhash"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == smallest[label[fps[r.doc_id]]]


@given(st.text(alphabet="aBc é\n\t ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == by_hand(text)


def clustered(chance, centres, members, bits):
    fps = set()
    for _ in range(centres):
        centre = chance.getrandbits(64)
        for _ in range(members):
            fps.add(centre ^ sum(1 << b for b in chance.sample(range(64), chance.randint(0, bits))))
    return sorted(fps)


def test_links_join_every_component(spark):
    chance = random.Random(4)
    fps = clustered(chance, 12, 40, 3) + clustered(chance, 200, 1, 0)
    rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    got = {
        r.fp & (1 << 64) - 1: r.component & (1 << 64) - 1
        for r in simhash.fingerprint_components(spark, rows).collect()
    }
    want = groups_by_hand(fps)
    assert len(got) == len(set(fps))
    for a in fps:
        for b in fps[:60]:
            assert (got[a] == got[b]) == (want[a] == want[b])


def test_forest_is_small_and_whole():
    chance = random.Random(9)
    fps = np.array(clustered(chance, 3, 150, 2), np.uint64)
    a, b = simhash.forest(fps)
    assert len(a) < len(fps)
    label = {int(f): int(f) for f in fps}
    label.update(zip(a.tolist(), b.tolist()))
    want = groups_by_hand([int(f) for f in fps])
    assert all((label[x] == label[y]) == (want[x] == want[y]) for x in want for y in list(want)[:40])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in blank} == {0} and len(blank) == 4
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    kept = simhash.keep_first(spark, odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "4", "5", "None"]
    assert simhash.near_duplicates(spark, no_docs).count() == 0
    assert simhash.keep_first(spark, no_docs).count() == 0


def test_equal_ids_with_different_texts_are_two_documents(spark):
    rows = [(5, "one text here now"), (5, "another text over there"), (3, "one text here now")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_first(spark, docs).collect())
    assert kept == [(3, "one text here now"), (5, "another text over there")]


def test_divided_buckets_lose_no_link(spark, monkeypatch):
    """Members of one bucket, in near clusters and far ones, under parts of at most a few rows."""
    chance = random.Random(12)
    same = chance.getrandbits(64) & ((1 << 22) - 1)  # the first two blocks of all
    fps = {f >> 22 << 22 | same for f in clustered(chance, 25, 12, 4) + clustered(chance, 150, 1, 0)}
    fps = sorted(fps | set(clustered(chance, 20, 3, 4)))
    rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    monkeypatch.setattr(simhash, "SPLIT_BUCKET", 8)
    got = {r.fp & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in simhash.fingerprint_components(spark, rows).collect()}
    want = groups_by_hand(fps)
    assert len(got) == len(fps)
    assert len({(got[a], want[a]) for a in fps}) == len({got[a] for a in fps}) == len({want[a] for a in fps})


def test_a_bucket_of_many_far_fingerprints_is_divided(spark):
    import time

    numbers = np.random.default_rng(5).integers(0, 1 << 42, 120_000, np.uint64) << np.uint64(22)
    rows = spark.createDataFrame([(int(f.view(np.int64)),) for f in numbers], "fp bigint").distinct()
    assert simhash.links(rows.limit(10)).count() >= 0
    begin = time.perf_counter()
    links = simhash.links(rows).distinct().collect()
    assert time.perf_counter() - begin < 60
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
