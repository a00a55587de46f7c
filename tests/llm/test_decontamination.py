import itertools
import random
import re

from conftest_data import SMALL
from kickpool.llm import decontamination as d
from kickpool.llm.common import table
from kickpool.llm.queries import QUERIES


def words(text):
    return [w for w in (re.sub(r"[\W_]+", "", w.lower()) for w in (text or "").split()) if w]


def overlaps_by_hand(doc, item):
    """Whether any diagonal has a window of 12 words (or the item) with 0.8 equal words."""
    doc, item = words(doc), words(item)
    if len(item) < d.SPAN:
        return False
    least = min(d.MIN_WORDS, len(item))
    for shift in range(-len(item), len(doc) + 1):
        equal = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
        sums = [0, *itertools.accumulate(equal)]
        for i in range(len(equal) - least + 1):
            for j in range(i + least, len(equal) + 1):
                if sums[j] - sums[i] >= d.SIMILARITY * (j - i):
                    return True
    return False


def test_masks_hit_every_window():
    for length, misses in ((12, 2), (15, 3)):
        for gone in itertools.combinations(range(length), misses):
            assert any(
                not any(at + o in gone for o in mask) for mask in d.MASKS for at in range(length - d.SPAN + 1)
            )


def test_longest_window_by_brute_force():
    import numpy as np

    chance = random.Random(2)
    for _ in range(300):
        equal = np.array([chance.random() < 0.7 for _ in range(chance.randint(1, 30))])
        i, j = d.longest_window(equal)
        best = max((b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a:b].sum() >= 0.8 * (b - a)), default=0)
        assert j - i == best and (j == i or equal[i:j].sum() >= 0.8 * (j - i))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").where("n_chars < 4000").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    ids = {i for i, _ in docs}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, SMALL).collect() if r.doc_id in ids}
    want = set()
    for doc_id, text in docs:
        have = set(words(text))
        for item_id, item in items:
            if len(have & set(words(item))) >= 8 and overlaps_by_hand(text, item):
                want.add((doc_id, item_id))
    assert got == want and want


def test_substitutions(spark):
    chance = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    items, docs = [], []
    for n in range(40):
        item = chance.choices(vocabulary, k=chance.randint(12, 40))
        changed = list(item)
        for at in chance.sample(range(len(item)), int(len(item) * chance.choice((0, 0.1, 0.2, 0.5)))):
            changed[at] = "other"
        doc = chance.choices(vocabulary, k=30) + changed + chance.choices(vocabulary, k=30)
        items.append((n, " ".join(item)))
        docs.append((n, ", ".join(doc).upper()))
    got = d.overlaps(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert got == {(a, b) for a, doc in docs for b, item in items if a == b and overlaps_by_hand(doc, item)}


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "word after word of a long text, word after word of a long text"), (2, None), (3, ""), (None, "short one"), (1, "word after word of a long text, word after word of a long text")]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    rows = d.overlaps(spark, odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(4, 1)} and len(rows) >= 1
    kept = d.remove_contaminated(spark, odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 1
    assert d.overlaps(spark, no_docs, items).count() == 0
    assert d.overlaps(spark, odd_docs, items.limit(0)).count() == 0
    assert d.remove_contaminated(spark, odd_docs, items.limit(0)).count() == odd_docs.count()


def test_short_items_by_brute_force():
    """Lengths 1 to 12: exact under nine words, else every choice of as many substitutions as allowed."""
    for length in range(1, 13):
        item = [f"w{i}" for i in range(length)]
        block = d.Items.of([(length, " ".join(item))])
        allowed = 0 if length < d.SPAN else int(length * (1 - d.SIMILARITY) + 1e-9)
        for misses in range(allowed + 2):
            texts = []
            for gone in itertools.combinations(range(length), misses):
                texts.append("x y z " + " ".join("other" if i in gone else w for i, w in enumerate(item)) + " u v")
            rows = {row for row, *_ in block.overlaps(["w0", *texts, *texts[:1]])} - {0}
            assert len(rows) == (len(texts) + min(1, len(texts)) if misses <= allowed else 0), (length, misses)
        if length > 1:  # not across the border of two documents
            assert not list(block.overlaps([" ".join(item[:1]), " ".join(item[1:])]))


def test_scripts_without_blanks(spark):
    items = [(1, "\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059\u304b"), (2, "\u0e01\u0e02\u0e04\u0e07\u0e08"), (3, "\u6771\u5317")]
    docs = [(1, "\u4eca\u65e5" + items[0][1] + "\u3002\u6771\u897f"), (2, "x " + items[1][1] + "\u0e09"), (3, "Tokyo"), (4, "who wrote it?")]
    items.append((4, "Who wrote it"))
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in d.overlaps(spark, docs, items).collect()} == {(1, 1), (2, 2), (4, 4)}
    assert [r.doc_id for r in d.remove_contaminated(spark, docs, items).collect()] == [3]


def test_equal_items_share_one_text(spark, monkeypatch):
    """Items alike are one text, blocks stay bounded, and every item's id is reported."""
    monkeypatch.setattr(d, "BLOCK_CHARS", 2_000)
    same = " ".join(f"same{i}" for i in range(20))
    texts = [" ".join(f"w{n}x{i}" for i in range(14)) for n in range(120)]
    items = [(n, same) for n in range(3_000)] + [(10_000 + n, t) for n, t in enumerate(texts)]
    items = spark.createDataFrame(items, "item_id int, text string")
    blocks = list(d.item_blocks(items))
    assert sum(map(len, blocks)) == 121 and len(blocks) > 3 and max(sum(len(t) for _, t in b) for b in blocks) < 8_000
    docs = [(1, f"before {same} after"), (2, "nothing of it"), (3, texts[5] + " " + texts[77]), (4, None), (4, texts[9].upper())]
    docs = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    found = {(r.doc_id, r.item_id) for r in d.overlaps(spark, docs, items).collect()}
    assert found == {(1, n) for n in range(3_000)} | {(3, 10_005), (3, 10_077), (4, 10_009)}
    kept = d.remove_contaminated(spark, docs, items)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == [(2, "nothing of it", "x"), (4, None, "x")]
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1


def test_ids_of_other_types(spark):
    text = " ".join(f"w{i}" for i in range(15))
    for kind, value in (("smallint", 7), ("string", "seven"), ("tinyint", 7), ("double", 7.5), ("binary", b"7"), ("date", None)):
        items = spark.createDataFrame([(value, text)], f"item_id {kind}, text string")
        docs = spark.createDataFrame([(value, "a " + text)], f"doc_id {kind}, text string")
        assert [(r.doc_id, r.item_id) for r in d.overlaps(spark, docs, items).collect()] == [(value, value)]
