import random
import re
from collections import Counter

import numpy as np
from conftest_data import MEDIUM, SMALL
from kickpool.llm import quality_rules
from kickpool.llm.common import table
from kickpool.llm.queries import QUERIES


def by_hand(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if windows[window] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark):
    rows = QUERIES["op2_quality_rules"](spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "text"), "doc_id")
    for r in rows.collect():
        want = by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_counts_of_random_texts():
    chance = random.Random(3)
    for _ in range(300):
        text = "".join(chance.choices(["a", "b", "é ", " ", " ", "\n", "#", "|x ", "a b a b "], k=chance.randint(0, 40)))
        assert quality_rules.counts(text)[:5] == by_hand(text)


def test_labelled_documents(spark):
    rows = QUERIES["op2_quality_rules"](spark, MEDIUM).join(table(spark, MEDIUM, "labels"), "doc_id")
    rows = rows.where("NOT base_failed").select("quality", "kept").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_steps_are_those_of_plain_arrays(spark):
    chance = np.random.default_rng(1)
    values = chance.normal(0, 0.3, (400, quality_rules.D)) + np.arange(quality_rules.D)
    values[:60] += 3
    names = [f"x{i}" for i in range(quality_rules.D)]
    rows = spark.createDataFrame([("g", *map(float, v)) for v in values], "key string, " + ", ".join(f"{n} double" for n in names))
    start = quality_rules.first_estimates(rows)
    one = start.first()
    got = quality_rules.concentrate(rows, start).first()
    inverse = np.zeros((quality_rules.D,) * 2)
    for at, (i, j) in enumerate(quality_rules.PAIRS):
        inverse[i, j] = inverse[j, i] = one.w[at]
    apart = values - np.array(one.m)
    distance = np.einsum("ni,ij,nj->n", apart, inverse, apart)
    bins = np.floor(np.log2(distance + 1e-9) / quality_rules.BIN_WIDTH)
    limit = np.sort(bins)[int(np.ceil(quality_rules.SUPPORT * len(values))) - 1]
    near = values[bins <= limit]
    assert np.allclose(got.m, near.mean(axis=0))
    want = np.linalg.inv(np.cov(near.T, bias=True) + np.diag(np.square(quality_rules.FLOOR)))
    assert np.allclose(got.w, [want[i, j] for i, j in quality_rules.PAIRS])
    assert abs(np.array(got.m) - np.arange(quality_rules.D)).max() < 0.2  # the 60 far rows have no pull


def test_odd_rows(spark, odd_docs, no_docs):
    rows = quality_rules.judge(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.kept is not None
        if r.doc_id in (0, 1, 2):
            assert (r.n_words, r.base_failed, r.kept) == (0, True, False)
    assert next(r for r in rows if r.doc_id == 4).n_words == 280_000
    assert quality_rules.judge(spark, no_docs).count() == 0


def odd_text(kind, chance):
    """A text that is unlike ``sound_text`` in one statistic."""
    words = ["".join(chance.choices("abcdefghij", k=chance.randint(3, 8))) for _ in range(300)]
    if kind == "word_length":
        return " ".join(a + b + c for a, b, c in zip(words, words[1:], words[2:]))
    if kind == "symbols":
        return " ".join(w + "#" * (i % 2) for i, w in enumerate(words))
    if kind == "dup_lines":  # 95 % of one-word lines, no window of three words twice
        lines, seen = words[:2], set()
        while len(lines) < 200:
            lines.append(next(w for w in chance.sample(words[:10], 10) if (*lines[-2:], w) not in seen))
            seen.add(tuple(lines[-3:]))
        return "\n".join(lines)
    if kind == "repeats":
        return " ".join(words + words[:90])
    if kind == "capitals":
        return " ".join(w.upper() if i % 2 else w for i, w in enumerate(words))
    return " ".join(w + "!" * (i % 3) for i, w in enumerate(words))


def sound_text(chance):
    words = ["".join(chance.choices("abcdefghij", k=chance.randint(3, 8))) for _ in range(chance.randint(60, 400))]
    words = [w + "." * (chance.random() < 0.1) for w in words]
    words = [w.capitalize() if chance.random() < 0.1 else w for w in words]
    return "\n".join(" ".join(words[at : at + 20]) for at in range(0, len(words), 20))


def test_each_statistic_alone_rejects(spark):
    chance = random.Random(11)
    docs = [(n, "en", "s", sound_text(chance)) for n in range(300)]
    docs += [(1000 + n, "en", "s", odd_text(kind, chance)) for n, kind in enumerate(quality_rules.STATISTICS)]
    rows = quality_rules.judge(spark, spark.createDataFrame(docs, "doc_id bigint, lang string, source string, text string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[1000 + n].kept for n in range(quality_rules.D)] == [False] * quality_rules.D
    assert sum(got[n].kept for n in range(300)) >= 299


def test_distance_is_mahalanobis_with_the_counting_variance():
    chance = np.random.default_rng(4)
    root = chance.normal(0, 0.2, (quality_rules.D,) * 2)
    scatter, x, m = root @ root.T, chance.normal(0, 1, quality_rules.D), chance.normal(0, 1, quality_rules.D)
    inverse = np.linalg.inv(scatter)
    w = np.array([[inverse[i, j] for i, j in quality_rules.PAIRS]])
    far = quality_rules.final_distances(x[None], np.full((1, quality_rules.D), 1e9), m[None], w)[0]
    assert np.isclose(far * quality_rules.CONSISTENCY, (x - m) @ inverse @ (x - m))
    short = quality_rules.final_distances(x[None], np.full((1, quality_rules.D), 2.0), m[None], w)[0]
    assert 0 < short < far


def test_cutoff_and_consistency_are_those_of_chi_squared():
    from math import exp, factorial

    def above(x, degrees):
        return exp(-x / 2) * sum((x / 2) ** j / factorial(j) for j in range(degrees // 2))

    assert abs(above(quality_rules.CUTOFF, quality_rules.D) / quality_rules.LEVEL - 1) < 1e-3
    assert abs(1 - above(7.841, quality_rules.D) - quality_rules.SUPPORT) < 1e-4
    assert abs(quality_rules.SUPPORT / (1 - above(7.841, quality_rules.D + 2)) - quality_rules.CONSISTENCY) < 1e-3
