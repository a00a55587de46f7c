import math
import re

from conftest_data import MEDIUM
from kickpool.llm import language
from kickpool.llm.common import table
from kickpool.llm.queries import QUERIES


def spectrum(text):
    """N-grams of one to three signs, by plain slicing."""
    letters = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    padded = f" {letters} "
    return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}


def test_kernel_is_shared_grams_over_root_of_sizes():
    texts = ["The cat and the hat.", "Der Hund, die Katze!", "the hat, the cat", "Über 20 Öfen", "x"]
    letters = sorted({ord(c) for t in texts for c in t.lower() if c.isalpha()})
    alphabet = language.Alphabet.of(letters)
    read = [list(alphabet.segments(t)) for t in texts]
    grams = [r[0][0] for r in read]
    sets = [spectrum(t) for t in texts]
    assert [len(g) for g in grams] == [len(s) for s in sets]
    landmarks = language.Landmarks.of(grams)
    kernel = landmarks.times(read, landmarks.table)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert abs(kernel[i, j] - len(a & b) / math.sqrt(len(a) * len(b))) < 1e-6
    model = language.fit(alphabet, grams, kernel, ["en", "de", "en", "de", "fr"])
    assert model.predict(texts)[0] == ["en", "de", "en", "de", "fr"]


def test_a_text_is_the_mean_of_its_segments():
    alphabet = language.Alphabet.of([ord(c) for c in "abcdefgh"])
    text = " ".join(["abc"] * 500 + ["fgh"] * 250)
    read = list(alphabet.segments(text))
    assert len(read) == 3 and sum(n for _, n in read) == 3001
    landmarks = language.Landmarks.of([alphabet_grams(alphabet, "abc abc"), alphabet_grams(alphabet, "fgh fgh")])
    one = landmarks.times([read[:1]], landmarks.table)[0]
    last = landmarks.times([read[-1:]], landmarks.table)[0]
    mean = landmarks.times([read], landmarks.table)[0]
    assert one[0] > 0.9 and last[1] > 0.8 and abs(mean[0] / one[0] - 2 / 3) < 0.05


def alphabet_grams(alphabet, text):
    return next(alphabet.segments(text))[0]


def test_letters_beyond_the_basic_plane_are_letters():
    alphabet = language.Alphabet.of([97])
    assert list(alphabet.segments("\U00010400\U00010401")) and not list(alphabet.segments("\U0001f600 1"))


def test_most_of_a_text_decides(spark):
    docs = table(spark, MEDIUM, "documents")
    texts = {r.lang: r.text for r in docs.where("n_chars BETWEEN 1500 AND 2500").orderBy("doc_id").collect()}
    model = language.train(spark, docs)
    mixed = [texts["en"] + " " + texts["en"][:900] + "\n" + texts[o][:500] for o in ("de", "fr", "es")]
    assert model.predict(mixed)[0] == ["en"] * 3


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_language_id"](spark, MEDIUM).join(table(spark, MEDIUM, "documents"), "doc_id")
    held = rows.where("held_out AND lang IS NOT NULL").select("lang", "lang_pred", "score").collect()
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_odd_rows(spark, odd_docs, no_docs):
    model = language.train(spark, table(spark, MEDIUM, "documents"))
    rows = language.identify(spark, odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    named = [(r.doc_id, r.lang_pred) for r in rows]
    for doc_id in (0, 1, 2, 3):
        assert (doc_id, "und") in named
    assert (4, "en") in named and (None, "en") in named and (None, "und") in named
    kept = language.keep_identified(spark, odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "5", "6", "None"]
    assert language.identify(spark, no_docs, model).count() == 0
    untrained = language.train(spark, no_docs)
    assert {r.lang_pred for r in language.identify(spark, odd_docs, untrained).collect()} == {"und"}


SCRIPTS = {"latin": 97, "cyrillic": 0x430, "greek": 0x3B1, "hebrew": 0x5D0, "devanagari": 0x915, "hangul": 0xAC00, "han": 0x4E00, "gothic": 0x10330}


def made_up(first, chance, n=120):
    """Words of 20 letters from ``first`` on."""
    return " ".join("".join(chr(first + chance.randrange(20)) for _ in range(chance.randint(2, 7))) for _ in range(n))


def test_many_scripts_are_told_apart(spark):
    import random

    chance = random.Random(5)
    rows = [(i, name, made_up(first, chance)) for i, (name, first) in enumerate(list(SCRIPTS.items()) * 12)]
    # the rare scripts come last, so the frequent letters are of the others
    rows += [(1000 + i, name, made_up(SCRIPTS[name], chance, 400)) for i, name in enumerate(["latin", "cyrillic", "greek"] * 10)]
    model = language.train(spark, spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    got = model.predict([made_up(first, chance) for first in SCRIPTS.values()])[0]
    assert got == list(SCRIPTS)


def test_grams_with_other_letters_are_those_of_the_text():
    texts = ["аб вг", "аб вд", "abc жзи abc", "\U00010330\U00010331 x", "漢字かな"]
    alphabet = language.Alphabet.of([ord("a"), ord("b")])
    grams = [set(next(alphabet.segments(t))[0].tolist()) for t in texts]
    sets = [spectrum(t) for t in texts]
    for a, b in zip(grams, sets):
        assert len(a) == len(b)
        for c, d in zip(grams, sets):
            assert len(a & c) == len(b & d)


def test_every_language_is_learned(spark):
    rows = [(2 * i + j, f"l{i:03d}", " ".join([chr(0x4E00 + 3 * i) + chr(0x4E01 + 3 * i)] * 20)) for i in range(140) for j in range(2)]
    model = language.train(spark, spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert len(model.languages) == 140
    assert model.predict([r[2] for r in rows[::2]])[0] == [r[1] for r in rows[::2]]
