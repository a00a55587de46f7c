import random

import public_tokenizers
import pytest
import sentencepiece
from conftest_data import MEDIUM
from kickpool.llm import token_counts
from kickpool.llm.queries import op13_token_counts

PATH = public_tokenizers.path(token_counts.VOCABULARY)
SIGNS = [*"abcdefghijklmnopqrstuvwxyzABC0123456789 \n\t.,-_/<>'▁\x00éüß漢字кирил", " ", "  ", "     ", "the", "kil", "kilom"]
SIGNS += ["<s>", "<0x0A>", "</s>", "<unk>", "😀", "Ĳ", "strong", "cker", "esse", "ﬁ", "​", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH)


def test_random_texts_as_the_library(library, counter):
    chance = random.Random(3)
    texts = ["".join(chance.choices(SIGNS, k=chance.randint(0, 60))) for _ in range(4000)]
    texts += [t.replace(" ", "") for t in texts[:1000]]
    assert counter.counts(texts) == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize("unit", ["a", "ab", "kil", "\n", "▁", " x", "the quick ", "thequick", "漢字", "😀", "aA", "  "])
def test_long_texts_without_and_with_blanks(library, counter, unit):
    for n in (1, 2, 17, 3000):
        assert counter.counts([unit * n]) == [len(library.encode(unit * n))]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_rest_of_long_sequences_from_a_heap(library, counter, monkeypatch, rounds):
    chance = random.Random(rounds)
    monkeypatch.setattr(token_counts, "ROUNDS", rounds)
    texts = ["".join(chance.choices(SIGNS, k=chance.randint(0, 80))) for _ in range(1_500)]
    texts += [t.replace(" ", "") for t in texts[:700]]
    model = counter.model
    marked = ["▁" + t.replace(" ", "▁") for t in texts if t]
    assert token_counts.merged_counts(marked, model).tolist() == [len(library.encode(t)) for t in texts if t]


def test_a_megabyte_without_blanks_in_seconds(library, counter):
    import time

    for unit in ("kilometer", "thequickbrownfoxjumps", "internationalization"):
        text = unit * (1_000_000 // len(unit))
        begin = time.perf_counter()
        assert counter.counts([text]) == [len(library.encode(text))]
        assert time.perf_counter() - begin < 60


def test_runs_of_blanks(library, counter):
    texts = [" " * n + end for n in range(120) for end in ("", "the", "9x")] + ["x" + " " * 99_999 + "y"]
    assert counter.counts(texts) == [len(library.encode(t)) for t in texts]


def test_texts_in_several_runs(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN_SIGNS", 50)
    text = "  some words,  and more words with blanks   between " * 40
    assert counter.counts([text, "x" * 400]) == [len(library.encode(t)) for t in (text, "x" * 400)]


def test_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 5)
    counter, texts = token_counts.Counter(PATH), ["one two three four five six seven", "six seven one ten", "two"] * 3
    for text in texts:
        assert counter.counts([text]) == [len(library.encode(text))]


def test_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = op13_token_counts(spark, MEDIUM).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = token_counts.count_tokens(odd_docs).collect()
    want = [(r.doc_id, len(library.encode(r.text or ""))) for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.n_bytes == 0 and not r.over_limit for r in rows if r.n_tokens == 0)
    assert token_counts.count_tokens(no_docs).count() == 0
