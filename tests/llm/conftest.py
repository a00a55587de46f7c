import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp string, x0 string, key string"

LONG = "word after word of a long text, " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, long and repeated texts, equal ids, clashing names."""
    texts = [None, "", " \n\t ", "12 345 #!", LONG, "The same text of some words here.", "The same text of some words here."]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 2 else "src", None, "a", "b", None, "d") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "A text without an id, and some words.", "en", None, 3, None, None, "c", None), (None,) * 9]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
