import math

import pytest
from pyspark.sql import functions as F

from kickpool.functions import labels, numbers, text


@pytest.mark.parametrize(
    "x, expected",
    [(-2.5, -2), (2.5, 3), (-0.5, 0), (0.49999999999999994, 0), (2.4, 2), (-2.6, -3), (None, None)],
)
def test_half_up(one, x, expected):
    assert one(numbers.half_up, x, "double") == expected


def test_clamp_keeps_null_and_nan(one):
    def bounded(x):
        return numbers.clamp(x, -16, 16)

    assert one(bounded, None, "double") is None
    assert math.isnan(one(bounded, float("nan"), "double"))
    assert [one(bounded, v, "double") for v in (-20.0, 3.5, 99.0)] == [-16.0, 3.5, 16.0]


@pytest.mark.parametrize(
    "x, expected",
    [("1.5", 15), ("1-2", 0), ("+7", 7), ("", 0), ("-9", -9), ("3位", 3), ("−5", 5), (None, 0)],
)
def test_noisy_int(one, x, expected):
    assert one(numbers.noisy_int, x) == expected


@pytest.mark.parametrize(
    "x, expected",
    [
        ("", None), (None, None), ("  ", 0.0), ("　", 0.0), (" 12　", 12.0), ("1e2", 100.0),
        (".5", 0.5), ("5.", 5.0), ("-0.5", -0.5), ("1d", None), ("NaN", None),
        ("1e999", None), ("-1e999", None), ("1 2", None), ("Infinity", None),
    ],
)
def test_nullable_number(one, x, expected):
    assert one(numbers.nullable_number, x) == expected
    fallback = 7.0 if expected is None else expected
    assert one(lambda c: numbers.number_or(c, 7), x) == fallback


def test_nullable_numbers(spark):
    texts = ["12", " 1.5e2\u3000", "", "  ", "\u3000", "abc", "1d", "NaN", "1e999", "-1e999", "-.5", "5.", ".", "1e", "+7", None]
    want = [12.0, 150.0, None, 0.0, 0.0, None, None, None, None, None, -0.5, 5.0, None, None, 7.0, None]
    df = spark.createDataFrame([(0, texts), (1, []), (2, None)], "k int, t array<string>")
    found = df.select("k", numbers.nullable_numbers(F.col("t")).alias("n")).orderBy("k")
    assert [r.n for r in found.collect()] == [want, [], None]
    each = df.select("k", F.posexplode("t")).select("pos", numbers.nullable_number("col").alias("n")).orderBy("pos")
    assert [r.n for r in each.collect()] == want


@pytest.mark.parametrize("x, expected", [(1.0, "1"), (1.5, "1.5"), (-3.0, "-3"), (0.0, "0")])
def test_number_text(one, x, expected):
    assert one(numbers.number_text, x, "double") == expected


@pytest.mark.parametrize(
    "x, expected",
    [
        ("ＦＣ東京", "FC東京"),
        ("横浜Ｆ・マリノス", "横浜F・マリノス"),
        ("京都サンガＦ.Ｃ.", "京都サンガF.C."),
        ("Ｖ・ファーレン長崎", "V・ファーレン長崎"),
        (" 鹿島　アントラーズ ﻿", "鹿島アントラーズ"),
    ],
)
def test_name_key(one, x, expected):
    assert one(text.name_key, x) == expected


def test_name_key_aliases_win(one):
    assert one(lambda c: text.name_key(c, {"ＦＣ東京": "東京"}), " ＦＣ東京") == "東京"


@pytest.mark.parametrize(
    "x, expected", [("鹿島鹿島", "鹿島"), ("abc", "abc"), (" abab ", "ab"), ("", ""), ("aab", "aab")]
)
def test_undouble(one, x, expected):
    assert one(text.undouble, x) == expected


def test_slug(one):
    assert one(text.slug, "　FC 横浜F・マリノス ") == "fc-横浜f-マリノス"


def test_spaces_are_unicode_spaces(one):
    padded = "　 a b﻿"
    assert one(text.strip_ws, padded) == "a b"
    assert one(text.squeeze_ws, "　 a   　 b \n") == "a b"
    assert one(text.squeeze_ws, "\u0085a") == "\u0085a"  # no space
    assert one(text.remove_ws, "a 　 b") == "ab"


def test_utf16_length(one):
    assert one(text.utf16_length, "a😀") == 3


def test_integers_and_prefix(one):
    assert one(text.integers_in, "a-3 b12c 5-4") == [-3, 12, 5, -4]
    assert one(lambda c: text.prefix(c, 2), "abc") == "ab"


def test_defaults(one):
    assert one(lambda c: text.null_to(c, "d"), "") == ""
    assert one(lambda c: text.null_to(c, "d"), None) == "d"
    assert one(lambda c: text.empty_or_null_to(c, "d"), "") == "d"
    assert one(text.empty_to_null, "") is None


def test_labels(one):
    assert one(labels.outcome_label, "AWAY") == "アウェイ勝ち"
    assert one(labels.pick_label, "HOME") == "HOME WIN"
    assert [one(labels.outcome_from_any, x) for x in ("1", "draw", "AWAY", "x")] == [
        "HOME", "DRAW", "AWAY", None,
    ]
    assert [one(labels.signed, x, "int") for x in (0, -2, 3)] == ["+0", "-2", "+3"]
    assert one(labels.dash_if_null, None, "int") == "-"
