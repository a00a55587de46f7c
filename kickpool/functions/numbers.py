"""Numeric Column helpers with the rounding, clamping and parsing rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kickpool.functions.text import WS, as_column

# A decimal number in optional whitespace; the number is the group.
NUMERIC_TEXT = rf"^{WS}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?){WS}*\z"
BLANK_TEXT = rf"^{WS}+\z"


def half_up(x: Column | str) -> Column:
    """Round to an integer, ties toward positive infinity (-2.5 gives -2), as BIGINT.

    Cutting to half steps first is exact for every double, unlike adding 0.5, and names the
    argument once, so nested roundings do not multiply the expression.
    """
    return F.ceil(F.floor(as_column(x).cast("double") * 2) / F.lit(2.0))


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    """Bound x to [lo, hi]; NULL and NaN stay what they are instead of becoming a bound."""
    x = as_column(x).cast("double")
    bounded = F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    return F.when(x.isNotNull() & ~F.isnan(x), bounded).otherwise(x)


def nullable_number(text: Column | str) -> Column:
    """Numeric text as DOUBLE; missing, empty, unreadable or infinite gives NULL, blanks 0.

    Only what the pattern found is cast: casting any other text makes and drops an exception,
    which costs far more than the pattern.
    """
    text = as_column(text)
    value = F.nullif(F.regexp_extract(text, NUMERIC_TEXT, 1), F.lit("")).try_cast("double")
    finite = F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))
    return F.coalesce(finite, F.when(text.rlike(BLANK_TEXT), F.lit(0.0)))


def nullable_numbers(texts: Column) -> Column:
    """``nullable_number`` of every text of an array, as ARRAY<DOUBLE>.

    Many number columns spelled out make a method that the JVM does not compile (more than 8,000
    bytes); one loop over an array stays small.
    """
    found = F.transform(texts, lambda t: F.regexp_extract(t, NUMERIC_TEXT, 1))
    values = F.transform(found, lambda t: F.when(t != "", t.try_cast("double")))

    def number(t: Column, value: Column) -> Column:
        finite = F.when(F.abs(value) < F.lit(float("inf")), value)
        return F.coalesce(finite, F.when(t.rlike(BLANK_TEXT), F.lit(0.0)))

    return F.zip_with(texts, values, number)


def number_or(text: Column | str, fallback: float = 0.0) -> Column:
    """Numeric text as DOUBLE; missing, empty or unreadable text gives the fallback."""
    return F.coalesce(nullable_number(text), F.lit(float(fallback)))


def noisy_int(text: Column | str) -> Column:
    """Keep ASCII digits and minus signs, read the rest as BIGINT, 0 when that fails."""
    kept = F.regexp_replace(as_column(text), "[^0-9-]", "")
    return F.coalesce(kept.try_cast("bigint"), F.lit(0).cast("bigint"))


def number_text(x: Column | str) -> Column:
    """Text of a number with no trailing ``.0`` on whole values."""
    x = as_column(x)
    whole = x == F.floor(x)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))
