"""Enum-to-text mappings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from kickpool.functions import fixed_values as fv
from kickpool.functions.text import as_column


def decode(x: Column | str, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Small fixed mapping as a CASE expression, evaluated inside codegen."""
    x = as_column(x)
    (first, value), *rest = table.items()
    out = F.when(x == first, F.lit(value))
    for key, value in rest:
        out = out.when(x == key, F.lit(value))
    return out if default is None else out.otherwise(default)


def outcome_label(x: Column | str) -> Column:
    return decode(x, fv.OUTCOME_LABEL)


def pick_label(x: Column | str) -> Column:
    return decode(x, fv.PICK_LABEL)


def outcome_key(x: Column | str) -> Column:
    """HOME / DRAW / AWAY to home / draw / away."""
    return decode(x, fv.OUTCOME_KEY)


def outcome_mark(x: Column | str) -> Column:
    """HOME / DRAW / AWAY to the coupon marks 1 / 0 / 2."""
    return decode(x, fv.OUTCOME_MARK)


def outcome_from_any(x: Column | str) -> Column:
    """Any of the three vocabularies back to HOME / DRAW / AWAY; anything else is NULL."""
    spellings = {pick: pick for pick in fv.PICKS}
    spellings |= {key: pick for pick, key in fv.OUTCOME_KEY.items()}
    spellings |= {mark: pick for pick, mark in fv.OUTCOME_MARK.items()}
    return decode(x, spellings)


def signed(x: Column | str) -> Column:
    """Whole number as text with a plus sign when it is not negative."""
    x = as_column(x)
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), x.cast("string"))


def dash_if_null(x: Column | str) -> Column:
    return F.coalesce(as_column(x).cast("string"), F.lit("-"))
