"""Text Column helpers: Unicode-aware whitespace, name keys, slugs, contexts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from kickpool.functions import fixed_values as fv

# Whitespace as web text knows it. Java's \s stops at ASCII, so the characters are spelled
# out, once as a pattern class and once as plain text; U+0085 is no member.
WS_CHARS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{WS_CHARS}]"
NON_BLANK_WS = f"[{WS_CHARS}&&[^ ]]"
SPACE_CODES = (9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B))
SPACE_CODES += (0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
SPACES = "".join(map(chr, SPACE_CODES))


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x: Column | str) -> Column:
    """Trim every Unicode space at both ends."""
    return F.btrim(as_column(x), F.lit(SPACES))


def remove_ws(x: Column | str) -> Column:
    """Drop every whitespace character."""
    return F.translate(as_column(x), SPACES, "")


def collapse_ws(x: Column | str) -> Column:
    """Turn each whitespace run into one blank.

    A lone blank is already what it should be, so the pattern skips it and only touches
    runs and other spaces.
    """
    return F.regexp_replace(as_column(x), f" {WS}+|{NON_BLANK_WS}{WS}*", " ")


def squeeze_ws(x: Column | str) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(collapse_ws(x))


def name_key(x: Column | str, aliases: Mapping[str, str] | None = None) -> Column:
    """Canonical team name: no whitespace, four full-width characters made half-width.

    ``aliases`` maps whole whitespace-free names and wins over the character rule.
    """
    # Characters without a counterpart are dropped, so one pass does both.
    key = F.translate(as_column(x), fv.FULL_WIDTH + SPACES, fv.HALF_WIDTH)
    for written, canonical in (aliases or {}).items():
        key = F.when(remove_ws(x) == written, F.lit(canonical)).otherwise(key)
    return key


def same_team(a: Column | str, b: Column | str) -> Column:
    """Whether two spellings name one team. For joins, equate precomputed keys instead."""
    return name_key(a) == name_key(b)


def undouble(x: Column | str) -> Column:
    """Trimmed text that is one half written twice becomes that half."""
    t = strip_ws(x)
    half = (F.length(t) / 2).cast("int")
    doubled = (F.length(t) % 2 == 0) & (F.left(t, half) == F.right(t, half))
    return F.when(doubled, F.left(t, half)).otherwise(t)


def slug(x: Column | str) -> Column:
    """Lower-case id with hyphens for whitespace runs and middle dots."""
    hyphened = F.regexp_replace(F.lower(strip_ws(x)), f"{WS}+", "-")
    return F.translate(hyphened, fv.MIDDLE_DOT, "-")


def utf16_length(x: Column | str) -> Column:
    """Length in UTF-16 units (``length`` counts code points), as BIGINT."""
    octets = F.length(F.encode(as_column(x), "UTF-16BE"))
    return F.shiftright(octets, 1).cast("bigint")


def prefix(x: Column | str, n: int) -> Column:
    return F.substring(as_column(x), 1, n)


def clip(text: Column, at: Column, before: int, after: int) -> Column:
    """Text from ``before`` characters ahead of the 0-based position to ``after`` past it."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at + after - start)


def integers_in(x: Column | str) -> Column:
    """Every signed integer of a text, in order, as ARRAY<BIGINT>."""
    found = F.regexp_extract_all(as_column(x), F.lit("(-?[0-9]+)"), F.lit(1))
    return F.transform(found, lambda n: n.try_cast("bigint"))


def empty_to_null(x: Column | str) -> Column:
    return F.nullif(as_column(x), F.lit(""))


def empty_or_null_to(x: Column | str, default: str) -> Column:
    """Default for NULL *and* empty text."""
    return F.coalesce(empty_to_null(x), F.lit(default))


def null_to(x: Column | str, default: str) -> Column:
    """Default for NULL only; empty text is kept."""
    return F.coalesce(as_column(x), F.lit(default))


def contains_any(x: Column | str, needles: tuple[str, ...]) -> Column:
    """True when the text holds one of the needles; NULL text gives False."""
    x = as_column(x)
    hit = F.lit(False)
    for needle in needles:
        hit = hit | x.contains(needle)
    return F.coalesce(hit, F.lit(False))


def round_digits(x: Column | str) -> Column:
    """ASCII digits of a round label."""
    return F.regexp_replace(as_column(x), "[^0-9]", "")


def round_label(digits: Column) -> Column:
    return F.concat(F.lit(fv.ROUND_PREFIX), digits, F.lit(fv.ROUND_SUFFIX))
