"""Operators over a table of landed pages that stay entirely in the JVM.

Input rows carry at least an ``html`` column (NULL where the fetch failed). Nothing here
shuffles: titles, texts, schedules and keyword contexts are computed page by page.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kickpool.functions import fixed_values as fv
from kickpool.functions.labels import decode
from kickpool.functions.text import (
    as_column,
    clip,
    integers_in,
    prefix,
    round_label,
    squeeze_ws,
    strip_ws,
    utf16_length,
)

TITLE = r"(?i)<title>[^\n\r\u2028\u2029]*?</title>"
TITLE_TAGS = len("<title></title>")


def page_title(html: Column | str) -> Column:
    """Trimmed text of the first one-line title element; a fixed text when there is none."""
    element = F.regexp_substr(as_column(html), F.lit(TITLE))
    inner = F.substring(element, F.lit(len("<title>") + 1), F.length(element) - TITLE_TAGS)
    return F.coalesce(strip_ws(inner), F.lit(fv.NO_TITLE))


def page_health(pages: DataFrame, message: str | None = None, clock: bool = True) -> DataFrame:
    """One row per page: title and length, or the failure row. Failures are data.

    ``message`` names the column holding the fetch error. ``clock`` adds the time stamp.
    """
    ok = F.col("html").isNotNull()
    error = F.coalesce(F.col(message) if message else F.lit(None), F.lit(fv.UNKNOWN_FETCH_ERROR))
    out = pages.withColumns(
        {
            "title": F.when(ok, page_title("html")).otherwise(fv.FETCH_FAILED),
            "text_length": F.when(ok, utf16_length("html")).otherwise(F.lit(0)),
            "ok": ok,
            "error_message": F.when(~ok, error),
        }
    )
    if clock:
        out = out.withColumn("fetched_at", F.current_timestamp())
    return out.drop("html")


# Fixed values, plain-text variants: what replaces script and style elements, whether markup names are
# matched in any case, whether &amp; is decoded.
PLAIN_TEXT = {
    "main": {"script": "", "style": "", "any_case": True, "amp": True},
    "standings": {"script": "", "style": " ", "any_case": True, "amp": True},
    "votes": {"script": " ", "style": " ", "any_case": False, "amp": False},
}
VOTE_TEXT_LENGTH = 4000


def plain_text(html: Column | str, variant: str = "main") -> Column:
    """Readable text of a page by pattern replacement, whitespace collapsed and trimmed."""
    rule = PLAIN_TEXT[variant]
    flag = "(?i)" if rule["any_case"] else ""
    text = as_column(html)
    for element in ("script", "style"):
        text = F.regexp_replace(text, rf"{flag}<{element}[\s\S]*?</{element}>", rule[element])
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    if rule["amp"]:
        text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    return squeeze_ws(text)


def vote_page_text(html: Column | str) -> Column:
    return prefix(plain_text(html, "votes"), VOTE_TEXT_LENGTH)


# ------------------------------------------------------------------------ round schedule

# How a schedule writes a day and a round.
DAY = r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
ROUND = rf"({'|'.join(fv.STATUS_CODE)})? *第([0-9]+)回 *（({DAY})-({DAY})）"


def schedule_array(text: Column | str) -> Column:
    """All rounds of a whitespace-collapsed schedule text in order, as an array of structs."""
    found = F.regexp_extract_all(as_column(text), F.lit(ROUND), F.lit(0))

    def parsed(hit: Column) -> Column:
        status, number, start, end = (F.regexp_extract(hit, ROUND, i) for i in range(1, 5))
        return F.struct(
            round_label(number).alias("round"),
            start.alias("sales_start"),
            end.alias("sales_end"),
            decode(status, fv.STATUS_CODE, F.lit("unknown")).alias("status"),
        )

    return F.transform(found, parsed)


def schedule_rounds(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """One row per round and page, ``pos`` is the 0-based place on the page."""
    rounds = pages.select(*keys, schedule_array(plain_text(html)).alias("rounds"))
    return rounds.select(*keys, F.posexplode("rounds").alias("pos", "r")).select(
        *keys, "pos", "r.*"
    )


def latest_of_page(rounds: Column) -> Column:
    """First open round of a schedule array, else its first round, as array of at most one."""
    open_rounds = F.filter(rounds, lambda r: r["status"] == "open")
    return F.slice(F.concat(open_rounds, rounds), 1, 1)


def latest_rounds(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """The current round of every schedule page; pages without rounds give no row.

    The choice is made inside the page's own array, so there is no window and no shuffle.
    """
    rounds = pages.select(*keys, schedule_array(plain_text(html)).alias("rounds"))
    return rounds.select(*keys, F.inline(latest_of_page(F.col("rounds"))))


def first_rounds(rounds: DataFrame, n: int = 20) -> DataFrame:
    """The first n rounds of each page (a report), by the page position they carry."""
    return rounds.where(F.col("pos") < n)


# --------------------------------------------------------------------- keywords in texts

MAX_CONTEXTS = 20


def keyword_contexts(
    texts: DataFrame,
    keyword: str,
    *keys: str,
    text: str = "text",
    before: int = 80,
    after: int = 180,
    hits: int = MAX_CONTEXTS,
) -> DataFrame:
    """The first hits of one keyword per text, non-overlapping, each with its surroundings.

    Splitting at the keyword gives the gaps between hits; running sums of the gap lengths
    give the positions. At most ``hits`` gaps exist, so the sums stay small.
    """
    width = len(keyword)
    gaps = F.split(F.col(text), re.escape(keyword), hits + 1)
    lengths = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: F.length(g))

    def position(_: Column, i: Column) -> Column:
        ahead = F.aggregate(F.slice("_len", 1, i + 1), F.lit(0), lambda a, n: a + n)
        return ahead + i * width

    located = texts.select(*keys, text, lengths.alias("_len")).select(
        *keys, text, F.posexplode(F.transform("_len", position)).alias("hit", "position")
    )
    return located.select(
        *keys,
        (F.col("hit") + 1).alias("hit_no"),
        "position",
        clip(F.col(text), F.col("position"), before, after).alias("context"),
    )


def term_positions(text: Column, terms: Sequence[str]) -> Column:
    """First 0-based position of every dictionary term, -1 when absent, as array of structs.

    The dictionary is a literal of the query, so there is no join at all.
    """
    return F.array(
        *(
            F.struct(
                F.lit(i).alias("term_no"),
                F.lit(term).alias("term"),
                (F.instr(text, F.lit(term)) - 1).alias("position"),
            )
            for i, term in enumerate(terms)
        )
    )


def keyword_first_hits(
    texts: DataFrame,
    terms: Sequence[str],
    *keys: str,
    text: str = "text",
    before: int = 150,
    after: int = 400,
) -> DataFrame:
    """Every text × term: first hit with surroundings, or found = false."""
    rows = texts.select(*keys, text, F.inline(term_positions(F.col(text), terms)))
    found = F.col("position") >= 0
    return rows.select(
        *keys,
        "term_no",
        "term",
        found.alias("found"),
        F.when(found, clip(F.col(text), F.col("position"), before, after)).alias("context"),
    )


def dictionary_extract(
    texts: DataFrame,
    terms: Sequence[str],
    *keys: str,
    text: str = "text",
    before: int = 100,
    after: int = 220,
) -> DataFrame:
    """Found terms with the text around them and the integers that follow."""
    hits = F.filter(term_positions(F.col(text), terms), lambda t: t["position"] >= 0)
    rows = texts.select(*keys, text, F.inline(hits))
    tail = F.substring(F.col(text), F.col("position") + 1, F.lit(after))
    rows = rows.withColumns({"before": clip(F.col(text), F.col("position"), before, 0), "after": tail})
    return rows.select(
        *keys,
        "term_no",
        "term",
        "before",
        "after",
        integers_in("after").alias("numbers"),
    )
