"""Registered queries over landed pages: health, texts, links, schedules, keyword contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kickpool.functions import fixed_values as fv
from kickpool.operators import dictionaries, html_tables, lookup, pages as page_ops, ranking
from kickpool.plans import season_views as views
from kickpool.plans.oracle_parts import squeezed, stripped, with_parts
from kickpool.plans.registry import query
from kickpool.plans.rendered_pages import block_of, schedule_pages
from kickpool.sources.snapshots import read_page_table

CONTEXT_WORD = "the"
TERMS = ("the", "ou", "ción", "der", "Les", "elle", "第")
LINK_WORDS = (("en", "ou"), ("er", "/d"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_page_table(spark, f"{sf}/pages.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_page_table(spark, f"{sf}/documents.parquet")


def _utf16(x: str) -> str:
    astral = rf"length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"
    return f"CAST(length({x}) + {astral} AS BIGINT)"


_TITLE = (
    "CASE WHEN regexp_matches(html, '(?i)<title>[^\\n\\r]*?</title>') THEN "
    + stripped("regexp_extract(html, '(?i)<title>([^\\n\\r]*?)</title>', 1)")
    + f" ELSE '{fv.NO_TITLE}' END"
)

_SOURCE_KEYS = list(fv.SOURCE_URLS)


@query(
    "page_health",
    f"""SELECT page_id, source_key, source_url,
  CASE WHEN ok THEN {_TITLE} ELSE '{fv.FETCH_FAILED}' END AS title,
  CASE WHEN ok THEN {_utf16("html")} ELSE 0 END AS text_length, ok,
  CASE WHEN NOT ok THEN 'status ' || CAST(page_id AS VARCHAR) END AS error_message
FROM (SELECT *, page_id % 10 <> 0 AS ok, CASE page_id % 5 {" ".join(
        f"WHEN {i} THEN '{key}'" for i, key in enumerate(_SOURCE_KEYS))} END AS source_key,
      CASE page_id % 5 {" ".join(
        f"WHEN {i} THEN '{url}'" for i, url in enumerate(fv.SOURCE_URLS.values()))} END
      AS source_url FROM pages WHERE page_id % 5 < 4)""",
)
def page_health(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth page failed to load; every fifth has a key that is not registered."""
    keys = F.array(*(F.lit(k) for k in (*_SOURCE_KEYS, "unregistered")))
    failed = F.col("page_id") % 10 == 0
    landed = pages(spark, sf).select(
        "page_id",
        F.get(keys, (F.col("page_id") % 5).cast("int")).alias("source_key"),
        F.when(~failed, F.col("html")).alias("html"),
        F.when(failed, F.concat(F.lit("status "), F.col("page_id").cast("string"))).alias("error"),
    )
    health = page_ops.page_health(lookup.with_source_url(landed), "error", clock=False)
    return health.withColumnRenamed("url", "source_url").drop("error")


@query(
    "page_title_length",
    f"SELECT page_id, {_TITLE} AS title, {_utf16('html')} AS text_length FROM pages",
)
def page_title_length(spark: SparkSession, sf: str) -> DataFrame:
    parsed = page_ops.page_health(pages(spark, sf), clock=False)
    return parsed.select("page_id", "title", "text_length")


def _plain(script: str, style: str, any_case: bool, amp: bool) -> str:
    flag = "gi" if any_case else "g"
    x = f"regexp_replace(html, '<script[\\s\\S]*?</script>', '{script}', '{flag}')"
    x = f"regexp_replace({x}, '<style[\\s\\S]*?</style>', '{style}', '{flag}')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"replace({x}, '&nbsp;', ' ')"
    return squeezed(f"replace({x}, '&amp;', '&')" if amp else x)


PLAIN_MAIN = _plain("", "", True, True)


@query("page_text", f"SELECT page_id, {PLAIN_MAIN} AS text FROM pages")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", page_ops.plain_text("html").alias("text"))


@query("page_text_b", f"SELECT page_id, {_plain('', ' ', True, True)} AS text FROM pages")
def page_text_b(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", page_ops.plain_text("html", "standings").alias("text"))


@query(
    "page_text_c",
    f"SELECT page_id, substring({_plain(' ', ' ', False, False)}, 1, 4000) AS text FROM pages",
)
def page_text_c(spark: SparkSession, sf: str) -> DataFrame:
    """The vote page text; its length limit is part of the report."""
    return pages(spark, sf).select("page_id", page_ops.vote_page_text("html").alias("text"))


# Text of the parsed page, said in SQL for the markup these pages contain: the script text
# holds an end tag that is no tag, comments vanish, and a few entities are decoded. An
# ampersand needs no semicolon, and is set aside before tags go so that no new one arises.
_DOM = "regexp_replace(html, '&amp;?', chr(1), 'g')"
_DOM = f"regexp_replace({_DOM}, '<!--[\\s\\S]*?-->', '', 'g')"
_DOM = f"replace({_DOM}, 'var t=\"</p>\"', 'var t=\"{{{{/p}}}}\"')"
_DOM = f"regexp_replace({_DOM}, '<[^>]+>', '', 'g')"
_DOM = f"replace(replace({_DOM}, '{{{{', '<'), '}}}}', '>')"
for _name, _char in (
    ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "''"),
):
    _DOM = f"replace({_DOM}, '{_name}', '{_char}')"
_DOM = f"replace({_DOM}, chr(1), '&')"
DOM_TEXT = squeezed(_DOM)


@query("page_dom_text", f"SELECT page_id, {DOM_TEXT} AS text FROM pages")
def page_dom_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables.dom_text(pages(spark, sf), "page_id")


_LINK = "<a href=\"([^\"]*)\">([^<]*)</a>"
_LINK_ROWS = f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS link_idx,
  {squeezed(f"regexp_extract(hits[i], '{_LINK}', 2)")} AS text,
  regexp_extract(hits[i], '{_LINK}', 1) AS href
FROM (SELECT page_id, hits, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT page_id, regexp_extract_all(html, '{_LINK}', 0) AS hits FROM pages))"""


@query("page_links", _LINK_ROWS)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables.links(pages(spark, sf), "page_id")


@query(
    "followed_links",
    f"SELECT * FROM ({_LINK_ROWS}) WHERE "
    + " OR ".join(
        f"contains({c}, '{w}')" for c, words in zip(("text", "href"), LINK_WORDS) for w in words
    ),
)
def followed_links(spark: SparkSession, sf: str) -> DataFrame:
    return html_tables.followed_links(page_links(spark, sf), *LINK_WORDS)


# ------------------------------------------------------------------------------- schedules

_SCHEDULE = """SELECT page_no, pos, '第' || strftime(m, '%Y%m') || '回' AS round,
  strftime(m, '%Y/') || CAST(month(m) AS VARCHAR) || '/1' AS sales_start,
  strftime(m, '%Y/') || CAST(month(m) AS VARCHAR) || '/' || CAST(day(last_day(m)) AS VARCHAR)
    AS sales_end,
  CASE month(m) % 4 WHEN 1 THEN 'closed' WHEN 2 THEN 'open' ELSE 'unknown' END AS status
FROM (SELECT page_no, m, row_number() OVER (PARTITION BY page_no ORDER BY m) - 1 AS pos
      FROM (SELECT DISTINCT o_orderkey // 100 AS page_no, date_trunc('month', o_orderdate) AS m
            FROM orders))"""
_LATEST = f"""SELECT page_no, round, sales_start, sales_end, status
FROM (SELECT *, row_number() OVER (PARTITION BY page_no
        ORDER BY CASE WHEN status = 'open' THEN 0 ELSE 1 END, pos) AS n FROM ({_SCHEDULE}))
WHERE n = 1"""


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    return schedule_pages(views.table(spark, sf, "orders"))


@query("schedule_rounds", _SCHEDULE)
def schedule_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return page_ops.schedule_rounds(schedules(spark, sf), "page_no")


@query("latest_round", _LATEST)
def latest_round(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen inside each page's own schedule."""
    return page_ops.latest_rounds(schedules(spark, sf), "page_no")


@query("latest_round_of_relation", _LATEST)
def latest_round_of_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen from a relation of rounds that is already flat."""
    return ranking.latest_round(schedule_rounds(spark, sf), "page_no").drop("pos")


@query("rounds_first_20", f"SELECT * FROM ({_SCHEDULE}) WHERE pos < 20")
def rounds_first_20(spark: SparkSession, sf: str) -> DataFrame:
    return page_ops.first_rounds(schedule_rounds(spark, sf))


_ROUND_SNAPSHOTS = (
    "SELECT round_number, CAST(block AS VARCHAR) AS block, round_number || '-' || block AS "
    "snapshot_id FROM (SELECT substr(round, 2, 6) AS round_number, max(match_no // 1000) AS block "
    "FROM games GROUP BY 1)"
)


@query(
    "round_page_join",
    with_parts(
        "games",
        f"SELECT l.page_no, l.round, s.round_number, s.snapshot_id FROM ({_LATEST}) l "
        f"JOIN ({_ROUND_SNAPSHOTS}) s ON l.round = '第' || s.round_number || '回'",
    ),
)
def round_page_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each schedule page's latest round with the newest detail page of that round."""
    landed = views.games(spark, sf).select(
        F.substring("round", 2, 6).alias("round_number"), block_of("match_no", 1000).alias("block")
    )
    newest = landed.groupBy("round_number").agg(F.max("block").alias("block"))
    snapshots = newest.select(
        "round_number", F.concat_ws("-", "round_number", "block").alias("snapshot_id")
    )
    joined = lookup.round_pages(latest_round(spark, sf), snapshots)
    return joined.select("page_no", "round", "round_number", "snapshot_id")


@query(
    "page_snapshots_latest",
    "SELECT source_key, page_id, url, CAST(length(html) AS BIGINT) AS html_length FROM "
    "(SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY landed_at DESC NULLS LAST, "
    "page_id DESC) AS n FROM (SELECT *, regexp_extract(url, '://([^/]+)', 1) AS source_key, "
    "CASE WHEN page_id % 7 <> 0 THEN page_id // 3 END AS landed_at FROM pages)) WHERE n = 1",
)
def page_snapshots_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last landed page of every host; some times are missing, and three pages share one."""
    landed = pages(spark, sf).withColumns(
        {
            "source_key": F.regexp_extract("url", "://([^/]+)", 1),
            "landed_at": F.when(F.col("page_id") % 7 != 0, F.floor(F.col("page_id") / 3)),
        }
    )
    latest = lookup.latest_snapshots(landed, ["source_key"], ["landed_at"], "page_id")
    return latest.select(
        "source_key", "page_id", "url", F.length("html").cast("bigint").alias("html_length")
    )


# -------------------------------------------------------------------------------- keywords

_PLAIN_PAGES = f"SELECT page_id, {PLAIN_MAIN} AS text FROM pages"


@query(
    "keyword_context",
    f"""SELECT page_id, CAST(hit AS BIGINT) AS hit_no, CAST(p AS BIGINT) AS position,
  substring(text, greatest(p - 80, 0) + 1, p + 180 - greatest(p - 80, 0)) AS context
FROM (SELECT page_id, text, hit, CAST(list_sum(list_transform(parts[1:hit], lambda x: length(x)))
        + (hit - 1) * {len(CONTEXT_WORD)} AS BIGINT) AS p
      FROM (SELECT page_id, text, parts, unnest(range(1, least(len(parts) - 1, 20) + 1)) AS hit
            FROM (SELECT page_id, text, string_split(text, '{CONTEXT_WORD}') AS parts
                  FROM ({_PLAIN_PAGES}))))""",
)
def keyword_context(spark: SparkSession, sf: str) -> DataFrame:
    return page_ops.keyword_contexts(page_text(spark, sf), CONTEXT_WORD, "page_id")


_TERM_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))


@query(
    "keyword_first_hit",
    f"""SELECT page_id, CAST(term_no AS BIGINT) AS term_no, term, p > 0 AS found,
  CASE WHEN p > 0 THEN substring(text, greatest(p - 151, 0) + 1, p + 399 - greatest(p - 151, 0))
  END AS context
FROM (SELECT page_id, text, term_no, term, instr(text, term) AS p
      FROM (SELECT page_id, {DOM_TEXT} AS text FROM pages),
           (VALUES {_TERM_ROWS}) t(term_no, term))""",
)
def keyword_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    texts = html_tables.dom_text(pages(spark, sf), "page_id")
    return page_ops.keyword_first_hits(texts, TERMS, "page_id")


@query(
    "dictionary_extract",
    f"""SELECT doc_id, CAST(term_no AS BIGINT) AS term_no, term,
  substring(text, greatest(p - 101, 0) + 1, p - 1 - greatest(p - 101, 0)) AS before,
  substring(text, p, 220) AS after,
  list_aggregate(list_transform(regexp_extract_all(substring(text, p, 220), '-?[0-9]+'),
    lambda n: CAST(TRY_CAST(n AS BIGINT) AS VARCHAR)), 'string_agg', ', ') AS numbers
FROM (SELECT doc_id, text, term_no, term, instr(text, term) AS p
      FROM documents, (VALUES {_TERM_ROWS}) t(term_no, term)) WHERE p > 0""",
)
def dictionary_extract(spark: SparkSession, sf: str) -> DataFrame:
    hits = page_ops.dictionary_extract(documents(spark, sf), TERMS, "doc_id")
    numbers = F.array_join(F.col("numbers"), ", ")
    return hits.withColumn("numbers", F.when(F.size("numbers") > 0, numbers))


@query(
    "dictionary_table_extract",
    """WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS words FROM benchmark),
terms AS (
  SELECT DISTINCT term FROM (
    SELECT unnest(words) AS term FROM w
    UNION ALL SELECT unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w)
  WHERE term <> '')
SELECT doc_id, term, CAST(p - 1 AS BIGINT) AS position,
  substring(text, greatest(p - 101, 0) + 1, p - 1 - greatest(p - 101, 0)) AS before, substring(text, p, 220) AS after,
  list_aggregate(list_transform(regexp_extract_all(substring(text, p, 220), '-?[0-9]+'),
    lambda n: CAST(TRY_CAST(n AS BIGINT) AS VARCHAR)), 'string_agg', ', ') AS numbers
FROM (SELECT doc_id, text, term, instr(text, term) AS p FROM documents, terms) WHERE p > 0""",
)
def dictionary_table_extract(spark: SparkSession, sf: str) -> DataFrame:
    """All documents searched for all words and pairs of words of the benchmark's items."""
    words = F.split(F.lower("text"), " ", -1)
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda a, i: F.concat_ws(" ", a, F.get("w", i + 1)))
    listed = views.table(spark, sf, "benchmark").where("text IS NOT NULL").select(words.alias("w"))
    terms = listed.select(F.explode(F.concat("w", pairs)).alias("term"))
    hits = dictionaries.table_extract(documents(spark, sf), terms, "doc_id")
    numbers = F.array_join(F.col("numbers"), ", ")
    return hits.withColumn("numbers", F.when(F.size("numbers") > 0, numbers))
