"""HTML tables, links and texts as relations, and the extractors built on them.

The reader is the one place where Python runs: ``mapInArrow`` hands it batches of
(keys, html) and takes back one record per table row with its cells as an array. A row
never has to be put together again from cells, so the extractors need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, chain, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kickpool.functions import fixed_values as fv
from kickpool.functions.numbers import noisy_int, number_or
from kickpool.functions.text import contains_any, empty_to_null, name_key, prefix, remove_ws
from kickpool.operators import markup

RECORDS_PER_BATCH = 2000

CELLS = "array<struct<text:string,anchor_text:string,span_text:string,html:string>>"
ROW_FIELDS = (
    f"table_idx int, row_idx int, page_row_idx int, innermost boolean, row_text string, cells {CELLS}"
)
TABLE_FIELDS = "table_idx int, row_count int, text string"
LINK_FIELDS = "link_idx int, text string, href string"


def arrow_column(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Column of plain values, or of lists of tuples built from their flattened fields."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
    fields = list(kind.value_type)
    columns = list(zip(*chain.from_iterable(values))) or [()] * len(fields)
    flat = [pa.array(column, field.type) for column, field in zip(columns, fields)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, fields=fields))


def read_markup(
    pages: DataFrame, keys: tuple[str, ...], fields: str, reader: Callable[[str], Iterator[tuple]]
) -> DataFrame:
    """Run a page reader over (keys, html); its records come back behind the page's keys."""
    source = pages.select(*keys, "html").where(F.col("html").isNotNull())
    key_fields = [source.schema[k] for k in keys]
    schema = T.StructType(key_fields + T.StructType.fromDDL(fields).fields)
    kinds = to_arrow_schema(schema)

    def packed(records: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*records), kinds)
        return pa.RecordBatch.from_arrays(
            [arrow_column(values, field.type) for values, field in columns], schema=kinds
        )

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            records: list[tuple] = []
            page_keys = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else repeat(())
            for key, html in zip(page_keys, batch.column("html")):
                for record in reader(html.as_py()):
                    records.append(key + record)
                    if len(records) == RECORDS_PER_BATCH:
                        yield packed(records)
                        records = []
            if records:
                yield packed(records)

    return source.mapInArrow(batches, schema)


def at_least_tables(pages: DataFrame, n: int) -> DataFrame:
    """Pages that can hold n tables, told by their tags alone before any parsing."""
    return pages.where(F.regexp_count("html", F.lit("(?i)<table")) >= n)


def table_rows(
    pages: DataFrame,
    *keys: str,
    cell_html: int = 0,
    row_text: bool = False,
    min_tables: int = 1,
) -> DataFrame:
    """One record per table row, its cells in an array. Row text and cell markup on request."""
    return read_markup(
        at_least_tables(pages, min_tables),
        keys,
        ROW_FIELDS,
        lambda html: markup.page_table_rows(html, cell_html, row_text),
    )


def table_cells(pages: DataFrame, *keys: str, cell_html: int = 0) -> DataFrame:
    """One record per cell with its table, row and cell ordinals."""
    rows = table_rows(pages, *keys, cell_html=cell_html)
    ordinals = ("table_idx", "row_idx", "page_row_idx", "innermost")
    cells = rows.select(*keys, *ordinals, F.posexplode("cells").alias("cell_idx", "c"))
    return cells.select(*keys, *ordinals, "cell_idx", "c.*")


def dom_text(pages: DataFrame, *keys: str) -> DataFrame:
    """Text of the parsed page: entities decoded, nothing put in place of tags."""
    return read_markup(pages, keys, "text string", markup.page_text)


def links(pages: DataFrame, *keys: str) -> DataFrame:
    """Every link with its ordinal, collapsed text and target."""
    candidates = pages.where(F.col("html").rlike("(?i)<a[\\s/>]"))
    return read_markup(candidates, keys, LINK_FIELDS, markup.page_links)


def followed_links(
    found: DataFrame,
    text_words: tuple[str, ...] = fv.LINK_TEXT_KEYWORDS,
    href_words: tuple[str, ...] = fv.LINK_HREF_KEYWORDS,
) -> DataFrame:
    """Links whose text or target holds one of the keywords."""
    return found.where(contains_any("text", text_words) | contains_any("href", href_words))


def table_previews(pages: DataFrame, *keys: str, n: int = 300) -> DataFrame:
    """Row count, text length and text prefix of every table."""
    tables = read_markup(at_least_tables(pages, 1), keys, TABLE_FIELDS, markup.page_tables)
    return tables.select(
        *keys,
        "table_idx",
        F.col("row_count").cast("bigint").alias("row_count"),
        F.length("text").cast("bigint").alias("text_length"),
        prefix("text", n).alias("preview"),
    )


def rows_with_keyword(pages: DataFrame, keyword: str, *keys: str, cell_html: int = 500) -> DataFrame:
    """Cells (text and markup prefix) of every page row whose text holds the keyword."""
    hits = read_markup(
        at_least_tables(pages, 1),
        keys,
        "page_row_idx int, row_text string, cells array<struct<text:string,html:string>>",
        lambda html: markup.rows_with_word(html, keyword, cell_html),
    )
    cells = hits.select(
        *keys, "page_row_idx", "row_text", F.posexplode("cells").alias("cell_idx", "c")
    )
    return cells.select(*keys, "page_row_idx", "row_text", "cell_idx", "c.text", "c.html")


# ---------------------------------------------------------------- fixtures and standings

FIXTURE_TABLE = 2
MIN_FIXTURE_CELLS = 6
MIN_STANDING_CELLS = 12
STANDING_CELLS = (1, 2, 3, 11)  # rank, team, points, goal difference


def extract_results(pages: DataFrame, *keys: str) -> DataFrame:
    """Fixture rows with result columns, as they stand on the page (no number check).

    The reader gives the non-empty texts of a row, so an empty cell moves later cells forward.
    """
    filled = read_markup(
        at_least_tables(pages, FIXTURE_TABLE + 1),
        keys,
        "row_idx int, t array<string>",
        lambda html: markup.body_row_texts(html, FIXTURE_TABLE),
    )
    names = ("date", "venue", "match_no", "home_team", "result", "away_team", "pool_result")
    return filled.where(F.size("t") >= MIN_FIXTURE_CELLS).select(
        *keys, "row_idx", *(F.get("t", F.lit(i)).alias(name) for i, name in enumerate(names))
    )


def extract_fixtures(pages: DataFrame, *keys: str) -> DataFrame:
    """Valid fixtures: number that is not zero, both names present, names without spaces."""
    fixtures = extract_results(pages, *keys).select(
        *keys,
        "row_idx",
        number_or("match_no").alias("match_no"),
        remove_ws("home_team").alias("home_team"),
        remove_ws("away_team").alias("away_team"),
        F.col("date").alias("kickoff"),
        "venue",
    )
    named = (F.col("home_team") != "") & (F.col("away_team") != "")
    return fixtures.where((F.col("match_no") != 0) & named)


def extract_standings(pages: DataFrame, *keys: str) -> DataFrame:
    """Standings from all tables but the first, in page order."""
    body = read_markup(
        at_least_tables(pages, 2),
        keys,
        "table_idx int, row_idx int, texts array<string>, anchor_text string, span_text string",
        lambda html: markup.wide_body_rows(html, 1, MIN_STANDING_CELLS, STANDING_CELLS, 2),
    )
    rank, team, points, goals = (F.get("texts", F.lit(i)) for i in range(len(STANDING_CELLS)))
    team = F.coalesce(empty_to_null("span_text"), empty_to_null("anchor_text"), team)
    standings = body.select(
        *keys,
        "table_idx",
        "row_idx",
        noisy_int(rank).alias("rank"),
        name_key(team).alias("team_name"),
        noisy_int(points).alias("points"),
        noisy_int(goals).alias("goal_difference"),
    )
    return standings.where((F.col("rank") != 0) & (F.col("team_name") != ""))


def sort_standings(standings: DataFrame, *keys: str) -> DataFrame:
    """By rank, page order on ties, within each page; pages lie together but in no order.

    Without keys all rows are of one page and are put in order as a whole.
    """
    order = (*keys, "rank", "table_idx", "row_idx")
    return standings.repartition(*keys).sortWithinPartitions(*order) if keys else standings.orderBy(*order)
