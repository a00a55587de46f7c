"""The end-to-end jobs: pages to best picks or reports, CSV to dashboard, CSV to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kickpool.operators import constraints, matches, pages, scoring
from kickpool.operators.html_tables import extract_fixtures, extract_standings, sort_standings
from kickpool.operators.lookup import (
    attach_standings,
    latest_snapshots,
    round_pages,
    with_source_url,
)
from kickpool.operators.ranking import best_by_probability, row_counts
from kickpool.operators.upsert import (
    MATCH_DEFAULTS,
    ROUND_DEFAULTS,
    conformed,
    remove_folder,
    upsert_table,
)
from kickpool.session import fresh_path, written
from kickpool.sources import schemas
from kickpool.sources.schemas import TABLE_RULES
from kickpool.sources.text_tables import read_plain_csv, read_quoted_csv


def predict_pages(
    detail_pages: DataFrame,
    standings_pages: DataFrame,
    scope: Sequence[str] = (),
    page_keys: Sequence[str] = ("round",),
    explain: bool = True,
) -> DataFrame:
    """Fixtures of all detail pages, looked up in the standings pages and scored by model B.

    ``scope`` names the columns both kinds of pages share, such as league or season.
    """
    fixtures = extract_fixtures(detail_pages, *scope, *page_keys)
    standings = extract_standings(standings_pages, *scope)
    inputs = attach_standings(
        fixtures, standings, scope, order=("rank", "table_idx", "row_idx", "team_name")
    )
    return scoring.predict_model_b(inputs, explain)


def best_picks(
    detail_pages: DataFrame,
    standings_pages: DataFrame,
    scope: Sequence[str] = (),
    page_order: Sequence[str] = (),
) -> DataFrame:
    """One pick per round; of equal ones the first on the page, pages in ``page_order``."""
    predictions = predict_pages(
        detail_pages, standings_pages, scope, ("round", *page_order), explain=False
    )
    return best_by_probability(predictions, ["round"], (*page_order, "row_idx"))


def current_round_picks(
    schedules: DataFrame,
    details: DataFrame,
    standings: DataFrame,
    scope: Sequence[str] = (),
    detail_page: Sequence[str] = (),
    standings_page: Sequence[str] = (),
) -> DataFrame:
    """The main job: landed pages to the best pick of the round that is on sale.

    Of every page the newest snapshot counts. The schedule names the current round, its digits
    lead to the round's detail pages (column round_number), their fixtures are looked up in the
    standings and scored by model B. Inputs have snapshot_id, landed_at, html and the scope's
    columns; ``detail_page`` and ``standings_page`` name a page where a round or a scope has
    several.
    """
    rounds = pages.latest_rounds(latest_snapshots(schedules, scope), *scope)
    identity = [*scope, "round_number", *detail_page]
    current = latest_snapshots(details, identity).select(*identity, "snapshot_id", "html")
    chosen = round_pages(rounds, current, scope)
    predictions = predict_pages(
        chosen,
        latest_snapshots(standings, [*scope, *standings_page]),
        scope,
        ("round", "sales_start", "sales_end", "status", *detail_page),
        explain=False,
    )
    return best_by_probability(predictions, [*scope, "round"], (*detail_page, "row_idx"))


def dashboard_from_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quoted CSV of raw matches through normalisation and model A to dashboard rows."""
    normalized = matches.normalize_matches(read_quoted_csv(spark, path))
    predicted = scoring.predict_model_a(matches.model_a_inputs(normalized), explain=False)
    return scoring.dashboard_rows(predicted, "round")


def inspect_pages(
    landed: DataFrame,
    schedule_key: str = "yahooSchedule",
    standings_key: str = "jleagueStandings",
) -> dict[str, DataFrame]:
    """Reports on landed pages (source_key, html): health, rounds, standings and row counts."""
    schedules = landed.where(F.col("source_key") == schedule_key)
    rounds = pages.schedule_rounds(schedules, "source_key")
    standings = extract_standings(landed.where(F.col("source_key") == standings_key), "source_key")
    counts = [
        row_counts(relation, "source_key").select("source_key", F.lit(name).alias("rows_of"), "row_count")
        for name, relation in (("rounds", rounds), ("standings", standings))
    ]
    return {
        "health": pages.page_health(with_source_url(landed)),
        "rounds": pages.first_rounds(rounds),
        "latest_round": pages.latest_rounds(schedules, "source_key"),
        "standings": sort_standings(standings, "source_key"),
        "counts": counts[0].unionByName(counts[1]),
    }


def import_matches_csv(
    spark: SparkSession, path: str | list[str], rounds_table: str, matches_table: str
) -> dict[str, dict[str, int]]:
    """Plain CSV into stored rounds, then matches. A file may hold any number of rounds.

    The file is parsed once, into typed rows in the shared folder, which are removed at the end.
    A row without a round, or one that breaks a rule of the table, refuses the import before
    anything is stored. Returns per table how many rows were inserted, updated, and left as they
    were; the writing jobs count them.
    """
    copy = fresh_path(spark, "import")
    try:
        rows = matches.import_projection(read_plain_csv(spark, path))
        rows = written(conformed(rows, T.StructType.fromDDL(schemas.MATCHES)), copy)
        refused = constraints.table_violations(rows, "matches").take(5)
        if refused:
            raise ValueError(f"import refused: {[r.asDict() for r in refused]}")
        rounds = upsert_table(
            rounds_table, matches.imported_rounds(rows), TABLE_RULES["rounds"].key, None, ROUND_DEFAULTS,
            schemas.ROUNDS, checked=True,
        )
        stored = upsert_table(
            matches_table, rows, TABLE_RULES["matches"].key, "round_no", MATCH_DEFAULTS, schemas.MATCHES,
            staged=True, checked=True,
        )
        return {"rounds": rounds, "matches": stored}
    finally:
        remove_folder(spark, copy)
