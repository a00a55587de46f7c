"""Registered queries over imported rows: CSV scans, normalisation, typed helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kickpool.functions import fixed_values as fv, numbers, text
from kickpool.operators import backtest, matches, scoring
from kickpool.operators.upsert import CHANGES, stored_table, upsert_table
from kickpool.plans import season_views as views
from kickpool.plans.oracle_parts import WS, number, stripped, with_parts
from kickpool.plans.jobs import dashboard_from_csv, import_matches_csv
from kickpool.plans.registry import query
from kickpool.session import fresh_path
from kickpool.sources import schemas
from kickpool.sources.tables import read_row_snapshot, write_row_snapshot
from kickpool.sources.text_tables import read_plain_csv, read_quoted_csv

# Number texts as files have them: missing, padded, unreadable, with exponent, fractional.
NOISE = {0: "", 1: " 12 ", 2: "abc", 3: "1e2", 4: "-0.5", 5: "1d", 6: "NaN"}


def noisy_number(key: Column) -> Column:
    """By the remainder of 8; the last one keeps the key. A lookup, as 17 columns of cases would
    make a method that the JVM does not compile."""
    noise = F.array(*(F.lit(NOISE[rest]) for rest in range(len(NOISE))))
    return F.coalesce(F.get(noise, (key % 8).cast("int")), key.cast("string"))


def noisy_number_sql(key: str) -> str:
    cases = " ".join(f"WHEN {rest} THEN '{noise}'" for rest, noise in NOISE.items())
    return f"CASE ({key}) % 8 {cases} ELSE CAST({key} AS VARCHAR) END"


def _team_sql(side: str) -> str:
    number9 = f"lpad(CAST({side}_key AS VARCHAR), 9, '0')"
    return (
        f"CASE WHEN {side}_key % 11 = 7 THEN '旧 Supplier#' ELSE 'Ｖ．ＦＣ　Supplier#' END "
        f"|| {number9}"
    )


# -------------------------------------------------------------------- the 18-column layout


def raw_match_texts(spark: SparkSession, sf: str) -> DataFrame:
    games = views.votes(views.games(spark, sf))
    whole = {
        "matchNo": F.col("match_no"),
        "homeRecentPoints": F.col("match_no") % 16,
        "homeGoalDiff": F.col("home_goals") * 7 - 5,
        "awayGoalDiff": F.col("away_goals") * 7 - 5,
        "homeWinRate": F.col("home_discount"),
        "awayWinRate": F.col("away_discount"),
        "voteHome": F.col("vote_home"),
        "voteDraw": F.col("vote_draw"),
        "voteAway": F.col("vote_away"),
        "awayRank": F.col("away_key") % 20 + 1,
    }
    texts = {name: F.coalesce(value.cast("string"), F.lit("")) for name, value in whole.items()}
    texts |= {
        "totoRound": F.col("round"),
        "kickoffAt": F.col("kickoff"),
        "venue": F.concat(F.lit("Stadium, "), F.col("home_key").cast("string")),
        "homeShortName": views.fixture_name("home_key"),
        "awayShortName": views.fixture_name("away_key"),
        "homeRank": noisy_number(F.col("match_no")),
        "awayRecentPoints": noisy_number(F.col("match_no") + 3),
        "weather": F.coalesce(F.col("weather"), F.lit("")),
    }
    return games.select(*(texts[c].alias(c) for c in fv.RAW_MATCH_COLUMNS))


_VOTE = "CASE WHEN match_no % 7 <> 0 THEN CAST({} AS VARCHAR) ELSE '' END"
_HOME_VOTE = "CAST(floor(30 + home_discount * 100 + 0.5) AS BIGINT)"
_AWAY_VOTE = "CAST(floor(30 + away_discount * 100 + 0.5) AS BIGINT)"
_RAW_SQL = {
    "totoRound": "round",
    "matchNo": "CAST(match_no AS VARCHAR)",
    "kickoffAt": "kickoff",
    "venue": "'Stadium, ' || CAST(home_key AS VARCHAR)",
    "homeShortName": _team_sql("home"),
    "awayShortName": _team_sql("away"),
    "homeRank": f"trim({noisy_number_sql('match_no')})",
    "awayRank": "CAST(away_key % 20 + 1 AS VARCHAR)",
    "homeRecentPoints": "CAST(match_no % 16 AS VARCHAR)",
    "awayRecentPoints": f"trim({noisy_number_sql('match_no + 3')})",
    "homeGoalDiff": "CAST(home_goals * 7 - 5 AS VARCHAR)",
    "awayGoalDiff": "CAST(away_goals * 7 - 5 AS VARCHAR)",
    "homeWinRate": "CAST(home_discount AS VARCHAR)",
    "awayWinRate": "CAST(away_discount AS VARCHAR)",
    "voteHome": _VOTE.format(_HOME_VOTE),
    "voteDraw": _VOTE.format(f"100 - {_HOME_VOTE} - {_AWAY_VOTE}"),
    "voteAway": _VOTE.format(_AWAY_VOTE),
    "weather": "coalesce(weather, '')",
}
_RAW_SELECT = "SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _RAW_SQL.items()) + " FROM games"


@query("csv_quoted", with_parts("games", _RAW_SELECT))
def csv_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """All games written as quoted CSV to the shared folder and scanned back."""
    path = fresh_path(spark, "csv-quoted")
    raw_match_texts(spark, sf).write.option("header", True).csv(path)
    return read_quoted_csv(spark, path)


_NORMAL_SQL = f"""
SELECT "totoRound" || '-' || "matchNo" AS id, "totoRound" AS round,
  CAST("matchNo" AS DOUBLE) AS match_no, "kickoffAt" AS kickoff, venue,
  regexp_replace(lower("homeShortName"), '{WS}+', '-', 'g') AS home_id,
  "homeShortName" AS home_name, 'J1' AS home_league,
  regexp_replace(lower("awayShortName"), '{WS}+', '-', 'g') AS away_team_id,
  coalesce({number('"homeRank"')}, 0) AS home_rank,
  coalesce({number('"awayRank"')}, 0) AS away_rank,
  coalesce({number('"homeGoalDiff"')}, 0) AS home_goal_difference,
  coalesce({number('"awayRecentPoints"')}, 0) AS away_form,
  CAST("homeWinRate" AS DOUBLE) AS home_home_rate, CAST(0 AS DOUBLE) AS home_away_rate,
  CAST(0 AS DOUBLE) AS away_home_rate, CAST("awayWinRate" AS DOUBLE) AS away_away_rate,
  CAST(0 AS DOUBLE) AS away_points, weather, CAST(25 AS DOUBLE) AS temperature,
  CAST(3 AS DOUBLE) AS wind_speed, coalesce({number('"voteHome"')}, 0) AS vote_home,
  coalesce({number('"voteDraw"')}, 0) AS vote_draw, coalesce({number('"voteAway"')}, 0) AS vote_away
FROM ({_RAW_SELECT})"""


def flat_match(normalized: DataFrame) -> DataFrame:
    return normalized.select(
        "id",
        "round",
        "match_no",
        "kickoff",
        "venue",
        F.col("home_team.id").alias("home_id"),
        F.col("home_team.name").alias("home_name"),
        F.col("home_team.league").alias("home_league"),
        F.col("away_stats.team_id").alias("away_team_id"),
        F.col("home_stats.rank").alias("home_rank"),
        F.col("away_stats.rank").alias("away_rank"),
        F.col("home_stats.goal_difference").alias("home_goal_difference"),
        F.col("away_stats.recent_form_points").alias("away_form"),
        F.col("home_stats.home_win_rate").alias("home_home_rate"),
        F.col("home_stats.away_win_rate").alias("home_away_rate"),
        F.col("away_stats.home_win_rate").alias("away_home_rate"),
        F.col("away_stats.away_win_rate").alias("away_away_rate"),
        F.col("away_stats.points").alias("away_points"),
        F.col("weather.condition").alias("weather"),
        F.col("weather.temperature").alias("temperature"),
        F.col("weather.wind_speed").alias("wind_speed"),
        F.col("votes.home").alias("vote_home"),
        F.col("votes.draw").alias("vote_draw"),
        F.col("votes.away").alias("vote_away"),
    )


@query("normalize_match", with_parts("games", _NORMAL_SQL))
def normalize_match(spark: SparkSession, sf: str) -> DataFrame:
    return flat_match(matches.normalize_matches(raw_match_texts(spark, sf)))


# Model A on the same rows: the parsed numbers take the place of the looked-up standings.
_CSV_INPUTS = f"""
SELECT match_no, round, home_name AS home_team, "awayShortName" AS away_team, home_rank,
  away_rank, coalesce({number('"homeRecentPoints"')}, 0) AS home_form_points,
  away_form AS away_form_points, home_home_rate AS home_home_win_rate,
  away_away_rate AS away_away_win_rate, home_goal_difference,
  coalesce({number('"awayGoalDiff"')}, 0) AS away_goal_difference, n.weather, vote_home,
  vote_draw, vote_away
FROM ({_NORMAL_SQL}) n JOIN ({_RAW_SELECT}) r ON r."totoRound" || '-' || r."matchNo" = id"""


@query(
    "csv_dashboard",
    with_parts(
        "model_a",
        f"""SELECT round, match_no AS id, home_team AS home, away_team AS away, CASE pick
  {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.PICK_LABEL.items())} END AS prediction,
  pick_prob AS probability, CAST(floor(pick_edge + 0.5) AS BIGINT) AS edge, confidence
FROM model_a""",
        a_inputs=_CSV_INPUTS,
    ),
)
def csv_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from a quoted CSV to dashboard rows."""
    path = fresh_path(spark, "csv-dashboard")
    raw_match_texts(spark, sf).write.option("header", True).csv(path)
    return dashboard_from_csv(spark, path)


@query("snapshot_roundtrip", with_parts("games", _NORMAL_SQL))
def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All raw rows written as a JSON snapshot, read back and normalised on load."""
    raw = raw_match_texts(spark, sf)
    path = fresh_path(spark, "row-snapshot")
    write_row_snapshot(raw, path)
    return flat_match(matches.normalize_matches(read_row_snapshot(spark, path, raw.schema)))


_VOTES_SQL = f"""
SELECT match_no, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS has_votes,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN coalesce({number("a")}, 0) END
    AS vote_home,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN coalesce({number("b")}, 0) END
    AS vote_draw
FROM (SELECT match_no, CASE WHEN match_no % 7 <> 0 THEN '40' END AS a,
        CASE WHEN match_no % 5 <> 0 THEN {noisy_number_sql("match_no")} END AS b, '' AS c FROM games)"""


@query("votes_optional", with_parts("games", _VOTES_SQL))
def votes_optional(spark: SparkSession, sf: str) -> DataFrame:
    """Votes are there only when all three are; an empty text is there and counts 0."""
    key = F.col("match_no")
    shares = views.games(spark, sf).select(
        "match_no",
        F.when(key % 7 != 0, F.lit("40")).alias("a"),
        F.when(key % 5 != 0, noisy_number(key)).alias("b"),
        F.lit("").alias("c"),
    )
    voted = shares.withColumn("votes", matches.vote_struct("a", "b", "c"))
    return voted.select(
        "match_no",
        F.col("votes").isNotNull().alias("has_votes"),
        F.col("votes.home").alias("vote_home"),
        F.col("votes.draw").alias("vote_draw"),
    )


# -------------------------------------------------------------------- the 27-column layout

PLAIN_TEXT_COLUMNS = {
    "round_no": (lambda: F.col("round"), "round"),
    "match_no": (lambda: F.col("match_no").cast("string"), "CAST(match_no AS VARCHAR)"),
    "kickoff": (
        lambda: F.when(F.col("match_no") % 5 == 0, "").otherwise(F.col("kickoff")),
        "CASE WHEN match_no % 5 = 0 THEN '' ELSE kickoff END",
    ),
    "league": (
        lambda: F.concat(F.lit("J"), (F.col("home_key") % 3 + 1).cast("string")),
        "'J' || CAST(home_key % 3 + 1 AS VARCHAR)",
    ),
    "venue": (
        lambda: F.when(F.col("match_no") % 3 == 0, "").otherwise(F.lit("Stadium")),
        "CASE WHEN match_no % 3 = 0 THEN '' ELSE 'Stadium' END",
    ),
    "home_team": (lambda: views.fixture_name("home_key"), _team_sql("home")),
    "away_team": (lambda: views.fixture_name("away_key"), _team_sql("away")),
    "weather": (lambda: F.coalesce("weather", F.lit("")), "coalesce(weather, '')"),
    "home_last5": (lambda: form_text("home_key"), "{form:home_key}"),
    "away_last5": (
        lambda: F.when(F.col("match_no") % 2 == 0, "").otherwise(form_text("away_key")),
        "CASE WHEN match_no % 2 = 0 THEN '' ELSE {form:away_key} END",
    ),
}


def form_text(key: str) -> Column:
    """Five letters of W, D, L from the digits of a number of the match and the team."""
    digits = ((F.col("match_no") * 7919 + F.col(key) * 104729) % 100000).cast("string")
    return F.translate(F.lpad(digits, 5, "0"), "0123456789", "WDLWDLWDLW")


def form_text_sql(key: str) -> str:
    digits = f"CAST((match_no * 7919 + {key} * 104729) % 100000 AS VARCHAR)"
    return f"translate(lpad({digits}, 5, '0'), '0123456789', 'WDLWDLWDLW')"


def _import_sql(name: str) -> str:
    if name in PLAIN_TEXT_COLUMNS:
        sql = PLAIN_TEXT_COLUMNS[name][1]
        for key in ("home_key", "away_key"):
            sql = sql.replace(f"{{form:{key}}}", form_text_sql(key))
        return sql
    return f"trim({noisy_number_sql(f'match_no + {fv.IMPORT_COLUMNS.index(name)}')})"


def import_texts(spark: SparkSession, sf: str) -> DataFrame:
    games = views.games(spark, sf)
    columns = []
    for i, name in enumerate(fv.IMPORT_COLUMNS):
        made = PLAIN_TEXT_COLUMNS.get(name)
        value = made[0]() if made else noisy_number(F.col("match_no") + i)
        columns.append(value.alias(name))
    return games.select(*columns)


_IMPORT_SELECT = "SELECT " + ", ".join(f"{_import_sql(c)} AS {c}" for c in fv.IMPORT_COLUMNS)
_IMPORT_SELECT += " FROM games"


@query("csv_plain", with_parts("games", _IMPORT_SELECT))
def csv_plain(spark: SparkSession, sf: str) -> DataFrame:
    """All games written as unquoted CSV to the shared folder and scanned back."""
    path = fresh_path(spark, "csv-plain")
    writer = import_texts(spark, sf).write.option("header", True).option("emptyValue", "")
    writer.option("quote", "\u0000").csv(path)
    return read_plain_csv(spark, path)


_LACKED = ("venue", "weather", "vote_home")


def _many_layouts_sql() -> str:
    lacked = "CASE WHEN CAST(match_no AS BIGINT) % 3 <> 2 THEN {0} END AS {0}"
    shown = (lacked.format(c) if c in _LACKED else c for c in fv.IMPORT_COLUMNS)
    return with_parts("games", f"SELECT {', '.join(shown)} FROM ({_IMPORT_SELECT})")


@query("csv_many_layouts", _many_layouts_sql())
def csv_many_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """One read over files that differ in the order of columns, in line ends and in columns."""
    texts, names, paths = import_texts(spark, sf), list(fv.IMPORT_COLUMNS), []
    layouts = [(names, "\n"), (names[::-1], "\r\n"), ([n for n in names if n not in _LACKED], "\r\n")]
    for i, (columns, line_end) in enumerate(layouts):
        paths.append(fresh_path(spark, "csv-layout"))
        rows = texts.where(f"CAST(match_no AS bigint) % 3 = {i}").select(columns)
        writer = rows.write.option("header", True).option("emptyValue", "").option("lineSep", line_end)
        writer.option("quote", "\u0000").csv(paths[-1])
    return read_plain_csv(spark, paths)


def _typed_sql(name: str) -> str:
    if name in matches.TEXT_AS_IS:
        return name
    if name == "weather":
        return f"coalesce(nullif(weather, ''), '{fv.WEATHER_UNKNOWN}') AS weather"
    if name in matches.EMPTY_AS_NULL:
        return f"nullif({name}, '') AS {name}"
    return f"{number(name)} AS {name}"


@query(
    "import_projection",
    with_parts(
        "games",
        "SELECT " + ", ".join(_typed_sql(c) for c in fv.IMPORT_COLUMNS) + f" FROM ({_IMPORT_SELECT})",
    ),
)
def import_projection(spark: SparkSession, sf: str) -> DataFrame:
    return matches.import_projection(import_texts(spark, sf))


_WHOLE = {column.split()[0] for column in schemas.MATCHES.split(", ") if column.endswith(" int")}


def _stored_sql(name: str) -> str:
    """As the stored table has it: whole numbers where its schema says so."""
    if name in _WHOLE:
        return f"CAST(trunc({number(name)}) AS BIGINT) AS {name}"
    return _typed_sql(name)


@query(
    "csv_import",
    with_parts(
        "games",
        "SELECT " + ", ".join(_stored_sql(c) for c in fv.IMPORT_COLUMNS)
        + f", round_no || ' toto' AS title, 'imported' AS status FROM ({_IMPORT_SELECT})",
    ),
)
def csv_import(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way from a plain CSV into stored rounds and matches, imported twice."""
    path, store = fresh_path(spark, "csv-import"), fresh_path(spark, "store")
    writer = import_texts(spark, sf).write.option("header", True).option("emptyValue", "")
    writer.option("quote", "\u0000").csv(path)
    for _ in range(2):
        import_matches_csv(spark, path, f"{store}/rounds", f"{store}/matches")
    stored = stored_table(spark, f"{store}/matches", schemas.MATCHES)
    shown = F.date_format("kickoff", "yyyy-MM-dd'T'HH:mm:ss").alias("kickoff")
    return stored.join(spark.read.parquet(f"{store}/rounds"), "round_no").select(
        *(shown if c == "kickoff" else F.col(c) for c in fv.IMPORT_COLUMNS), "title", "status"
    )


_SCORED = "match_no % 13 <> 0"
_RESULT = "CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals = away_goals THEN 'draw' ELSE 'away' END"


@query(
    "results_update",
    with_parts(
        "games",
        f"""SELECT round, count(*) AS match_count, CAST(sum(hit) AS BIGINT) AS hit_count,
  CAST(sum(edge) AS BIGINT) AS edge_sum, CAST(sum(up) AS BIGINT) AS positive_count,
  CAST(sum(up * hit) AS BIGINT) AS positive_hits, sum(hit) / count(*) AS accuracy,
  sum(edge) / count(*) AS average_edge
FROM (SELECT round, match_no % 31 - 15 AS edge, CASE WHEN match_no % 31 > 15 THEN 1 ELSE 0 END AS up,
        CASE WHEN {_RESULT} = CASE match_no % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END
             THEN 1 ELSE 0 END AS hit
      FROM games WHERE {_SCORED}) GROUP BY round""",
    ),
)
def results_update(spark: SparkSession, sf: str) -> DataFrame:
    """Imported matches get their results by a later upsert; picks are judged on the stored table."""
    path, store = fresh_path(spark, "csv-import"), fresh_path(spark, "store")
    writer = import_texts(spark, sf).write.option("header", True).option("emptyValue", "")
    writer.option("quote", "\u0000").csv(path)
    import_matches_csv(spark, path, f"{store}/rounds", f"{store}/matches")
    results = views.games(spark, sf).where(_SCORED).select(
        F.col("round").alias("round_no"),
        "match_no",
        F.col("home_goals").alias("result_home_score"),
        F.col("away_goals").alias("result_away_score"),
        scoring.outcome_from_scores("home_goals", "away_goals").alias("result_outcome"),
    )
    upsert_table(f"{store}/matches", results, ["round_no", "match_no"], "round_no", None, schemas.MATCHES)
    stored = stored_table(spark, f"{store}/matches", schemas.MATCHES)
    number = F.col("match_no")
    picked = stored.select(
        F.col("round_no").alias("round"),
        F.when(number % 3 == 0, "HOME").when(number % 3 == 1, "DRAW").otherwise("AWAY").alias("pick"),
        (number % 31 - 15).cast("bigint").alias("pick_edge"),
        "result_outcome",
    )
    return backtest.round_backtest(picked)


_CHANGED = "match_no % 5 = 0"


@query(
    "import_counts",
    with_parts(
        "games",
        f"""SELECT CAST(step AS BIGINT) AS step, table_name, CAST(inserted AS BIGINT) AS inserted, CAST(updated AS BIGINT) AS updated,
  CAST(unchanged AS BIGINT) AS unchanged FROM (
  SELECT 1 AS step, 'rounds' AS table_name, count(DISTINCT round) AS inserted, 0 AS updated, 0 AS unchanged
    FROM games WHERE match_no % 2 = 0
  UNION ALL SELECT 1, 'matches', count(*), 0, 0 FROM games WHERE match_no % 2 = 0
  UNION ALL SELECT 2, 'rounds', count(*) FILTER (NOT old), 0, count(*) FILTER (old)
    FROM (SELECT round, bool_or(match_no % 2 = 0) AS old FROM games GROUP BY round)
  UNION ALL SELECT 2, 'matches', count(*) FILTER (match_no % 2 <> 0), count(*) FILTER (match_no % 2 = 0 AND {_CHANGED}),
    count(*) FILTER (match_no % 2 = 0 AND NOT ({_CHANGED})) FROM games)""",
    ),
)
def import_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What two imports report: half of the matches, then all with some of them changed."""
    store, texts = fresh_path(spark, "store"), import_texts(spark, sf)
    changed = F.when(F.expr(_CHANGED), F.concat("venue", F.lit(" 2"))).otherwise(F.col("venue"))
    reports = []
    for step, rows in enumerate((texts.where("match_no % 2 = 0"), texts.withColumn("venue", changed)), 1):
        path = fresh_path(spark, "csv-import")
        writer = rows.write.option("header", True).option("emptyValue", "")
        writer.option("quote", "\u0000").csv(path)
        counted = import_matches_csv(spark, path, f"{store}/rounds", f"{store}/matches")
        reports += [(step, table, *(found[c] for c in CHANGES)) for table, found in counted.items()]
    return spark.createDataFrame(
        reports, "step int, table_name string, inserted bigint, updated bigint, unchanged bigint"
    )


@query(
    "imported_rounds",
    with_parts(
        "games",
        "SELECT DISTINCT round AS round_no, round || ' toto' AS title, 'imported' AS status FROM games",
    ),
)
def imported_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return matches.imported_rounds(import_texts(spark, sf))


@query(
    "form_points",
    with_parts(
        "games",
        "SELECT match_no, form, CAST(len(form) - len(replace(form, 'D', '')) "
        "+ 3 * (len(form) - len(replace(form, 'W', ''))) AS BIGINT) AS points "
        f"FROM (SELECT match_no, {form_text_sql('home_key')} AS form FROM games)",
    ),
)
def form_points(spark: SparkSession, sf: str) -> DataFrame:
    forms = views.games(spark, sf).select("match_no", form_text("home_key").alias("form"))
    return forms.withColumn("points", scoring.form_points("form"))


# --------------------------------------------------------------------------- typed helpers


@query(
    "name_key",
    f"""SELECT c_custkey, replace(replace(replace(replace(regexp_replace(
  'Ｖ． ' || c_name || '　ＦＣ' || chr(160) || c_mktsegment, '{WS}+', '', 'g'),
  'Ｆ', 'F'), 'Ｃ', 'C'), 'Ｖ', 'V'), '．', '.') AS name_key FROM customer""",
)
def name_key(spark: SparkSession, sf: str) -> DataFrame:
    written = F.concat(
        F.lit("Ｖ． "), "c_name", F.lit("　ＦＣ"), F.lit(" "), "c_mktsegment"
    )
    customers = views.table(spark, sf, "customer")
    return customers.select("c_custkey", text.name_key(written).alias("name_key"))


@query(
    "name_undouble",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN c_name || 'x' WHEN 3 THEN '' "
    "ELSE c_name END AS name FROM customer",
)
def name_undouble(spark: SparkSession, sf: str) -> DataFrame:
    """Doubled, doubled with padding, not doubled, empty."""
    kind, name = F.col("c_custkey") % 4, F.col("c_name")
    odd = F.concat(name, F.lit("x"))
    written = (
        F.when(kind == 0, F.concat(name, name))
        .when(kind == 1, F.concat(F.lit("　"), name, name, F.lit(" \n")))
        .when(kind == 2, odd)
        .otherwise(F.lit("  "))
    )
    customers = views.table(spark, sf, "customer")
    return customers.select("c_custkey", text.undouble(written).alias("name"))


@query(
    "slug",
    "SELECT p_partkey, replace(lower(p_name), ' ', '-') || '---' || "
    "replace(lower(p_type), ' ', '-') AS slug FROM part",
)
def slug(spark: SparkSession, sf: str) -> DataFrame:
    written = F.concat(F.lit("  "), "p_name", F.lit("　 ・\t"), "p_type", F.lit("\n"))
    return views.table(spark, sf, "part").select("p_partkey", text.slug(written).alias("slug"))


@query(
    "noisy_int",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(floor(o_orderkey / 6) AS BIGINT)
  WHEN 1 THEN 15 WHEN 2 THEN 0 WHEN 3 THEN -CAST(o_orderkey AS BIGINT)
  WHEN 4 THEN CAST(o_orderkey AS BIGINT) ELSE 0 END AS value FROM orders""",
)
def noisy_int(spark: SparkSession, sf: str) -> DataFrame:
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 6
    written = (
        F.when(kind == 0, F.concat(F.floor(key / 6).cast("string"), F.lit(" 位")))
        .when(kind == 1, F.lit("1.5"))
        .when(kind == 2, F.lit("1-2"))
        .when(kind == 3, F.concat(F.lit("gd -"), key.cast("string")))
        .when(kind == 4, F.concat(F.lit("+"), key.cast("string")))
    )
    orders = views.table(spark, sf, "orders")
    return orders.select("o_orderkey", numbers.noisy_int(written).alias("value"))


_NOISE_SQL = noisy_number_sql("o_orderkey")


@query(
    "number_fallback",
    f"""SELECT o_orderkey, coalesce({number("t")}, 7) AS or_seven, {number("t")} AS or_null,
  {number(stripped("' ' || t"))} AS squeezed_or_null, {number("' ' || t")} AS padded
FROM (SELECT o_orderkey, {_NOISE_SQL} AS t FROM orders)""",
)
def number_fallback(spark: SparkSession, sf: str) -> DataFrame:
    written = noisy_number(F.col("o_orderkey"))
    padded = F.concat(F.lit(" "), written)
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.number_or(written, 7).alias("or_seven"),
        numbers.nullable_number(written).alias("or_null"),
        numbers.nullable_number(text.strip_ws(padded)).alias("squeezed_or_null"),
        numbers.nullable_number(padded).alias("padded"),
    )


@query(
    "js_round",
    "SELECT o_orderkey, CAST(floor((o_orderkey % 41 - 20) / 2 + 0.5) AS BIGINT) AS halves, "
    "CAST(floor(o_totalprice - 250000 + 0.5) AS BIGINT) AS price, "
    "abs((o_orderkey % 41 - 20) / 2) AS distance FROM orders",
)
def js_round(spark: SparkSession, sf: str) -> DataFrame:
    half = (F.col("o_orderkey") % 41 - 20) / 2
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.half_up(half).alias("halves"),
        numbers.half_up(F.col("o_totalprice") - 250000).alias("price"),
        F.abs(half).alias("distance"),
    )


@query(
    "clamp",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN "
    "greatest(100000.0::DOUBLE, least(300000.0::DOUBLE, o_totalprice)) END AS price FROM orders",
)
def clamp(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice"))
    return views.table(spark, sf, "orders").select(
        "o_orderkey", numbers.clamp(price, 100000, 300000).alias("price")
    )
