"""Texts, keywords and column lists that results are compared on."""

# --- fixed values: outcome vocabularies and their labels -------------------------------
PICKS = ("HOME", "DRAW", "AWAY")
OUTCOME_KEY = {"HOME": "home", "DRAW": "draw", "AWAY": "away"}
OUTCOME_MARK = {"HOME": "1", "DRAW": "0", "AWAY": "2"}
OUTCOME_LABEL = {"HOME": "ホーム勝ち", "AWAY": "アウェイ勝ち", "DRAW": "引き分け"}
PICK_LABEL = {"HOME": "HOME WIN", "AWAY": "AWAY WIN", "DRAW": "DRAW"}

# --- fixed values: team names --------------------------------------------------------
FULL_WIDTH = "ＦＣＶ．"
HALF_WIDTH = "FCV."
MIDDLE_DOT = "・"

# --- fixed values: round texts -------------------------------------------------------
STATUS_CODE = {"販売中": "open", "終了": "closed"}
ROUND_PREFIX, ROUND_SUFFIX = "第", "回"
FALLBACK_DETAIL_ROUND = "第1637回"
FALLBACK_ROUND_LABEL = "第XXXX回"

# --- fixed values: weather -----------------------------------------------------------
WEATHER_UNKNOWN = "未取得"
BAD_WEATHER = ("雨", "雪")
RAIN = "雨"

# --- fixed values: page texts --------------------------------------------------------
NO_TITLE = "No title"
FETCH_FAILED = "Fetch failed"
UNKNOWN_FETCH_ERROR = "Unknown fetch error"

# --- fixed values: the four registered sources ---------------------------------------
SOURCE_URLS = {
    "yahooSchedule": "https://toto.yahoo.co.jp/schedule/toto",
    "rakutenSchedule": "https://toto.rakuten.co.jp/toto/schedule/",
    "jleagueMatches": "https://www.jleague.jp/match/",
    "jleagueStandings": "https://www.jleague.jp/standings/j1/",
}

# --- fixed values: which links are worth following -----------------------------------
LINK_TEXT_KEYWORDS = ("くじ結果", "第")
LINK_HREF_KEYWORDS = ("toto", "sportskuji", "official")

# --- fixed values: dictionaries searched in page texts -------------------------------
DETAIL_KEYWORDS = (
    "開催回", "第1637回", "指定試合", "試合", "ホーム", "アウェイ", "投票率", "払戻", "当せん",
    "1等", "toto", "鹿", "浦", "神", "ＦＣ", "FC", "横浜", "川崎",
)
TEAM_NAMES = (
    "鹿島アントラーズ", "浦和レッズ", "柏レイソル", "ＦＣ東京", "FC東京", "東京ヴェルディ",
    "ＦＣ町田ゼルビア", "FC町田ゼルビア", "川崎フロンターレ", "横浜Ｆ・マリノス", "横浜F・マリノス",
    "清水エスパルス", "名古屋グランパス", "京都サンガF.C.", "京都サンガＦ.Ｃ.", "ガンバ大阪",
    "セレッソ大阪", "ヴィッセル神戸", "ファジアーノ岡山", "サンフレッチェ広島", "アビスパ福岡",
    "Ｖ・ファーレン長崎", "V・ファーレン長崎",
)

# --- fixed values: factor labels and sentences of model A ----------------------------
A_RANK = ("順位差", "が順位面で優位です。", "が順位面で優位です。")
A_FORM = ("直近成績", "の直近成績が上回っています。", "の直近成績が上回っています。")
A_VENUE = ("ホーム/アウェイ成績", "のホーム適性が優位です。", "のアウェイ成績が優位です。")
A_GOALS = ("得失点差", "の得失点差が上回っています。", "の得失点差が上回っています。")
A_WEATHER = ("天候", "悪天候により波乱・引き分けリスクを加味しています。")

# --- fixed values: factor labels and sentences of model B ----------------------------
B_RANK = ("順位差", "が順位面で優位です。", "が順位面で優位です。")
B_POINTS = ("勝点差", "が勝点で上回っています。", "が勝点で上回っています。")
B_GOALS = ("得失点差", "の得失点差が上回っています。", "の得失点差が上回っています。")
B_VENUE = ("ホーム補正", "のホーム開催を加点しています。")
B_UNMATCHED = (
    ("暫定予測", "Jリーグ順位表と照合できないため、暫定的に引き分け寄りとして表示しています。"),
    ("データ状態", "対象試合またはチーム名が順位データと一致していません。"),
)

# --- fixed values: columns of the two CSV layouts ------------------------------------
RAW_MATCH_COLUMNS = (
    "totoRound", "matchNo", "kickoffAt", "venue", "homeShortName", "awayShortName",
    "homeRank", "awayRank", "homeRecentPoints", "awayRecentPoints", "homeGoalDiff",
    "awayGoalDiff", "homeWinRate", "awayWinRate", "voteHome", "voteDraw", "voteAway",
    "weather",
)
IMPORT_COLUMNS = (
    "round_no", "match_no", "kickoff", "league", "venue", "home_team", "away_team",
    "weather", "home_rank", "away_rank", "home_points", "away_points", "home_last5",
    "away_last5", "home_goals_for", "home_goals_against", "away_goals_for",
    "away_goals_against", "home_win_rate", "away_win_rate", "home_rest_days",
    "away_rest_days", "home_injury_level", "away_injury_level", "vote_home", "vote_draw",
    "vote_away",
)
