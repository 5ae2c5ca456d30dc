"""Ledger, rating and data-quality queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators import filters, ledger, quality, ratings
from duelframe.plans.registry import SHARED_SQL, query
from duelframe.plans.shapes import Shapes
from duelframe.storage import materialise, new_path

SHARED_SQL["dated"] = "SELECT *, CAST(game_date AS TIMESTAMP) - to_hours(hours_ahead) AS created_at FROM predictions"
SHARED_SQL["open_lines"] = """SELECT game_date, home, away, CASE WHEN home % 7 = 0 THEN NULL ELSE spread END AS opening_spread,
  CASE WHEN home % 3 = 0 THEN close_spread END AS closing_spread FROM odds WHERE home % 4 <> 0"""
SHARED_SQL["new_quotes"] = """SELECT game_date, home, away, spread + 1 AS opening_spread, close_spread AS closing_spread
  FROM odds WHERE away % 5 <> 0"""


def dated(s: Shapes) -> DataFrame:
    return s.predictions().withColumn(
        "created_at", F.col("game_date").cast("timestamp") - F.make_dt_interval(hours=F.col("hours_ahead"))
    )


def open_lines(s: Shapes) -> DataFrame:
    return s.odds().filter("home % 4 <> 0").select(
        "game_date", "home", "away",
        F.when(F.col("home") % 7 != 0, F.col("spread")).alias("opening_spread"),
        F.when(F.col("home") % 3 == 0, F.col("close_spread")).alias("closing_spread"),
    )


def new_quotes(s: Shapes) -> DataFrame:
    return s.odds().filter("away % 5 <> 0").select(
        "game_date", "home", "away", (F.col("spread") + 1).alias("opening_spread"), F.col("close_spread").alias("closing_spread")
    )


def day(text: str):
    return F.lit(text).cast("date")


@query(
    "sq_write_once",
    "id:l game_date:d home:i away:i p_home:f6 created_at:t",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_date, home, away ORDER BY created_at, id) AS n FROM dated
      WHERE (game_date, home, away) NOT IN (SELECT (game_date, home, away) FROM dated WHERE season < 199798 AND model = 'gbt'))
    WHERE n = 1""",
)
def write_once(s: Shapes) -> DataFrame:
    rows = dated(s)
    store = rows.filter("season < 199798 AND model = 'gbt'")
    return ledger.write_once(store, rows, ledger.LINE_KEYS, ["created_at", "id"])


SHARED_SQL["tracked"] = """SELECT p.*, o.opening_spread, v.edge, CASE WHEN p_home >= 0.5 THEN p.home ELSE p.away END AS winner,
  CASE WHEN game % 10 = 0 THEN NULL WHEN home_win = 1 THEN p.home ELSE p.away END AS actual FROM
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_date, home, away ORDER BY id DESC) AS n FROM predictions
    WHERE game_date >= DATE '2001-08-01' - 60) WHERE n = 1) p
  LEFT JOIN open_lines o USING (game_date, home, away)
  LEFT JOIN (SELECT game_date, home, away, max(p_home - 0.5) AS edge FROM predictions WHERE p_home > 0.6 GROUP BY ALL) v USING (game_date, home, away)"""


@query(
    "sq_latest_wins",
    "id:l game_date:d predicted_winner:i pick:s edge_pct:f4 value_bet:i actual_winner:i result:s",
    """SELECT id, game_date, winner AS predicted_winner, concat_ws(' ', CAST(winner AS VARCHAR), printf('%+.1f', opening_spread)) AS pick,
    edge * 100 AS edge_pct, CAST(edge IS NOT NULL AS INT) AS value_bet, actual AS actual_winner,
    CASE WHEN actual IS NULL THEN 'pending' WHEN winner = actual THEN 'win' ELSE 'loss' END AS result FROM tracked""",
)
def latest_wins(s: Shapes) -> DataFrame:
    rows = s.predictions()
    value = rows.filter("p_home > 0.6").groupBy("game_date", "home", "away").agg(F.max(F.col("p_home") - 0.5).alias("edge"))
    stored = rows.withColumn("home_win", F.when(F.col("game") % 10 != 0, F.col("home_win")))
    return ledger.bet_tracker(stored, open_lines(s), value, day("2001-08-01"))


@query(
    "sq_clv_upsert",
    "game_date:d home:i away:i opening_spread:f2 closing_spread:f2 clv:f2",
    """SELECT *, opening_spread - closing_spread AS clv FROM (SELECT game_date, home, away, opening_spread,
      coalesce(c, CASE WHEN game_date < DATE '2001-01-01' AND opening_spread IS NOT NULL THEN qc END) AS closing_spread FROM
      (SELECT game_date, home, away, CASE WHEN known THEN l.opening_spread ELSE q.opening_spread END AS opening_spread,
        l.closing_spread AS c, q.closing_spread AS qc FROM (SELECT *, true AS known FROM open_lines) l
        FULL JOIN new_quotes q USING (game_date, home, away)))""",
)
def clv_upsert(s: Shapes) -> DataFrame:
    return ledger.upsert_lines(open_lines(s), new_quotes(s), day("2001-01-01"))


SHARED_SQL["resolved"] = """SELECT p.id, p.game_date, p.home, p.away, CASE WHEN p.game % 3 = 0 THEN 'known' WHEN p.game_date >= DATE '2000-12-01' THEN 'future'
  WHEN r.home_win IS NULL THEN 'no match' ELSE 'filled' END AS status,
  CASE WHEN p.game % 3 = 0 THEN p.home_win WHEN p.game_date < DATE '2000-12-01' THEN r.home_win END AS home_win, r.margin AS actual_margin
  FROM predictions p LEFT JOIN (SELECT game_date, home, away, max_by(CAST(home_pts >= away_pts AS INT), game) AS home_win,
    max_by(home_pts - away_pts, game) AS margin FROM contest WHERE game % 8 <> 0 GROUP BY ALL) r USING (game_date, home, away)"""


def resolved(s: Shapes) -> DataFrame:
    games = s.contest().filter("game % 8 <> 0")
    margin = F.col("home_pts") - F.col("away_pts")
    results = games.groupBy("game_date", "home", "away").agg(
        F.max_by((margin >= 0).cast("int"), "game").alias("home_win"), F.max_by(margin, "game").alias("margin")
    )
    stored = s.predictions().drop("margin").withColumn("home_win", F.when(F.col("game") % 3 == 0, F.col("home_win")))
    return ledger.fill_outcomes(stored, results, day("2000-12-01"))


@query("sq_outcome_backfill", "id:l status:s home_win:i actual_margin:i", "SELECT * FROM resolved")
def outcome_backfill(s: Shapes) -> DataFrame:
    return resolved(s)


@query("sq_outcome_summary", "status:s n:l", "SELECT status, count(*) AS n FROM resolved WHERE status <> 'known' GROUP BY status")
def outcome_summary(s: Shapes) -> DataFrame:
    return ledger.outcome_summary(resolved(s))


@query(
    "sq_line_report",
    "game_date:d home:i away:i opening_spread:f2 current_spread:f2 movement:f2 direction:s classification:s steam_move:i movement_label:s interpretation:s",
    """SELECT *, CAST(abs(movement) >= 1.5 AS INT) AS steam_move,
    CASE WHEN abs(movement) < 0.05 THEN 'No movement' WHEN movement < 0 THEN concat(CAST(home AS VARCHAR), ' ', printf('%+.1f', current_spread))
      ELSE concat(CAST(away AS VARCHAR), ' ', printf('%+.1f', abs(movement))) END AS movement_label,
    CASE WHEN pending THEN concat('Opening line ', printf('%+.1f', opening_spread), ' -- game not yet closed')
      WHEN classification = 'stable' THEN concat('Line stable at ', printf('%+.1f', current_spread), ' -- no significant money movement')
      ELSE concat('Line moved ', printf('%.1f', abs(movement)), ' pt(s) toward ', side, ' (', printf('%+.1f', opening_spread), ' -> ',
        printf('%+.1f', current_spread), ') -- ', CASE WHEN classification = 'sharp_action' THEN 'Sharp' ELSE 'Moderate' END, ' money on ', side) END AS interpretation
    FROM (SELECT *, CASE WHEN abs(movement) >= 1.5 THEN 'sharp_action' WHEN abs(movement) >= 0.5 THEN 'moderate_move' ELSE 'stable' END AS classification,
        CASE WHEN movement < -0.05 THEN 'home' WHEN movement > 0.05 THEN 'away' ELSE 'no_movement' END AS direction,
        CAST(CASE WHEN movement < 0 THEN home ELSE away END AS VARCHAR) AS side FROM
      (SELECT *, coalesce(closing_spread, opening_spread) AS current_spread, coalesce(closing_spread, opening_spread) - opening_spread AS movement,
        closing_spread IS NULL AS pending FROM
        (SELECT *, row_number() OVER (PARTITION BY game_date, home, away ORDER BY priority) AS n FROM
          (SELECT *, 0 AS priority, 1 AS needs FROM new_quotes WHERE home % 2 = 0 UNION ALL SELECT *, 1, 0 FROM open_lines
           UNION ALL SELECT game_date, home, away, round((0.5 - max(p_home)) * 33.3, 1), round((0.5 - max(p_home)) * 33.3, 1), 2, 0 FROM predictions GROUP BY ALL))
        WHERE n = 1 AND opening_spread IS NOT NULL AND (needs = 0 OR closing_spread IS NOT NULL)))""",
)
def line_report(s: Shapes) -> DataFrame:
    quotes = new_quotes(s).filter("home % 2 = 0").withColumn("needs_close", F.lit(1))
    logged = open_lines(s).withColumn("needs_close", F.lit(0))
    implied = F.round((0.5 - F.max("p_home")) * 33.3, 1)
    derived = s.predictions().groupBy("game_date", "home", "away").agg(
        implied.alias("opening_spread"), implied.alias("closing_spread")
    ).withColumn("needs_close", F.lit(0))
    return ledger.line_report([quotes, logged, derived])


def league_games(s: Shapes) -> DataFrame:
    """Contests with the region of the home side as league."""
    leagues = s.nation.select(F.col("n_nationkey").alias("home"), F.col("n_regionkey").alias("league"))
    return s.contest().join(leagues, "home")


def _elo_shift(h: str, a: str, k: int) -> str:
    lead = f"({h} + 100 - {a})"
    weight = f"CASE WHEN m = 0 THEN 1 ELSE ln(abs(m) + 1) * 2.2 / (abs({lead}) * 0.001 + 2.2) END"
    return f"{k} * ({weight}) * (CAST(m >= 0 AS INT) - 1 / (1 + pow(10, -{lead} / 400)))"


# The ratings of all 25 teams are one list per league and track; the recursion adds one game at a time.
_ELO = f"""WITH RECURSIVE seq AS (SELECT n_regionkey AS league, game, season, home, away, home_pts - away_pts AS m,
    row_number() OVER (PARTITION BY n_regionkey ORDER BY game_date, game) AS n FROM contest JOIN nation ON home = n_nationkey),
  fold AS (SELECT DISTINCT league, CAST(0 AS BIGINT) AS n, [CAST(1500 AS DOUBLE) FOR x IN range(25)] AS slow, [CAST(1500 AS DOUBLE) FOR x IN range(25)] AS fast,
      [CAST(0 AS INT) FOR x IN range(25)] AS seen, CAST(NULL AS BIGINT) AS game, CAST(NULL AS INT) AS season, CAST(NULL AS INT) AS home, CAST(NULL AS INT) AS away,
      CAST(NULL AS DOUBLE) AS h, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS hf, CAST(NULL AS DOUBLE) AS af FROM seq
    UNION ALL
    SELECT league, n, slow[:least(home, away)] || [CASE WHEN home < away THEN h + d ELSE a - d END] || slow[least(home, away) + 2:greatest(home, away)]
        || [CASE WHEN home < away THEN a - d ELSE h + d END] || slow[greatest(home, away) + 2:],
      fast[:least(home, away)] || [CASE WHEN home < away THEN hf + df ELSE af - df END] || fast[least(home, away) + 2:greatest(home, away)]
        || [CASE WHEN home < away THEN af - df ELSE hf + df END] || fast[greatest(home, away) + 2:],
      seen[:least(home, away)] || [season] || seen[least(home, away) + 2:greatest(home, away)] || [season] || seen[greatest(home, away) + 2:],
      game, season, home, away, h, a, hf, af
    FROM (SELECT *, {_elo_shift("h", "a", 20)} AS d, {_elo_shift("hf", "af", 40)} AS df FROM
      (SELECT f.league, s.n, f.slow, f.fast, f.seen, s.game, s.season, s.home, s.away, s.m,
        CASE WHEN seen[s.home + 1] IN (0, s.season) THEN slow[s.home + 1] ELSE 1500 + (slow[s.home + 1] - 1500) * 2 / 3 END AS h,
        CASE WHEN seen[s.away + 1] IN (0, s.season) THEN slow[s.away + 1] ELSE 1500 + (slow[s.away + 1] - 1500) * 2 / 3 END AS a,
        CASE WHEN seen[s.home + 1] IN (0, s.season) THEN fast[s.home + 1] ELSE 1500 + (fast[s.home + 1] - 1500) * 2 / 3 END AS hf,
        CASE WHEN seen[s.away + 1] IN (0, s.season) THEN fast[s.away + 1] ELSE 1500 + (fast[s.away + 1] - 1500) * 2 / 3 END AS af
       FROM fold f JOIN seq s ON s.league = f.league AND s.n = f.n + 1)))
  SELECT league, game, season, home, away, h AS home_elo, a AS away_elo, h - a AS diff_elo, 1 / (1 + pow(10, -(h + 100 - a) / 400)) AS home_expected,
    hf AS home_elo_fast, hf - h AS home_momentum, af - a AS away_momentum FROM fold WHERE n > 0"""


@query(
    "sq_elo",
    "league:l game:l season:i home:l away:l home_elo:f6 away_elo:f6 diff_elo:f6 home_expected:f6 home_elo_fast:f6 home_momentum:f6 away_momentum:f6",
    _ELO,
)
def elo(s: Shapes) -> DataFrame:
    return ratings.elo(league_games(s), ["game_date", "game"])


_DQ = "check:s status:s metric:f6 detail:s"


@query(
    "dq_row_counts",
    _DQ,
    """SELECT concat('rows:', t) AS "check", CASE WHEN n = 0 THEN 'FAIL' WHEN n < 10 THEN 'WARN' ELSE 'PASS' END AS status, n AS metric, '' AS detail FROM
    (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'region', count(*) FROM region
     UNION ALL SELECT 'none', count(*) FROM orders WHERE o_orderkey < 0)""",
)
def row_counts(s: Shapes) -> DataFrame:
    return quality.row_counts({"orders": s.orders, "region": s.region, "none": s.orders.filter("o_orderkey < 0")})


@query(
    "dq_key_unique",
    _DQ,
    """SELECT 'unique:lineitem' AS "check", CASE WHEN sum(n - 1) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, sum(n - 1) AS metric, '' AS detail
      FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 'unique:games', CASE WHEN sum(n - 1) > 0 THEN 'FAIL' ELSE 'PASS' END, sum(n - 1), '' FROM (SELECT count(*) AS n FROM contest_log GROUP BY team, game)""",
)
def key_unique(s: Shapes) -> DataFrame:
    lines = quality.key_unique(s.lineitem, ["l_orderkey", "l_linenumber"], "lineitem")
    return lines.unionByName(quality.key_unique(s.contest_log(), ["team", "game"], "games"))


@query(
    "dq_future_dates",
    _DQ,
    """SELECT 'future:games' AS "check", CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS metric, '' AS detail
    FROM (SELECT count(*) AS n FROM contest WHERE game_date > DATE '2001-07-02')""",
)
def future_dates(s: Shapes) -> DataFrame:
    return quality.future_dates(s.contest(), "game_date", day("2001-07-01"), "games")


@query(
    "dq_season_range",
    _DQ,
    """SELECT 'season:games' AS "check", CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS metric,
    concat(CAST(lo AS VARCHAR), '-', CAST(hi AS VARCHAR)) AS detail
    FROM (SELECT count(*) FILTER (WHERE season < 194647 OR season > 199900) AS n, min(season) AS lo, max(season) AS hi FROM contest)""",
)
def season_range(s: Shapes) -> DataFrame:
    return quality.season_range(s.contest(), "season", F.lit(199900), "games")


_STATUS = "CASE WHEN metric >= 0.95 THEN 'FAIL' WHEN metric > 0 THEN 'WARN' ELSE 'PASS' END"


@query(
    "dq_null_columns",
    _DQ,
    f"""SELECT "check", {_STATUS} AS status, metric, '' AS detail FROM (SELECT 'nulls:minutes' AS "check", avg(CAST(minutes IS NULL AS INT)) AS metric FROM player_log
      UNION ALL SELECT 'nulls:pts', avg(CAST(pts IS NULL AS INT)) FROM player_log
      UNION ALL SELECT 'nulls:bonus', 1.0 FROM (SELECT count(*) FROM player_log))""",
)
def null_columns(s: Shapes) -> DataFrame:
    rows = s.player_log().withColumn("bonus", F.when(F.col("game") < 0, 1))
    return quality.null_columns(rows, ["minutes", "pts", "bonus"])


@query(
    "dq_row_ratio",
    _DQ,
    """SELECT 'ratio:contests' AS "check", CASE WHEN abs(r - 1) > 0.05 THEN 'FAIL' ELSE 'PASS' END AS status, r AS metric, '' AS detail
    FROM (SELECT (SELECT count(*) FROM contest) / ((SELECT count(*) FROM contest_log) / 2) AS r)""",
)
def row_ratio(s: Shapes) -> DataFrame:
    return quality.row_ratio(s.contest(), s.contest_log(), "contests")


@query(
    "dq_value_ranges",
    _DQ,
    """SELECT "check", CASE WHEN metric > 0 THEN 'FAIL' ELSE 'PASS' END AS status, metric, '' AS detail FROM
    (SELECT 'range:win_pct' AS "check", count(*) FILTER (WHERE (plus_minus + 30) / 60.0 < 0 OR (plus_minus + 30) / 60.0 > 1) AS metric FROM contest_log
     UNION ALL SELECT 'range:days_rest', count(*) FILTER (WHERE plus_minus < 0) FROM contest_log
     UNION ALL SELECT 'range:fg_pct', 0 FROM (SELECT count(*) FROM contest_log))""",
)
def value_ranges(s: Shapes) -> DataFrame:
    rows = s.contest_log().select(
        ((F.col("plus_minus") + 30) / 60).alias("win_pct"), F.col("plus_minus").alias("days_rest"),
        (F.col("fgm") / F.col("fga")).alias("fg_pct"), "pts",
    )
    return quality.value_ranges(rows, quality.rate_ranges(rows))


@query(
    "dq_required_columns",
    _DQ,
    """SELECT 'columns:games' AS "check", 'FAIL' AS status, 2 AS metric, 'referee,arena' AS detail FROM (SELECT count(*) FROM contest_log)
    UNION ALL SELECT 'columns:core', 'PASS', 0, '' FROM (SELECT count(*) FROM contest_log)""",
)
def required_columns(s: Shapes) -> DataFrame:
    log = s.contest_log()
    asked = quality.required_columns(log, ["game", "team", "referee", "arena"], "games")
    return asked.unionByName(quality.required_columns(log, ["game", "team", "pts"], "core"))


@query(
    "dq_all_null_group",
    _DQ,
    """SELECT "check", CASE WHEN metric = 0 THEN 'FAIL' ELSE 'PASS' END AS status, metric, '' AS detail FROM
    (SELECT 'filled:lines' AS "check", greatest(avg(CAST(spread IS NOT NULL AS INT)), avg(CAST(close_spread IS NOT NULL AS INT))) AS metric FROM odds
     UNION ALL SELECT 'filled:crew', 0 FROM (SELECT count(*) FROM odds))""",
)
def all_null_group(s: Shapes) -> DataFrame:
    rows = s.odds().withColumn("crew_rate", F.when(F.col("home") < 0, 1.0))
    return quality.fill_rates(rows, {"lines": ["spread", "close_spread"], "crew": ["crew_rate"]})


@query(
    "dq_probabilities",
    _DQ,
    """SELECT 'probability:model' AS "check", CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS metric, '' AS detail
      FROM (SELECT count(*) FILTER (WHERE p_home * 1.03 > 1 OR 1 - p_home < 0) AS n FROM predictions)
    UNION ALL SELECT 'sum:model', CASE WHEN n > 0 THEN 'WARN' ELSE 'PASS' END, n, ''
      FROM (SELECT count(*) FILTER (WHERE abs(p_home * 1.03 + (1 - p_home) - 1) > 0.02) AS n FROM predictions)""",
)
def probabilities(s: Shapes) -> DataFrame:
    rows = s.predictions().select((F.col("p_home") * 1.03).alias("home"), (1 - F.col("p_home")).alias("away"))
    return quality.probabilities(rows, "home", "away", "model", tolerance=0.02)


@query(
    "dq_stage_runner",
    "stage:s check:s status:s metric:f6",
    """SELECT 'games' AS stage, 'rows:games' AS "check", 'PASS' AS status, count(*) AS metric FROM contest
    UNION ALL SELECT 'games', 'unique:games', 'PASS', 0 FROM (SELECT count(*) FROM contest)
    UNION ALL SELECT 'games', 'future:games', 'PASS', 0 FROM (SELECT count(*) FROM contest)""",
)
def stage_runner(s: Shapes) -> DataFrame:
    games = s.contest()
    return quality.run_stage("games", {
        "rows": lambda: quality.row_counts({"games": games}),
        "unique": lambda: quality.key_unique(games, ["game"], "games"),
        "future": lambda: quality.future_dates(games, "game_date", day("2001-08-01"), "games"),
    })


@query(
    "dq_join_cardinality",
    _DQ,
    """SELECT "check", CASE WHEN metric > 1 OR metric < 0.9 THEN 'WARN' ELSE 'PASS' END AS status, metric, '' AS detail FROM
    (SELECT 'join:odds' AS "check", (SELECT count(*) FROM contest JOIN odds USING (game_date, home, away)) / (SELECT count(*) FROM contest) AS metric
     UNION ALL SELECT 'join:predictions', (SELECT count(*) FROM contest LEFT JOIN predictions p USING (game)) / (SELECT count(*) FROM contest))""",
)
def join_cardinality(s: Shapes) -> DataFrame:
    games = s.contest()
    priced = games.join(s.odds(), ["game_date", "home", "away"])
    predicted = games.join(s.predictions().select("game", "p_home"), "game", "left")
    return quality.join_cardinality(games, priced, "odds").unionByName(
        quality.join_cardinality(games, predicted, "predictions")
    )


@query(
    "dq_known_keys",
    "team:i game:l season:i n:l read:i",
    """WITH arriving AS (SELECT team, game FROM contest_log WHERE season = (SELECT max(season) FROM contest_log)
      UNION ALL SELECT team, game FROM contest_log WHERE season = (SELECT min(season) FROM contest_log) AND game % 50 = 0)
    SELECT team, game, season, count(*) AS n, 1 AS read FROM contest_log WHERE season < (SELECT max(season) FROM contest_log)
      AND (team, game) IN (SELECT (team, game) FROM arriving) GROUP BY ALL""",
)
def known_keys(s: Shapes) -> DataFrame:
    """A new season into which some rows of the first have strayed: found through stored filters; ``read`` says that no more seasons were read than the filters let through."""
    path = new_path(s.spark, "by-season")
    s.contest_log().select("team", "game", "season").write.partitionBy("season").parquet(path)
    log = s.spark.read.parquet(path)
    first, last = log.agg(F.min("season"), F.max("season")).first()
    history = log.where(F.col("season") < last)
    stored = materialise(filters.key_filters(history, ["team", "game"], "season"), "key-filters")
    new = log.where(F.col("season") == last).unionByName(log.where((F.col("season") == first) & (F.col("game") % 50 == 0)))
    found, read = filters.known_keys(new, history, stored, ["team", "game"], "season")
    few = len(read) <= filters.suspects(new, ["team", "game"], stored, "season").select("season").distinct().count()
    return found.withColumn("read", F.lit(int(few)))
