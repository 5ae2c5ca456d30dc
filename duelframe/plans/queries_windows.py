"""Window queries (lags, rolling and running features) with their checking SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators import windows as wn
from duelframe.operators.aggregates import running_accuracy as daily_accuracy
from duelframe.operators.ordered import EntityLog, entity_log
from duelframe.plans.registry import SHARED_SQL, query
from duelframe.plans.shapes import Shapes

KEY = "team:i game_date:d game:l"
W = "OVER (PARTITION BY team ORDER BY game_date, game"
SEASON_W = "OVER (PARTITION BY team, season ORDER BY game_date, game"


def team_log(s: Shapes) -> EntityLog:
    return entity_log(s.contest_log(), ["team"], ["game_date", "game"])


def season_log(s: Shapes) -> EntityLog:
    return entity_log(s.contest_log(), ["team", "season"], ["game_date", "game"])


def rows(n: int) -> str:
    return f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(
    "wn_lag_mean",
    f"{KEY} pts_roll3:f6 pts_roll20:f6 plus_minus_roll3:f6 plus_minus_roll20:f6 tov_roll5:f6 tov_roll10:f6",
    f"""SELECT *, avg(pts) {W} {rows(3)}) AS pts_roll3, avg(pts) {W} {rows(20)}) AS pts_roll20,
    avg(plus_minus) {W} {rows(3)}) AS plus_minus_roll3, avg(plus_minus) {W} {rows(20)}) AS plus_minus_roll20,
    avg(tov) {W} {rows(5)}) AS tov_roll5, avg(tov) {W} {rows(10)}) AS tov_roll10 FROM contest_log""",
)
def lag_mean(s: Shapes) -> DataFrame:
    short = wn.lag_mean(team_log(s), ["pts", "plus_minus"], [3, 20])
    return wn.lag_mean(short, ["tov"], [5, 10]).result


@query(
    "wn_lag_rate",
    f"{KEY} win_roll5:f6 win_roll10:f6",
    f"SELECT *, avg(win) {W} {rows(5)}) AS win_roll5, avg(win) {W} {rows(10)}) AS win_roll10 FROM contest_log",
)
def lag_rate(s: Shapes) -> DataFrame:
    return wn.lag_mean(team_log(s), ["win"], [5, 10]).result


@query(
    "wn_lag_std",
    f"{KEY} net_rating_std_10:f6",
    f"SELECT *, coalesce(stddev_samp(plus_minus) {W} {rows(10)}), 0) AS net_rating_std_10 FROM contest_log",
)
def lag_std(s: Shapes) -> DataFrame:
    return wn.lag_std(team_log(s), "plus_minus", "net_rating_std_10").result


@query(
    "wn_min_periods",
    "player:l game:l pts_roll10:f6 minutes_roll10:f6",
    f"""SELECT *, CASE WHEN count(pts) OVER (PARTITION BY player ORDER BY game_date, game {rows(10)}) >= 5
    THEN avg(pts) OVER (PARTITION BY player ORDER BY game_date, game {rows(10)}) END AS pts_roll10,
    CASE WHEN count(minutes) OVER (PARTITION BY player ORDER BY game_date, game {rows(10)}) >= 5
    THEN avg(minutes) OVER (PARTITION BY player ORDER BY game_date, game {rows(10)}) END AS minutes_roll10
    FROM player_log""",
)
def min_periods(s: Shapes) -> DataFrame:
    log = entity_log(s.player_log(), ["player"], ["game_date", "game"])
    return wn.lag_mean(log, ["pts", "minutes"], [10], min_rows=5).result


def _ewma_sql(source: str, entity: str, column: str, span: int) -> str:
    keep = 1 - 2 / (span + 1)
    return f"""SELECT a.*, b.m AS {column}_ewma{span} FROM
    (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY game_date, game) AS n FROM {source}) a LEFT JOIN
    (SELECT x.{entity} AS e, x.n AS n,
       sum(y.{column} * pow({keep}, x.n - y.n - 1)) / sum(CASE WHEN y.{column} IS NOT NULL THEN pow({keep}, x.n - y.n - 1) END) AS m
     FROM (SELECT {entity}, row_number() OVER (PARTITION BY {entity} ORDER BY game_date, game) AS n FROM {source}) x
     JOIN (SELECT {entity}, {column}, row_number() OVER (PARTITION BY {entity} ORDER BY game_date, game) AS n FROM {source}) y
       ON x.{entity} = y.{entity} AND y.n < x.n
     GROUP BY x.{entity}, x.n) b ON a.{entity} = b.e AND a.n = b.n"""


@query("wn_ewma", f"{KEY} plus_minus_ewma7:f6", _ewma_sql("contest_log", "team", "plus_minus", 7))
def ewma(s: Shapes) -> DataFrame:
    return wn.ewma(team_log(s), ["plus_minus"], [7]).result


@query(
    "wn_ewma_nulls",
    "player:l game:l minutes_ewma10:f6",
    _ewma_sql("player_log", "player", "minutes", 10),
)
def ewma_nulls(s: Shapes) -> DataFrame:
    return wn.ewma(entity_log(s.player_log(), ["player"], ["game_date", "game"]), ["minutes"], [10]).result


@query(
    "wn_expanding_mean",
    "player:l game:l pts_mean:f6 minutes_mean:f6",
    f"""SELECT *, avg(pts) OVER (PARTITION BY player ORDER BY game_date, game {PRIOR}) AS pts_mean,
    avg(minutes) OVER (PARTITION BY player ORDER BY game_date, game {PRIOR}) AS minutes_mean FROM player_log""",
)
def expanding_mean(s: Shapes) -> DataFrame:
    log = entity_log(s.player_log(), ["player"], ["game_date", "game"])
    return wn.expanding_mean(wn.expanding_mean(log, F.col("pts"), "pts_mean"), F.col("minutes"), "minutes_mean").result


@query(
    "wn_cumulative",
    f"{KEY} cum_wins:l cum_losses:l cum_win_pct:f6",
    f"""SELECT *, coalesce(sum(win) {SEASON_W} {PRIOR}), 0) AS cum_wins,
    coalesce(sum(1 - win) {SEASON_W} {PRIOR}), 0) AS cum_losses,
    coalesce(avg(win) {SEASON_W} {PRIOR}), 0.5) AS cum_win_pct FROM contest_log""",
)
def cumulative(s: Shapes) -> DataFrame:
    return wn.cumulative_record(season_log(s), "win").result


def _split(flag: int) -> Column:
    return F.when(F.col("is_home") == flag, F.col("plus_minus"))


@query(
    "wn_conditional_expanding",
    f"{KEY} home_net:f6 away_net:f6",
    f"""SELECT *, coalesce(avg(CASE WHEN is_home = 1 THEN plus_minus END) {SEASON_W} {PRIOR}), 0) AS home_net,
    coalesce(avg(CASE WHEN is_home = 0 THEN plus_minus END) {SEASON_W} {PRIOR}), 0) AS away_net FROM contest_log""",
)
def conditional_expanding(s: Shapes) -> DataFrame:
    home = wn.expanding_mean(season_log(s), _split(1), "home_net", fill=0.0)
    return wn.expanding_mean(home, _split(0), "away_net", fill=0.0).result


@query(
    "wn_slope",
    f"{KEY} net_rating_trend_5:f6",
    f"""SELECT *, CASE WHEN count(*) {W} {rows(5)}) >= 2
    THEN regr_slope(plus_minus, n) {W} {rows(5)}) ELSE 0 END AS net_rating_trend_5
    FROM (SELECT *, row_number() {W}) AS n FROM contest_log)""",
)
def slope(s: Shapes) -> DataFrame:
    return wn.slope(team_log(s), "plus_minus", "net_rating_trend_5").result


# Runs by the classic difference of two row numbers, then shifted by one row.
_RUNS = f"""SELECT *, CASE WHEN win = 1 THEN 1 ELSE -1 END
    * row_number() OVER (PARTITION BY team, season, win, island ORDER BY game_date, game) AS run
    FROM (SELECT *, row_number() {SEASON_W})
      - row_number() OVER (PARTITION BY team, season, win ORDER BY game_date, game) AS island FROM contest_log)"""


@query(
    "wn_streak",
    f"{KEY} streak:l",
    f"SELECT *, coalesce(lag(run) {SEASON_W}), 0) AS streak FROM ({_RUNS})",
)
def streak(s: Shapes) -> DataFrame:
    return wn.streak(season_log(s), "win").result


@query(
    "wn_current_streak",
    "team:i season:i streak:l home_streak:l away_streak:l text:s",
    """SELECT t.team, t.season, t.streak, h.streak AS home_streak, a.streak AS away_streak,
    CASE WHEN t.streak > 0 THEN concat('+', CAST(t.streak AS VARCHAR)) ELSE CAST(t.streak AS VARCHAR) END AS text
    FROM streaks_all t LEFT JOIN streaks_home h ON t.team = h.team AND t.season = h.season
    LEFT JOIN streaks_away a ON t.team = a.team AND t.season = a.season""",
)
def current_streak(s: Shapes) -> DataFrame:
    games = s.contest_log()

    def ending(part: DataFrame, name: str) -> DataFrame:
        log = entity_log(part, ["team", "season"], ["game_date", "game"])
        return wn.run_at_end(log, "win").withColumnRenamed("streak", name)

    overall = ending(games, "streak")
    home = ending(games.filter("is_home = 1"), "home_streak")
    away = ending(games.filter("is_home = 0"), "away_streak")
    signed = F.when(F.col("streak") > 0, F.concat(F.lit("+"), F.col("streak").cast("string")))
    return (
        overall.join(home, ["team", "season"], "left")
        .join(away, ["team", "season"], "left")
        .withColumn("text", F.coalesce(signed, F.col("streak").cast("string")))
    )


def _ending_sql(condition: str) -> str:
    return f"""SELECT team, season, (CASE WHEN max_by(win, n) = 1 THEN 1 ELSE -1 END)
    * (max(n) - CASE WHEN max_by(win, n) = 1 THEN coalesce(max(n) FILTER (WHERE win = 0), 0)
       ELSE coalesce(max(n) FILTER (WHERE win = 1), 0) END) AS streak
    FROM (SELECT *, row_number() {SEASON_W}) AS n FROM contest_log WHERE {condition}) GROUP BY team, season"""


SHARED_SQL["streaks_all"] = _ending_sql("true")
SHARED_SQL["streaks_home"] = _ending_sql("is_home = 1")
SHARED_SQL["streaks_away"] = _ending_sql("is_home = 0")


@query(
    "wn_best_streak",
    "team:i best_streak:l best_end:d current_streak:l",
    f"""SELECT team, coalesce(max(run) FILTER (WHERE run > 0), 0) AS best_streak,
    arg_max(game_date, run * 1000000 - n) FILTER (WHERE run > 0) AS best_end, max_by(run, n) AS current_streak
    FROM (SELECT *, row_number() {W}) AS n, (CASE WHEN win = 1 THEN 1 ELSE -1 END)
      * row_number() OVER (PARTITION BY team, win, island ORDER BY game_date, game) AS run
      FROM (SELECT *, row_number() {W}) - row_number() OVER (PARTITION BY team, win ORDER BY game_date, game) AS island
        FROM contest_log)) GROUP BY team""",
)
def best_streak(s: Shapes) -> DataFrame:
    return wn.best_run(team_log(s), "win", "game_date")


@query(
    "wn_days_since",
    f"{KEY} days_rest:i is_back_to_back:i",
    f"""SELECT *, CAST(days_rest <= 1 AS INT) AS is_back_to_back FROM
    (SELECT *, least(coalesce(date_diff('day', lag(game_date) {W}), game_date), 7), 14) AS days_rest FROM contest_log)""",
)
def days_since(s: Shapes) -> DataFrame:
    return wn.days_since(team_log(s), "game_date").result


@query(
    "wn_calendar_count",
    f"{KEY} rows_last_5_days:l rows_last_7_days:l",
    f"""SELECT a.team, a.game_date, a.game, a.n - coalesce(b5, a.first_n) AS rows_last_5_days,
      a.n - coalesce(b7, a.first_n) AS rows_last_7_days FROM
    (SELECT *, row_number() {W}) AS n, 1 AS first_n FROM contest_log) a LEFT JOIN
    (SELECT x.team, x.game_date, min(y.n) FILTER (WHERE y.game_date > x.game_date - 5) AS b5,
      min(y.n) FILTER (WHERE y.game_date > x.game_date - 7) AS b7
     FROM (SELECT DISTINCT team, game_date FROM contest_log) x
     JOIN (SELECT team, game_date, min(n) AS n FROM (SELECT team, game_date, row_number() {W}) AS n FROM contest_log)
           GROUP BY team, game_date) y
       ON x.team = y.team AND y.game_date <= x.game_date AND y.game_date > x.game_date - 7
     GROUP BY x.team, x.game_date) b ON a.team = b.team AND a.game_date = b.game_date""",
)
def calendar_count(s: Shapes) -> DataFrame:
    return wn.calendar_counts(s.contest_log(), ["team"], "game_date", ["game"], [5, 7])


# The place of a game is the home side's; coordinates and zones follow from the nation key.
_PLACE = {
    "lat": "CAST((n_nationkey * 37) % 100 - 50 AS DOUBLE)",
    "lon": "CAST((n_nationkey * 53) % 300 - 150 AS DOUBLE)",
    "zone": "CAST(n_nationkey % 4 AS INT)",
}


def places(s: Shapes) -> DataFrame:
    return s.nation.selectExpr("n_nationkey AS place", *[f"{e} AS {n}" for n, e in _PLACE.items()])


@query(
    "wn_lag_geo",
    f"{KEY} travel_miles:f4 zone_changed:i",
    f"""SELECT *, coalesce(2 * 3958.8 * asin(sqrt(pow(sin((radians(lat) - radians(la)) / 2), 2)
      + cos(radians(la)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lo)) / 2), 2))), 0) AS travel_miles,
      coalesce(CAST(z <> zone AS INT), 0) AS zone_changed
    FROM (SELECT *, lag(lat) {W}) AS la, lag(lon) {W}) AS lo, lag(zone) {W}) AS z
      FROM contest_log JOIN (SELECT n_nationkey AS place, {", ".join(f"{e} AS {n}" for n, e in _PLACE.items())} FROM nation)
      ON place = CASE WHEN is_home = 1 THEN team ELSE opp END)""",
)
def lag_geo(s: Shapes) -> DataFrame:
    games = s.contest_log().withColumn("place", F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opp")))
    log = entity_log(games.join(places(s), "place"), ["team"], ["game_date", "game"])
    return wn.travel(log, "lat", "lon", "zone").result


@query(
    "wn_lag_flag",
    f"{KEY} blowout_loss_last_game:i revenge_game:i",
    f"""SELECT *, coalesce(CAST(lag(plus_minus) {W}) <= -20 AS INT), 0) AS blowout_loss_last_game,
    coalesce(CAST(lag(win) OVER (PARTITION BY team, opp ORDER BY game_date, game) = 0 AS INT), 0) AS revenge_game
    FROM contest_log""",
)
def lag_flag(s: Shapes) -> DataFrame:
    blown = wn.previous_flag(team_log(s), F.col("plus_minus") <= -20, "blowout_loss_last_game").result
    pairs = entity_log(blown, ["team", "opp"], ["game_date", "game"])
    return wn.previous_flag(pairs, F.col("win") == 0, "revenge_game").result


@query(
    "wn_sequence_number",
    f"{KEY} season_game_num:l career_game_num:l",
    f"SELECT *, row_number() {SEASON_W}) - 1 AS season_game_num, row_number() {W}) AS career_game_num FROM contest_log",
)
def sequence_number(s: Shapes) -> DataFrame:
    numbered = season_log(s).numbered("season_game_num", start=0)
    return entity_log(numbered, ["team"], ["game_date", "game"]).numbered("career_game_num")


@query(
    "wn_form_delta",
    "player:l game:l pts_form:f6 pts_per_minute:f6",
    f"""SELECT *, p5 - p20 AS pts_form, CASE WHEN m10 > 0 THEN p10 / m10 END AS pts_per_minute FROM (SELECT *,
    avg(pts) OVER (PARTITION BY player ORDER BY game_date, game {rows(5)}) AS p5,
    avg(pts) OVER (PARTITION BY player ORDER BY game_date, game {rows(10)}) AS p10,
    avg(pts) OVER (PARTITION BY player ORDER BY game_date, game {rows(20)}) AS p20,
    avg(minutes) OVER (PARTITION BY player ORDER BY game_date, game {rows(10)}) AS m10 FROM player_log)""",
)
def form_delta(s: Shapes) -> DataFrame:
    log = entity_log(s.player_log(), ["player"], ["game_date", "game"])
    means = wn.lag_mean(log, ["pts", "minutes"], [5, 10, 20]).result
    return means.withColumns({
        "pts_form": F.col("pts_roll5") - F.col("pts_roll20"),
        "pts_per_minute": F.try_divide("pts_roll10", "minutes_roll10"),
    })


@query(
    "wn_standings_asof",
    "season:i conference:i team:i game_date:d rate:f6 position:l entities:l close_race:i",
    f"""WITH paced AS (SELECT season, n_regionkey AS conference, team, game_date, game,
        coalesce(avg(win) {SEASON_W} {PRIOR}), 0.5) AS rate
      FROM contest_log JOIN nation ON team = n_nationkey),
    daily AS (SELECT season, conference, team, game_date, max_by(rate, game) AS rate FROM paced GROUP BY ALL),
    grid AS (SELECT d.season, d.conference, d.game_date, e.team, max_by(e.rate, e.game_date) AS rate
      FROM (SELECT DISTINCT season, conference, game_date FROM daily) d
      JOIN daily e ON d.season = e.season AND d.conference = e.conference AND e.game_date <= d.game_date
      GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY season, conference, game_date ORDER BY rate DESC, team) AS position,
      count(*) OVER (PARTITION BY season, conference, game_date) AS entities FROM grid)
    SELECT r.*, CASE WHEN entities >= 4 AND (abs(position - 2) <= 1 OR (entities >= 5 AND abs(position - 5) <= 1))
      THEN 1 ELSE 0 END AS close_race
    FROM ranked r SEMI JOIN daily d ON r.season = d.season AND r.team = d.team AND r.game_date = d.game_date""",
)
def standings_asof(s: Shapes) -> DataFrame:
    paced = wn.cumulative_record(season_log(s), "win").result
    conferences = s.nation.selectExpr("n_nationkey AS team", "n_regionkey AS conference")
    # Five entities per group here, so the seats are 2 and 5 instead of 6 and 10.
    return wn.standings_as_of(
        paced.join(conferences, "team"), "team", ["season", "conference"], "game_date", ["game"], "cum_win_pct",
        seats=(2, 5), within=1, min_entities=4,
    )


@query(
    "wn_running_accuracy",
    "game_date:d graded:l correct:l accuracy:f6 running_accuracy:f6 last7_accuracy:f6",
    """SELECT *, correct / graded AS accuracy,
    sum(correct) OVER (ORDER BY game_date) / sum(graded) OVER (ORDER BY game_date) AS running_accuracy,
    sum(correct) OVER (ORDER BY game_date ROWS 6 PRECEDING) / sum(graded) OVER (ORDER BY game_date ROWS 6 PRECEDING) AS last7_accuracy
    FROM (SELECT game_date, count(*) AS graded,
      sum(CAST((p_home >= 0.5) = (home_win = 1) AS INT)) AS correct FROM predictions GROUP BY game_date)""",
)
def running_accuracy(s: Shapes) -> DataFrame:
    return daily_accuracy(s.predictions(), "game_date", (F.col("p_home") >= 0.5) == (F.col("home_win") == 1))


@query(
    "wn_drawdown",
    f"{KEY} running_profit:f6 drawdown:f6",
    f"""SELECT *, running_profit - max(running_profit) {W} ROWS UNBOUNDED PRECEDING) AS drawdown FROM
    (SELECT *, sum(CASE WHEN win = 1 THEN 0.875 ELSE -1 END) {W} ROWS UNBOUNDED PRECEDING) AS running_profit FROM contest_log)""",
)
def drawdown(s: Shapes) -> DataFrame:
    bets = s.contest_log().withColumn("profit", F.when(F.col("win") == 1, 0.875).otherwise(-1.0))
    return wn.drawdown(entity_log(bets, ["team"], ["game_date", "game"]), "profit").result


@query(
    "wn_rank_delta",
    "team:i score_now:f6 score_before:f6 rank_now:l rank_before:l rank_change:l trend:s",
    f"""SELECT *, rank_before - rank_now AS rank_change, CASE WHEN score_now - score_before > 1 THEN 'up'
      WHEN score_now - score_before < -1 THEN 'down' ELSE 'same' END AS trend FROM
    (SELECT *, row_number() OVER (ORDER BY score_now DESC NULLS LAST, team) AS rank_now,
      row_number() OVER (ORDER BY score_before DESC NULLS LAST, team) AS rank_before FROM
     (SELECT team, max(m) FILTER (WHERE n = 1) AS score_now, max(m) FILTER (WHERE n = 11) AS score_before FROM
       (SELECT team, avg(plus_minus) {W} {rows(10)}) AS m,
          row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game DESC) AS n FROM contest_log)
      GROUP BY team))""",
)
def rank_delta(s: Shapes) -> DataFrame:
    rolled = wn.lag_mean(team_log(s), ["plus_minus"], [10]).result
    return wn.rank_then_and_now(rolled, "team", ["game_date", "game"], F.col("plus_minus_roll10"))


@query(
    "wn_downsample",
    f"{KEY} pts:i",
    f"""SELECT * FROM (SELECT *, row_number() {W}) - 1 AS n, count(*) OVER (PARTITION BY team) AS size FROM contest_log)
    WHERE n % 3 = 0 OR n = size - 1""",
)
def downsample(s: Shapes) -> DataFrame:
    return wn.downsample(team_log(s))


@query(
    "wn_open_latest",
    "entity:l day:d opening:f6 latest:f6 snapshots:l move:f6 reverse_move:i",
    """SELECT *, latest - opening AS move, CAST(CASE WHEN opening < 0 THEN latest - opening >= 0.5
      WHEN opening > 0 THEN latest - opening <= -0.5 ELSE false END AS INT) AS reverse_move FROM
    (SELECT entity, day, arg_min(quote, ts) AS opening, arg_max(quote, ts) AS latest, count(*) AS snapshots
     FROM event_log WHERE quote IS NOT NULL GROUP BY entity, day)""",
)
def open_latest(s: Shapes) -> DataFrame:
    return wn.open_and_latest(s.log(), ["entity", "day"], "quote", "ts")
