"""Queries written in SQL over the registered functions, with checking SQL that spells them out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duelframe.plans.queries_windows import KEY, W, _ewma_sql, rows
from duelframe.plans.registry import query
from duelframe.plans.shapes import Shapes
from duelframe.sqlsurface import register


@query(
    "sql_lag_mean",
    f"{KEY} pts_roll5:f6 plus_minus_roll5:f6 pts_roll20:f6",
    f"SELECT *, avg(pts) {W} {rows(5)}) AS pts_roll5, avg(plus_minus) {W} {rows(5)}) AS plus_minus_roll5, avg(pts) {W} {rows(20)}) AS pts_roll20 FROM contest_log",
)
def lag_mean(s: Shapes) -> DataFrame:
    register(s.spark)
    log = s.contest_log().select("team", "game_date", "game", "pts", "plus_minus")
    return s.spark.sql("SELECT * FROM lag_mean(TABLE({log}), 'team', 'game_date, game', 'pts, plus_minus', '5, 20')", log=log)


@query("sql_ewma", "player:l game:l minutes_ewma10:f6", _ewma_sql("player_log", "player", "minutes", 10))
def ewma(s: Shapes) -> DataFrame:
    register(s.spark)
    log = s.player_log().select("player", "game_date", "game", "minutes")
    return s.spark.sql("SELECT * FROM ewma(TABLE({log}), 'player', 'game_date, game', 'minutes', '10')", log=log)


@query(
    "sql_scalars",
    "game_date:d home:i away:i price:f6 implied:f6 fair:f6 value:f6 stake:f6",
    """SELECT *, greatest(0, least(0.05, 0.5 * (0.6 * (1 - fair) / fair - 0.4) / ((1 - fair) / fair))) AS stake, 0.6 / fair - 1 AS value FROM
      (SELECT *, implied / (implied + other) AS fair FROM (SELECT game_date, home, away,
        CASE WHEN home_ml >= 100 THEN home_ml / 100 + 1 ELSE 100 / abs(home_ml) + 1 END AS price,
        CASE WHEN home_ml >= 100 THEN 100 / (home_ml + 100) ELSE abs(home_ml) / (abs(home_ml) + 100) END AS implied,
        CASE WHEN away_ml >= 100 THEN 100 / (away_ml + 100) ELSE abs(away_ml) / (abs(away_ml) + 100) END AS other FROM odds))""",
)
def scalars(s: Shapes) -> DataFrame:
    register(s.spark)
    return s.spark.sql(
        """SELECT game_date, home, away, decimal_odds(home_ml) AS price, implied_probability(home_ml) AS implied, no_vig_home(home_ml, away_ml) AS fair,
        expected_value(0.6D, no_vig_home(home_ml, away_ml)) AS value, kelly_stake(0.6D, no_vig_home(home_ml, away_ml), true) AS stake FROM {odds}""",
        odds=s.odds(),
    )
