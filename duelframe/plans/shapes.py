"""Views of the driver tables in the shapes the operators work on.

Each shape is one Spark DataFrame and one SQL common table expression with the
same columns. The scalar expressions are written once, in the part of SQL that
Spark and the checking engine share; what the operators do with the shapes is
written independently in each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators.topk import first_row

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Contest rows from orders and customers: the customer's nation is at home.
_CONTEST = {
    "game": "o_orderkey",
    "game_date": "CAST(o_orderdate AS DATE)",
    "season": "CAST(CASE WHEN month(o_orderdate) >= 10"
    " THEN year(o_orderdate) * 100 + (year(o_orderdate) + 1) % 100"
    " ELSE (year(o_orderdate) - 1) * 100 + year(o_orderdate) % 100 END AS INT)",
    "home": "c_nationkey",
    "away": "CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT)",
    "home_pts": "CAST(80 + CAST(floor(o_totalprice) AS BIGINT) % 61 AS INT)",
    "away_pts": "CAST(80 + o_custkey % 61 AS INT)",
    "player": "o_custkey",
    "price": "o_totalprice",
    "priority": "o_orderpriority",
    "status": "o_orderstatus",
}

# Team columns of one side of a contest; {t} is the team, {o} the other side.
_SIDE = {
    "team": "{t}",
    "opp": "{o}",
    "pts": "{t}_pts",
    "opp_pts": "{o}_pts",
    "plus_minus": "{t}_pts - {o}_pts",
    "matchup": "concat('T', lpad(CAST({t} AS VARCHAR(2)), 2, '0'), '{sep}', 'T', lpad(CAST({o} AS VARCHAR(2)), 2, '0'))",
    "fga": "CAST(70 + (game * 7 + {t}) % 31 AS INT)",
    "fgm": "CAST(25 + (game + 3 * {t}) % 20 AS INT)",
    "fg3m": "CAST((game + {t}) % 15 AS INT)",
    "fg3a": "CAST((game + {t}) % 15 + 3 + game % 20 AS INT)",
    "fta": "CAST(10 + (game * 3 + {t}) % 25 AS INT)",
    "oreb": "CAST((game * 5 + {t}) % 16 AS INT)",
    "dreb": "CAST(20 + (game + 2 * {t}) % 25 AS INT)",
    "tov": "CAST(5 + (game * 11 + {t}) % 15 AS INT)",
}

_PLAYER = {
    "player": "player",
    "team": "home",
    "opp": "away",
    "game": "game",
    "game_date": "game_date",
    "season": "season",
    "minutes": "CAST(CASE WHEN game % 13 = 0 THEN NULL ELSE 4 + game % 37 END AS DOUBLE)",
    "pts": "CAST(CAST(floor(price / 1000) AS BIGINT) % 41 AS INT)",
    "reb": "CAST(game % 15 AS INT)",
    "ast": "CAST((game * 7) % 12 AS INT)",
    "fg3m": "CAST((game * 5) % 7 AS INT)",
    "fga": "CAST(5 + (game * 3) % 21 AS INT)",
    "fta": "CAST((game * 11) % 10 AS INT)",
    "tov": "CAST((game * 13) % 6 AS INT)",
}

_ODDS = {
    "home_ml": "CAST(CASE WHEN game % 2 = 0 THEN -(100 + game % 200) ELSE 100 + game % 200 END AS INT)",
    "away_ml": "CAST(CASE WHEN game % 2 = 0 THEN 120 + game % 200 ELSE -(120 + game % 200) END AS INT)",
    "spread": "(game % 41 - 20) / 2.0D",
    "close_spread": "CASE WHEN game % 11 = 0 THEN NULL ELSE ((game * 3) % 41 - 20) / 2.0D END",
    "total": "200 + (game % 61) / 2.0D",
}

_PREDICTION = {
    "id": "game * 3 + copy",
    "game": "game",
    "game_date": "game_date",
    "season": "season",
    "home": "home",
    "away": "away",
    "hours_ahead": "CAST(1 + (game * 7 + copy * 5) % 47 AS INT)",
    "model": "CASE WHEN (game + copy) % 3 = 0 THEN 'gbt' ELSE 'logit' END",
    "p_home": "((game * 37 + copy * 11) % 97 + 2) / 101.0D",
    "margin": "((game * 53 + copy * 7) % 301 - 150) / 10.0D",
    "home_win": "CAST(CASE WHEN home_pts >= away_pts THEN 1 ELSE 0 END AS INT)",
}

_LOG = {
    "entity": "user_id",
    "event": "event_id",
    "ts": "CAST(ts AS TIMESTAMP)",
    "day": "CAST(ts AS DATE)",
    "kind": "event_type",
    "value": "value",
    "flag": "CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS INT)",
    "quote": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE round(value) / 2.0D - 100 END",
}

_LINEUP = {
    "season": "CAST(year(l_shipdate) AS INT)",
    "team": "l_suppkey",
    "member": "l_partkey",
    "gp": "CAST(l_quantity AS INT)",
    "minutes": "l_extendedprice / 100",
    "off_rating": "90 + l_discount * 300 + CAST(l_partkey % 17 AS DOUBLE)",
    "def_rating": "90 + l_tax * 300 + CAST(l_suppkey % 11 AS DOUBLE)",
    "line": "l_linenumber",
    "order_key": "l_orderkey",
}

_CREW = {
    "game": "game",
    "game_date": "game_date",
    "home": "home",
    "away": "away",
    "slot_1": "concat('R', CAST(game % 70 AS VARCHAR(4)))",
    "slot_2": "CASE WHEN game % 5 = 0 THEN NULL ELSE concat('R', CAST((game + 7) % 70 AS VARCHAR(4))) END",
    "slot_3": "CASE WHEN game % 7 = 0 THEN ' ' ELSE concat('R', CAST((game * 3 + 11) % 70 AS VARCHAR(4))) END",
}


def _spark_list(columns: dict[str, str]) -> list[str]:
    return [f"{_spark(e)} AS {n}" for n, e in columns.items()]


def _spark(expression: str) -> str:
    return re.sub(r"VARCHAR\(\d+\)", "STRING", expression)


def _sql_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{_sql(e)} AS {n}" for n, e in columns.items())


def _sql(expression: str) -> str:
    return re.sub(r"\b(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", expression)


def _side(team: str, other: str, sep: str) -> dict[str, str]:
    return {n: e.format(t=team, o=other, sep=sep) for n, e in _SIDE.items()}


_HOME, _AWAY = _side("home", "away", " vs. "), _side("away", "home", " @ ")


class Shapes:
    """The driver tables of one folder, raw and shaped."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def contest(self) -> DataFrame:
        """One row per game with both scores."""
        owner = self.customer.select("c_custkey", "c_nationkey")
        return self.orders.join(owner, F.col("o_custkey") == F.col("c_custkey")).selectExpr(*_spark_list(_CONTEST))

    def contest_log(self) -> DataFrame:
        """Two rows per game, one for each side, from a single pass over the games."""
        sides = [
            "struct(" + ", ".join([f"{flag} AS is_home", f"{won} AS win", *_spark_list(side)]) + ")"
            for flag, won, side in [
                (1, "CAST(home_pts >= away_pts AS INT)", _HOME),
                (0, "CAST(home_pts < away_pts AS INT)", _AWAY),
            ]
        ]
        return (
            self.contest()
            .selectExpr("game", "game_date", "season", f"explode(array({', '.join(sides)})) AS side")
            .select("game", "game_date", "season", "side.*")
        )

    def player_log(self) -> DataFrame:
        """One row per player and game."""
        return self.contest().selectExpr(*_spark_list(_PLAYER))

    def odds(self) -> DataFrame:
        """Market quotes, one row per (date, home, away)."""
        quotes = self.contest().selectExpr("game_date", "home", "away", "game", *_spark_list(_ODDS))
        return first_row(quotes, ["game_date", "home", "away"], ["game"]).drop("game")

    def predictions(self) -> DataFrame:
        """Model output; every third game was predicted twice."""
        copies = "explode(CASE WHEN game % 3 = 0 THEN array(0, 1) ELSE array(0) END) AS copy"
        return (
            self.contest()
            .selectExpr("*", copies)
            .selectExpr(*_spark_list(_PREDICTION))
        )

    def log(self) -> DataFrame:
        """Events as a generic entity log."""
        return self.events.selectExpr(*_spark_list(_LOG))

    def lineups(self) -> DataFrame:
        """Line items as lineup rows per (season, team)."""
        return self.lineitem.selectExpr(*_spark_list(_LINEUP))

    def crew(self) -> DataFrame:
        """Three officials per game in wide slots, some empty."""
        return self.contest().selectExpr(*_spark_list(_CREW))


CTES: dict[str, str] = {
    "contest": f"SELECT {_sql_list(_CONTEST)} FROM orders JOIN customer ON o_custkey = c_custkey",
    "contest_log": f"SELECT game, game_date, season, 1 AS is_home, CAST(home_pts >= away_pts AS INT) AS win, {_sql_list(_HOME)}"
    " FROM contest UNION ALL"
    f" SELECT game, game_date, season, 0, CAST(home_pts < away_pts AS INT), {_sql_list(_AWAY)} FROM contest",
    "player_log": f"SELECT {_sql_list(_PLAYER)} FROM contest",
    "odds": "SELECT * EXCLUDE (game, rn) FROM (SELECT game_date, home, away, game, "
    f"{_sql_list(_ODDS)}, row_number() OVER (PARTITION BY game_date, home, away ORDER BY game) AS rn FROM contest)"
    " WHERE rn = 1",
    "predictions": f"SELECT {_sql_list(_PREDICTION)} FROM"
    " (SELECT *, 0 AS copy FROM contest UNION ALL SELECT *, 1 AS copy FROM contest WHERE game % 3 = 0)",
    "event_log": f"SELECT {_sql_list(_LOG)} FROM events",
    "lineups": f"SELECT {_sql_list(_LINEUP)} FROM lineitem",
    "crew": f"SELECT {_sql_list(_CREW)} FROM contest",
}


def with_shapes(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the common table expressions it mentions, in order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text) and definition is not text:
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body

    return "WITH " + ", ".join(f"{n} AS ({known[n]})" for n in needed) + " " + body
