"""SQL functions against the DataFrame operators they stand for."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from duelframe.functions import market
from duelframe.operators import windows as wn
from duelframe.operators.ordered import entity_log
from duelframe.sqlsurface import register


@pytest.fixture
def log(spark):
    register(spark)
    rows = [(("a", "b", None)[i % 3], 100 - i // 2, i, None if i % 5 == 0 else float(i % 7), i % 4) for i in range(120)]
    df = spark.createDataFrame(rows + [("c", None, 900, 1.0, 1)], "team string, day int, game int, pts double, won int")
    df.createOrReplaceTempView("team_log")
    return df


def test_table_functions_like_operators(spark, log):
    want = wn.ewma(wn.lag_mean(entity_log(log, ["team"], ["day", "game"]), ["pts", "won"], [3, 8]), ["pts"], [4]).result
    got = spark.sql("SELECT * FROM lag_mean(TABLE(team_log), 'team', 'day,game', 'pts, won', '3, 8')")
    assert got.columns == [*log.columns, "pts_roll3", "won_roll3", "pts_roll8", "won_roll8"]
    decay = spark.sql("SELECT game, pts_ewma4 FROM ewma(TABLE(SELECT * FROM team_log), 'team', 'day, game', 'pts', '4')")
    close = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    expected = {r["game"]: r for r in want.collect()}
    for r in got.collect():
        assert all(close(r[c], expected[r["game"]][c]) for c in ("pts_roll3", "won_roll3", "pts_roll8", "won_roll8")), r
    assert all(close(r["pts_ewma4"], expected[r["game"]]["pts_ewma4"]) for r in decay.collect())


def test_wrong_calls_are_told(spark, log):
    with pytest.raises(AnalysisException, match="no column points"):
        spark.sql("SELECT * FROM lag_mean(TABLE(team_log), 'team', 'day', 'points', '3')")
    with pytest.raises(AnalysisException, match="names with commas"):
        spark.sql("SELECT * FROM ewma(TABLE(team_log), '', 'day', 'pts', '3')")


def test_empty_table(spark, log):
    assert spark.sql("SELECT * FROM lag_mean(TABLE(SELECT * FROM team_log WHERE game < 0), 'team', 'day', 'pts', '3')").count() == 0


def test_scalars_are_the_expressions(spark, log):
    odds = spark.createDataFrame([(150.0, -170.0), (-110.0, -110.0), (0.0, 120.0), (None, 5.0)], "h double, a double")
    got = odds.selectExpr("implied_probability(h) AS p", "no_vig_home(h, a) AS q", "confidence_tier(0.05, true) AS t", "kelly_stake(0.6, 0.5, true) AS k", "great_circle_miles(0, 0, 0, 1) AS m")
    want = odds.select(market.implied_probability(F.col("h")).alias("p"), market.no_vig(F.col("h"), F.col("a"))[0].alias("q"))
    assert [(r["p"], r["q"]) for r in got.collect()] == [(r["p"], r["q"]) for r in want.collect()]
    assert got.first()["t"] == "Solid Pick" and got.first()["k"] == 0.05 and abs(got.first()["m"] - 69.09) < 0.1
    assert "PythonUDF" not in got._jdf.queryExecution().toString()
