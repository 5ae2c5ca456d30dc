"""Blocks of days against the plain windows, on the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelframe.operators import days, windows as wn
from duelframe.operators.ordered import EntityLog
from duelframe.plans import features as ft, queries_features as qf
from duelframe.plans.queries_windows import places
from duelframe.plans.shapes import Shapes

FOLDER = "/root/testdata/sf0.001"
RACE = {"seats": (2, 5), "within": 1, "min_entities": 4}


def both_ways(spark, monkeypatch, block_rows):
    monkeypatch.setattr(days, "HALO_SHARE", 0)
    s = Shapes(spark, FOLDER)
    groups = s.nation.selectExpr("n_nationkey AS team", "n_regionkey AS conference")
    plain = ft.team_features(s.contest_log(), places(s), groups, RACE, slice_rows=10**9)
    return plain, ft.team_features(s.contest_log(), places(s), groups, RACE, block_rows=block_rows)


def test_blocks_of_days_give_the_rows_of_plain_windows(spark, monkeypatch):
    # a team has 12 rows in a block of 300, fewer than any window needs: halos come from many blocks
    plain, dealt = both_ways(spark, monkeypatch, 300)
    assert days.BLOCK in dealt.columns and days.BLOCK not in plain.columns
    assert dealt.agg(F.count_distinct(days.BLOCK)).first()[0] > 5
    names = [*ft.TEAM_FEATURES, "opp_cum_win_pct", "era"]
    rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("team", "game", *names).fillna(-1.0).collect())
    assert rounded(plain) == rounded(dealt)
    assert {c: t for c, t in dealt.dtypes if c != days.BLOCK} == dict(plain.dtypes)


def test_wide_rows_of_blocks_are_not_shuffled(spark, monkeypatch):
    _, dealt = both_ways(spark, monkeypatch, 300)
    text = ft.contest_features(dealt)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert len(shuffles) == 1 and "REPARTITION" in shuffles[0]


def test_contests_with_every_dimension_do_not_depend_on_blocks(spark, monkeypatch):
    plain = sorted(map(str, entry.queries()["rp_contest_dimensions"](spark, FOLDER).collect()))
    monkeypatch.setattr(days, "HALO_SHARE", 0)
    monkeypatch.setattr(days, "BLOCK_ROWS", 300)
    assert sorted(map(str, entry.queries()["rp_contest_dimensions"](spark, FOLDER).collect())) == plain
    assert days.BLOCK in qf.team_features(Shapes(spark, FOLDER)).columns


def test_logs_that_blocks_do_not_suit_are_taken_by_team(spark):
    rows = [(t, f"2024-01-{d:02d}", d, 1) for d in range(1, 21) for t in range(3)]
    log = spark.createDataFrame(rows, "team int, game_date string, game int, win int").withColumn("game_date", F.col("game_date").cast("date"))
    found = lambda df, **kw: days.day_blocks(df, "team", "game_date", ["win"], **({"look_back": 1, "block_rows": 15} | kw))
    assert found(log).blocks == 4
    assert found(log, block_rows=30) is None and found(log, look_back=2) is None
    assert found(log.withColumn("win", F.when(F.col("game") != 7, F.col("win")))) is None
    assert found(log.withColumn("game_date", F.lit("2024-01-01").cast("date")), block_rows=5) is None


def test_means_of_doubled_windows_are_those_of_plain_ones(spark):
    rows = spark.range(400).selectExpr(
        "CAST(id % 3 AS INT) AS team", "id AS game", "CAST(id * 37 % 101 AS INT) AS a", "CASE WHEN id % 5 < 2 THEN NULL ELSE id * 13 % 29 / 7D END AS b",
        "CASE WHEN id = 200 THEN double('NaN') WHEN id = 300 THEN double('Infinity') ELSE id / 3D END AS c", "CAST(NULL AS DOUBLE) AS d")
    names = ["a", "b", "c", "d"]
    log = EntityLog(rows, ("team",), ("game",))
    plain = wn.lag_mean(log, names, [5, 10, 20]).result
    stacked = wn.stacked_means(log.lagged_log(5, lambda w: wn.stack_parts(w, names, 5)), names, 5, 2).result
    assert sorted(plain.columns) == sorted(stacked.columns)
    columns = sorted(plain.columns)
    rounded = lambda df: [[str(round(v, 9)) if isinstance(v, float) else v for v in r] for r in df.select(columns).orderBy("game").collect()]
    assert rounded(plain) == rounded(stacked)
