from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelframe.operators import aggregates as ag, joins, ledger, quality, ratings, topk, windows as wn
from duelframe.operators.ordered import entity_log


def date(day: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=day)


def test_mean_of_the_rows_before(spark):
    df = spark.createDataFrame([("A", date(2 * i), i, v) for i, v in enumerate((100, 200, 300, 400, 500))], "team string, d date, g int, pts int")
    rows = wn.lag_mean(entity_log(df, ["team"], ["d", "g"]), ["pts"], [5]).result.orderBy("g").collect()
    assert [r["pts_roll5"] for r in rows] == [None, 100.0, 150.0, 200.0, 250.0]


def test_move_against_the_opening_favourite(spark):
    df = spark.createDataFrame([("g", dt.datetime(2024, 1, 1, 9), -5.5), ("g", dt.datetime(2024, 1, 1, 15), -4.5)], "game string, ts timestamp, spread double")
    row = wn.open_and_latest(df, ["game"], "spread", "ts").first()
    assert (row["move"], row["reverse_move"], row["snapshots"]) == (1.0, 1, 2)


def test_as_of_matches_pandas(spark):
    rng = random.Random(3)
    left = pd.DataFrame([(rng.randint(0, 2), pd.Timestamp(2024, 1, 1) + pd.Timedelta(hours=rng.randint(0, 200)), i) for i in range(80)], columns=["k", "t", "id"])
    right = pd.DataFrame([(rng.randint(0, 2), pd.Timestamp(2024, 1, 1) + pd.Timedelta(minutes=i * 97), i, float(i)) for i in range(120)], columns=["k", "t", "id", "v"])
    want = pd.merge_asof(left.sort_values("t"), right.drop(columns="id"), on="t", by="k").set_index("id")["v"]
    for rows in (None, 15):
        got = joins.as_of_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", "id", ["v"], rows)
        for r in got.collect():
            assert (r["v"] is None and np.isnan(want[r["id"]])) or r["v"] == want[r["id"]]


def test_validity_agrees_with_as_of(spark):
    rng = random.Random(5)
    status = [(p, 0, date(d), rng.random() < 0.7) for p in range(6) for d in sorted(rng.sample(range(90), 8))]
    days = [(0, date(d)) for d in sorted(rng.sample(range(95), 50))]
    df = spark.createDataFrame(status, "player int, team int, since date, ok boolean")
    dates = spark.createDataFrame(days, "team int, day date")
    got = {(r["player"], r["day"], r["since"]) for r in joins.valid_on(df, dates, ["player"], ["team"], "since", "day", 25, F.col("ok")).collect()}
    want = set()
    for p in range(6):
        mine = [s for s in status if s[0] == p]
        for _, day in days:
            earlier = [s for s in mine if s[2] <= day]
            if earlier:
                last = max(earlier, key=lambda s: s[2])
                if last[3] and 0 < (day - last[2]).days <= 25:
                    want.add((p, day, last[2]))
    assert got == want and got


def test_opponent_columns_keep_rows_without_another_side(spark):
    df = spark.createDataFrame([(1, "A", "B", 90), (1, "B", "A", 80), (2, "A", "C", 70), (None, "D", "E", 1), (None, "E", "D", 2)], "game int, team string, opp string, pts int")
    got = {(r["game"], r["team"], r["opp_pts"]) for r in joins.opponent_columns(df, ["game"], "team", "opp", ["pts"]).collect()}
    assert got == {(1, "A", 80), (1, "B", 90), (2, "A", None), (None, "D", None), (None, "E", None)}


def test_points_in_intervals(spark):
    points = spark.createDataFrame([(i,) for i in range(30)] + [(None,)], "x int")
    spells = spark.createDataFrame([(0, 4, "a"), (10, 14, "b"), (20, 20, "c"), (None, 3, "d")], "lo int, hi int, name string")
    got = [(r["x"], r["name"]) for r in joins.in_interval(points, "x", spells, "lo", "hi").select("x", "name").collect()]
    assert len(got) == 31 and (None, None) in got
    assert sorted(g for g in got if g[1]) == sorted([(i, "a") for i in range(5)] + [(i, "b") for i in range(10, 15)] + [(20, "c")])


def test_as_of_ignores_null_keys(spark):
    left = spark.createDataFrame([(1, 5, 1), (None, 5, 2)], "k int, t int, tie int")
    right = spark.createDataFrame([(1, 4, 1, "x"), (None, 4, 2, "y")], "k int, u int, tie int, v string")
    got = {(r["k"], r["v"]) for r in joins.as_of_backward(left, right, ["k"], "t", "u", "tie", ["v"]).collect()}
    assert got == {(1, "x"), (None, None)}


@pytest.mark.parametrize("rows", [None, 9])
def test_exact_quantile(spark, rows):
    rng = random.Random(7)
    data = [(k, float(rng.randint(0, 40))) for k in (0, 1) for _ in range(101 if k else 60)]
    df = spark.createDataFrame(data, "k int, v double")
    for q in (0.0, 0.25, 0.9, 1.0):
        for r in ag.quantile_by_rank(df, "v", F.lit(q), ["k"], rows).collect():
            assert r["quantile"] == pytest.approx(np.quantile([v for k, v in data if k == r["k"]], q))


def test_weight_grid_matches_direct_scores(spark):
    rng = np.random.default_rng(1)
    p, m, y = rng.uniform(0.05, 0.95, 200), rng.normal(0, 12, 200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(p, m, y)], "p double, m double, y int")
    for r in ag.weight_grid(df, "p", "m", "y").collect():
        blend = r["weight"] * p + (1 - r["weight"]) / (1 + np.exp(-m / r["scale"]))
        assert r["brier"] == pytest.approx(np.mean((blend - y) ** 2))


def test_bootstrap_covers_the_return(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 100 < 56, 100 / 110).otherwise(-1.0).alias("profit"))
    row = ag.bootstrap_roi(df, "profit", replicates=2000).first()
    assert row["ci_lower"] < row["mean_roi"] < row["ci_upper"]
    assert row["n_bets"] == 2000 and row["replicates"] == 2000
    assert 0.02 < row["ci_upper"] - row["ci_lower"] < 0.2


@pytest.mark.parametrize("distinct", [2, 1500])
def test_bootstrap_agrees_with_plain_resampling(spark, distinct):
    rng = np.random.default_rng(3)
    profit = np.round(rng.uniform(-1, 1.05, 1500), 4) if distinct > 2 else np.where(rng.random(1500) < 0.54, 0.9091, -1.0)
    df = spark.createDataFrame([(float(p),) for p in profit], "profit double")
    row = ag.bootstrap_roi(df, "profit", replicates=4000).first()
    drawn = profit[rng.integers(0, 1500, (4000, 1500))]
    plain = np.quantile(drawn.sum(axis=1) / np.abs(drawn).sum(axis=1), [0.025, 0.975])
    width = plain[1] - plain[0]
    assert abs(row["ci_lower"] - plain[0]) < 0.06 * width and abs(row["ci_upper"] - plain[1]) < 0.06 * width


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(n, k) for n in (1, 2, 7, 30, 400) for k in sorted({0, 1, n // 3, n // 2, n - 1, n})]
    df = spark.createDataFrame(cases, "n long, k long")
    for rate in (0.5, 0.524):
        got = df.withColumn("p", ag.binomial_tail(F.col("k"), F.col("n"), rate)).collect()
        for r in got:
            want = sum(comb(r["n"], i) * rate**i * (1 - rate) ** (r["n"] - i) for i in range(r["k"], r["n"] + 1))
            assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-14)


def test_walk_forward_without_bets(spark):
    df = spark.createDataFrame([(s, date(s), s, 0.5, 0.5, 1) for s in range(5)], "season int, d date, id int, p double, q double, y int")
    seasons = ag.walk_forward(df, "season", ["d", "id"], "p", "q", "y")
    total = ag.walk_forward_total(seasons).first()
    assert seasons.count() == 0 and total["roi"] == 0.0


def brute_elo(games):
    slow, fast, last, out = {}, {}, {}, {}
    for game, season, home, away, hp, ap in games:
        for team in (home, away):
            for table in (slow, fast):
                table.setdefault(team, 1500.0)
                if last.get(team, season) != season:
                    table[team] = 1500 + (table[team] - 1500) * 2 / 3
            last[team] = season
        out[game] = (slow[home], slow[away], fast[home], fast[away])
        for table, k in ((slow, 20), (fast, 40)):
            lead = table[home] + 100 - table[away]
            weight = np.log(abs(hp - ap) + 1) * 2.2 / (abs(lead) * 0.001 + 2.2) if hp != ap else 1.0
            move = k * weight * ((hp >= ap) - 1 / (1 + 10 ** (-lead / 400)))
            table[home] += move
            table[away] -= move
    return out


@pytest.mark.parametrize("chunk", [1000, 17])
def test_elo_against_a_loop(spark, chunk):
    rng = random.Random(11)
    games = []
    for i in range(60):
        home, away = rng.sample(range(6), 2)
        games.append((i, 1 + i // 25, home, away, rng.randint(80, 120), rng.randint(80, 120)))
    rows = [(lg, *g, date(g[0] // 3)) for lg in (0, 1) for g in games[: 60 if lg else 40]]
    df = spark.createDataFrame(rows, "league int, game int, season int, home int, away int, home_pts int, away_pts int, d date")
    want = {lg: brute_elo(games[: 60 if lg else 40]) for lg in (0, 1)}
    got = ratings.elo(df, ["d", "game"], chunk).collect()
    assert len(got) == 100
    for r in got:
        assert (r["home_elo"], r["away_elo"], r["home_elo_fast"], r["away_elo_fast"]) == pytest.approx(want[r["league"]][r["game"]])
    first = next(r for r in got if r["game"] == 0 and r["league"] == 0)
    assert (first["home_elo"], first["away_elo"]) == (1500.0, 1500.0)


def test_opening_line_is_logged_once_and_closing_set_once(spark):
    schema = "game_date date, home string, away string, opening_spread double, closing_spread double"
    old = spark.createDataFrame([(date(0), "A", "B", -3.5, None), (date(0), "C", "D", 1.0, 2.0), (date(40), "E", "F", 4.0, None)], schema)
    new = spark.createDataFrame([(date(0), "A", "B", -9.0, -5.5), (date(0), "C", "D", 9.0, 9.0), (date(40), "E", "F", 4.0, 6.0), (date(0), "G", "H", 2.0, 1.0)], schema)
    got = {r["home"]: (r["opening_spread"], r["closing_spread"], r["clv"]) for r in ledger.upsert_lines(old, new, F.lit(date(10))).collect()}
    assert got == {"A": (-3.5, -5.5, 2.0), "C": (1.0, 2.0, -1.0), "E": (4.0, None, None), "G": (2.0, 1.0, 1.0)}


def test_write_once_keeps_the_first(spark):
    store = spark.createDataFrame([("k1", 1)], "k string, n int")
    incoming = spark.createDataFrame([("k1", 0), ("k2", 5), ("k2", 3)], "k string, n int")
    assert [tuple(r) for r in ledger.write_once(store, incoming, ["k"], ["n"]).collect()] == [("k2", 3)]


def test_paged_array_keeps_all_rows(spark):
    df = spark.range(25).select((F.col("id") % 2).alias("k"), "id")
    pages = topk.paged_array(df, ["k"], ["id"], ["id"], "rows", page_rows=5).collect()
    assert sorted(x["id"] for p in pages for x in p["rows"]) == list(range(25))
    assert max(len(p["rows"]) for p in pages) == 5


def test_strict_stage_fails(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    checks = {"unique": lambda: quality.key_unique(df, ["k"], "t")}
    assert quality.run_stage("s", checks).first()["status"] == "FAIL"
    with pytest.raises(quality.QualityError):
        quality.run_stage("s", checks, strict=True)


def test_leaking_columns_are_refused(spark):
    with pytest.raises(ValueError, match="leak"):
        joins.forbid_columns(spark.createDataFrame([(1, 2)], "pts int, x int"), ["pts"])


def test_mostly_null_features_are_refused(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    with pytest.raises(quality.QualityError, match="b"):
        quality.guard_null_rates(df, ["a", "b"])


def test_folds_fall_back_to_the_last_rows(spark):
    from duelframe.operators import models as ml

    df = spark.range(100).select((F.col("id") % 2).cast("int").alias("season"), F.col("id").alias("game"))
    (train, valid), = ml.folds(df, "season", ml.expanding_splits([0, 1], 6))
    order = sorted((r["season"], r["game"]) for r in df.collect())
    assert sorted((r["season"], r["game"]) for r in train.collect()) == order[:85]
    assert sorted((r["season"], r["game"]) for r in valid.collect()) == order[85:]


def test_shuffled_is_a_permutation(spark):
    from duelframe.operators import models as ml

    df = spark.range(50).select("id", (F.col("id") * 10).alias("v"), F.lit(1).alias("w"))
    got = ml.shuffled(df, "id", "v").collect()
    assert sorted(r["v"] for r in got) == [i * 10 for i in range(50)] and sorted(r["id"] for r in got) == list(range(50))
    assert sum(r["v"] == r["id"] * 10 for r in got) < 10
