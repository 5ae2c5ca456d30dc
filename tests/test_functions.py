from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from duelframe.functions import market, measures, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_odds(spark):
    got = one(spark, market.decimal_odds(F.lit(150)), market.decimal_odds(F.lit(-200)), market.decimal_odds(F.lit(0)),
              market.implied_probability(F.lit(150)), market.implied_probability(F.lit(-200)))
    assert got == (2.5, 1.5, None, pytest.approx(0.4), pytest.approx(2 / 3))


def test_no_vig_sums_to_one_and_needs_both(spark):
    home, away = market.no_vig(F.lit(-110), F.lit(-110))
    missing, _ = market.no_vig(F.lit(-110), F.lit(None).cast("int"))
    assert one(spark, home, away, missing) == (pytest.approx(0.5), pytest.approx(0.5), None)


def test_kelly(spark):
    p, q = F.lit(0.6), F.lit(0.5)
    got = one(spark, market.kelly(p, q, F.lit(True)), market.kelly(p, q, F.lit(True), cap=None), market.kelly(p, q, F.lit(False)),
              market.kelly(p, F.lit(1.0), F.lit(True)))
    assert got == (pytest.approx(0.05), pytest.approx(0.1), 0.0, 0.0)


@pytest.mark.parametrize(("edge", "agree", "tier"), [(0.08, True, "Best Bet"), (0.05, True, "Solid Pick"), (0.02, True, "Lean"),
                                                     (0.01, True, "Skip"), (0.2, False, "Skip")])
def test_tiers(spark, edge, agree, tier):
    assert one(spark, market.tier(F.lit(edge), F.lit(agree))) == (tier,)


def test_normal_cdf(spark):
    points = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = one(spark, *[market.normal_cdf(F.lit(x)) for x in points])
    for x, y in zip(points, got):
        assert y == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=2e-7)


def test_season_codes(spark):
    texts = ["2024-25", "2023-2024", "202425", "2008", "9596", "22024", "x"]
    got = one(spark, *[text.season_code(F.lit(t)) for t in texts])
    assert got == (202425, 202324, 202425, 200708, 209596, 202425, None)
    dates = one(spark, *[text.season_of_date(F.lit(d).cast("date")) for d in ("2024-10-01", "2025-04-01", "1999-12-31")])
    assert dates == (202425, 202425, 199900)


def test_parsing(spark):
    got = one(spark, text.is_home(F.lit("LAL vs. GSW")), text.opponent(F.lit("LAL vs. GSW")), text.opponent(F.lit("LAL @ BOS")),
              text.clock_minutes(F.lit("34:30")), text.iso_clock(F.lit("PT04M22.00S")), text.feet_inches(F.lit("6-6")),
              text.record_wins(F.lit("10-5")), text.record_losses(F.lit("bad")))
    assert got == (1, "GSW", "BOS", 34.5, "4:22", 78, 10, 0)


def test_pair_scores(spark):
    score = lambda a, b, better=True: one(spark, *measures.pair_scores(F.lit(a).cast("double"), F.lit(b).cast("double"), better))
    assert score(1, 2) == (20, 80)
    assert score(1, 2, False) == (80, 20)
    assert score(2, 2) == (50, 50)
    assert score(None, 2) == (40, 60)
    assert score(2, None) == (60, 40)
    assert score(None, 2, False) == (60, 40)
    assert score(None, None) == (50, 50)


def test_column_names():
    assert text.clean_name(" Player-ID ") == "player_id"
    assert text.clean_name("Home/Away") == "home_away"


def test_differences_change_sign_when_roles_swap(spark):
    df = spark.createDataFrame([(3.0, 5.0)], "home_x double, away_x double")
    swapped = df.select(F.col("away_x").alias("home_x"), F.col("home_x").alias("away_x"))
    a = measures.difference_block(df, ["x"]).first()["diff_x"]
    assert a == -measures.difference_block(swapped, ["x"]).first()["diff_x"] == -2.0
