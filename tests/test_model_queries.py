"""Model queries on the smallest tables: what every answer has to satisfy, whatever was fitted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from duelframe.operators import models as ml
from duelframe.plans import queries_models as qm

FOLDER = "/root/testdata/sf0.001"


def answers(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, FOLDER).collect()]


@pytest.mark.parametrize("name", ["ml_outcome_classifier", "ml_cover_classifier", "ml_margin_regressor"])
def test_one_candidate_is_chosen_by_validation(spark, name):
    rows = answers(spark, name)
    assert len(rows) >= 3 and sum(r["chosen"] for r in rows) == 1
    chosen = next(r for r in rows if r["chosen"])
    assert chosen["validation"] == max(r["validation"] for r in rows)
    assert len({r["n"] for r in rows}) == 1 and rows[0]["n"] > 0
    if name == "ml_cover_classifier":
        assert chosen["calibrator"] in ("isotonic", "platt", "temperature", "raw") and 0 <= chosen["brier_calibrated"] <= 1


def test_pruning_keeps_some_features(spark):
    row = answers(spark, "ml_prune_refit")[0]
    assert row["features"] == len(qm.FEATURES) and 0 < row["kept"] <= row["features"]


def test_quantile_bands_are_in_order_for_all_statistics(spark):
    rows = answers(spark, "ml_quantile_band")
    assert {r["stat"] for r in rows} == {"pts", "reb", "ast", "fg3m"}
    assert all(0 <= r["p25"] <= r["p50"] <= r["p75"] for r in rows)
    assert all(0 <= r["pred_minutes"] <= 48 for r in rows)


def test_attributions_of_trees_are_exact(spark):
    rows = answers(spark, "ml_tree_attributions")
    assert {r["model"] for r in rows} == {"logistic", "forest", "boosted"} and all(r["exact"] == 1 for r in rows)
    assert len(rows) == 3 * len(qm.FEATURES)


def test_strong_bets_pass_the_gate(spark):
    for r in answers(spark, "ml_strong_bets"):
        assert abs(r["edge"]) > ml.STRONG_EDGE and r["composite_score"] > ml.STRONG_SCORE
        assert r["passes_cover"] == 1 and r["p_cover"] >= ml.COVER_GATE


def test_gate_without_a_cover_model(spark):
    bets = spark.createDataFrame([(1, 0.2, None), (2, 0.05, None), (3, -0.3, None)], "id int, edge double, p double")
    assert sorted(r["id"] for r in ml.strong_bets(bets, "edge", "p").collect()) == [1, 3]
    mixed = spark.createDataFrame([(1, 0.2, 0.6), (2, 0.2, 0.5), (3, 0.2, None)], "id int, edge double, p double")
    assert sorted(r["id"] for r in ml.strong_bets(mixed, "edge", "p").collect()) == [1, 3]


def test_the_calibrator_that_fits_is_chosen(spark):
    rows = spark.range(6000).select(
        ((F.pmod(F.xxhash64("id"), F.lit(1000)) + 0.5) / 1000).alias("p"), (F.pmod(F.xxhash64(F.col("id") + 9), F.lit(10_000)) / 10_000).alias("u"))
    # the true probability has half the log-odds: temperature 2
    true = 1 / (1 + F.exp(-F.log(F.col("p") / (1 - F.col("p"))) / 2))
    held = rows.select("p", (F.col("u") < true).cast("double").alias("y"))
    name, apply = ml.chosen_calibrator(held, "p", "y")
    assert name in ("temperature", "platt", "isotonic")
    before, after = apply(held).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)), F.avg(F.pow(F.col("calibrated") - F.col("y"), 2))).first()
    assert after < before
    one = held.where("y = 1")
    assert ml.chosen_calibrator(one, "p", "y")[0] == "raw"


def test_calibration_says_which(spark):
    rows = answers(spark, "ml_calibrate")
    assert sorted(r["method"] for r in rows) == ["isotonic", "platt", "raw", "temperature"]
    assert sum(r["chosen"] for r in rows) == 1


def test_importance_scores_all_features_at_once(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("id AS game", "CAST(id % 17 AS DOUBLE) AS a", "CAST(id * 7 % 23 AS DOUBLE) AS b", "CAST(id * 5 % 11 AS DOUBLE) AS c")
    df = rows.withColumn("label", (F.col("a") + F.pmod(F.xxhash64("game"), F.lit(9)) > 12).cast("double"))
    model = ml.fit(df, ["a", "b", "c"], qm.quick())
    base = ml.auc(model.transform(df), "label")
    want = {f: base - ml.auc(model.transform(ml.shuffled(df, "game", f)), "label") for f in ("a", "b", "c")}
    monkeypatch.setattr(ml, "auc", lambda *_: pytest.fail("a pass per feature"))
    got = {r["feature"]: r["drop"] for r in ml.permutation_importance(model, df, ["a", "b", "c"], "label", "game").collect()}
    assert got == pytest.approx(want, abs=1e-4) and got["a"] > 0.1


def test_player_regressors_where_no_player_has_enough_rows(spark):
    rows = answers(spark, "ml_player_regressors")
    assert sorted(r["stat"] for r in rows) == ["ast", "pts", "reb"]
    assert all(r["model"] is None and r["n"] == 0 for r in rows)


def test_rows_of_players_are_joined_once_for_all_fits(spark, monkeypatch):
    """What the fits read is a stored table, however large the table of players is."""
    rows = [(p, 100 * p + g, 2000 + g // 8, float(g), float((p * g) % 7)) for p in range(6) for g in range(24)]
    df = spark.createDataFrame(rows, "player long, game long, season int, x double, y double")
    plans = []
    fitted = ml.fit

    def fit(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return fitted(df, *rest)

    monkeypatch.setattr(ml, "fit", fit)
    assert set(ml.train_players(df, ["x"], ["y"], "season")) == {"y"}
    assert plans and not any("Join" in p or "Exchange" in p for p in plans)
