"""Lines and quantile planes against numpy on the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelframe.operators import linear

FEATURES = ("a", "b", "c")


def frame(n=4000, seed=1, nulls=True):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"a": rng.normal(5, 2, n), "b": rng.exponential(3, n), "c": np.full(n, 7.0)})
    df["y"] = 2 * df["a"] - 0.5 * df["b"] + rng.normal(0, 1 + 0.3 * df["b"], n)
    df["season"] = rng.integers(0, 8, n)
    df["who"] = rng.integers(0, 150, n).astype(float)
    if nulls:
        df.loc[rng.random(n) < 0.1, "a"] = np.nan
        df.loc[rng.random(n) < 0.05, "y"] = np.nan
        df.loc[rng.random(n) < 0.02, "who"] = np.nan
    return df


def as_table(spark, df):
    rows = [[None if isinstance(v, float) and np.isnan(v) else v for v in r] for r in df.astype(object).to_numpy().tolist()]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, season long, who double").repartition(7)


def plain_ridge(df, penalty):
    df = df[df["y"].notna()]
    x = df[list(FEATURES)].to_numpy(float)
    means = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), means, x)
    scale = x.std(axis=0)
    varies = scale > 1e-9
    z = (x - means)[:, varies] / scale[varies]
    y = df["y"].to_numpy()
    solved = np.linalg.solve(z.T @ z / len(y) + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(y))
    coefficients = np.zeros(len(FEATURES))
    coefficients[varies] = solved / scale[varies]
    return coefficients, y.mean() - coefficients @ means, means


def test_folds_by_prefix_sums_are_fits_of_their_rows(spark):
    df = frame()
    lines = linear.fold_lines(as_table(spark, df), FEATURES, "y", "season", "who", min_train=3, min_entity_rows=12, penalty=0.2)
    assert sorted(lines) == [3, 4, 5, 6, 7]
    for season, line in lines.items():
        known = df[df["season"] < season]
        known = known[known.groupby("who")["season"].transform("count") >= 12]
        coefficients, intercept, _ = plain_ridge(known, 0.2)
        assert np.allclose(line.coefficients, coefficients, atol=1e-9)
        assert np.isclose(line.intercept, intercept)
        assert line.rows == known["y"].notna().sum()
        assert line.coefficients[2] == 0


def test_walk_forward_errors(spark):
    df = frame()
    got = {r["season"]: r for r in linear.walk_forward_regression(as_table(spark, df), FEATURES, "y", "season", min_train=4, min_rows=440, penalty=0.2).collect()}
    sizes = df[df["y"].notna()].groupby("season").size()
    assert set(got) == {s for s in range(4, 8) if sizes[s] >= 440}
    for season, row in got.items():
        known, test = df[df["season"] < season], df[(df["season"] == season) & df["y"].notna()]
        coefficients, intercept, means = plain_ridge(known, 0.2)
        x = test[list(FEATURES)].to_numpy(float)
        gap = np.where(np.isnan(x), means, x) @ coefficients + intercept - test["y"].to_numpy()
        assert np.isclose(row["mae"], np.abs(gap).mean()) and np.isclose(row["rmse"], np.sqrt((gap**2).mean()))
        assert np.isclose(row["baseline_mae"], np.abs(test["y"] - known["y"].mean()).mean())
        assert row["n_test"] == len(test) and row["n_train"] == known["y"].notna().sum()


def test_no_rows_no_seasons(spark):
    empty = as_table(spark, frame(20)).limit(0)
    assert linear.fold_lines(empty, FEATURES, "y", "season", "who") == {}
    assert linear.walk_forward_regression(empty, FEATURES, "y", "season").count() == 0


def pinball(y, q, level):
    u = y - q
    return np.maximum(level * u, (level - 1) * u).mean()


def plain_quantile(x, y, level):
    """Exact pinball loss by iteratively reweighted least squares (Hunter and Lange, 2000)."""
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(500):
        u = y - x @ b
        w = 1 / (1e-6 + np.abs(u))
        b = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * y) + (2 * level - 1) * x.sum(axis=0))
    return b


def test_planes_are_as_good_as_a_plain_solver_and_never_cross(spark):
    df = frame(6000, 3, nulls=False)
    table = as_table(spark, df)
    planes = linear.fit_quantiles(table, FEATURES, "y")
    rows = table.withColumns(planes.columns(["p25", "p50", "p75"])).toPandas()
    assert (rows["p25"] < rows["p50"]).all() and (rows["p50"] < rows["p75"]).all()
    x = np.column_stack([rows["a"], rows["b"], np.ones(len(rows))])
    for name, level in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        best = pinball(rows["y"], x @ plain_quantile(x, rows["y"].to_numpy(), level), level)
        assert pinball(rows["y"], rows[name], level) <= 1.005 * best
        assert abs((rows["y"] <= rows[name]).mean() - level) < 0.02


def test_coverage_on_rows_not_seen(spark):
    planes = linear.fit_quantiles(as_table(spark, frame(8000, 4)), FEATURES, "y", levels=(0.1, 0.5, 0.9))
    held = as_table(spark, frame(8000, 5)).where("y IS NOT NULL").withColumns(planes.columns(["low", "mid", "high"])).toPandas()
    for name, level in (("low", 0.1), ("mid", 0.5), ("high", 0.9)):
        assert abs((held["y"] <= held[name]).mean() - level) < 0.02


def test_gradient_and_curvature_of_the_smoothed_loss():
    rng = np.random.default_rng(7)
    x, y = np.column_stack([rng.normal(size=(50, 2)), np.ones(50)]), rng.normal(size=50)
    planes = rng.normal(size=(3, 3)) / 2
    now = linear.pinball_sums(x, y, planes, (0.25, 0.5, 0.75), 0.3)
    for i in range(9):
        moved = planes.copy().ravel()
        moved[i] += 1e-6
        then = linear.pinball_sums(x, y, moved.reshape(3, 3), (0.25, 0.5, 0.75), 0.3)
        assert np.isclose((then[0] - now[0]) / 1e-6, now[1 + i], atol=1e-3)


def test_one_value_has_no_planes_to_fit(spark):
    with pytest.raises(ValueError, match="no row has a label"):
        linear.fit_quantiles(as_table(spark, frame(20)).limit(0), FEATURES, "y")


def test_quantiles_of_several_labels_step_together(spark, monkeypatch):
    rows = as_table(spark, frame(2000, 5)).withColumn("z", F.when(F.col("y") > 0, F.col("y") * 3 + 1)).cache()
    alone = {label: linear.fit_quantiles(rows, FEATURES, label) for label in ("y", "z")}
    jobs = []
    summed = linear.summed

    def counted(df, add):
        jobs.append(1)
        return summed(df, add)

    monkeypatch.setattr(linear, "summed", counted)
    linear.fit_quantiles(rows, FEATURES, "y"), linear.fit_quantiles(rows, FEATURES, "z")
    apart, jobs[:] = len(jobs), []
    together = linear.fit_quantiles_all(rows, FEATURES, ["y", "z"])
    assert len(jobs) < 0.75 * apart
    for label, planes in together.items():
        assert np.allclose(planes.planes, alone[label].planes) and np.allclose(planes.means, alone[label].means)
