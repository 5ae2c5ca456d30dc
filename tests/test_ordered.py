"""Cut logs must give what plain windows give, whatever the size of an entity."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelframe.operators import windows as wn
from duelframe.operators.ordered import entity_log, ranked


def make_log(rows: int = 400, seed: int = 1) -> pd.DataFrame:
    """One entity owns most rows, several days have many rows, some values are missing."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        entity = 0 if rng.random() < 0.7 else rng.randint(1, 9)
        value = None if rng.random() < 0.15 else round(rng.uniform(-20, 20), 2)
        data.append((entity, f"2024-01-{1 + i * 28 // rows:02d}", i, value, int(rng.random() < 0.55)))
    rng.shuffle(data)
    return pd.DataFrame(data, columns=["entity", "day", "id", "value", "flag"])


@pytest.fixture(scope="module")
def frame():
    return make_log()


@pytest.fixture(scope="module")
def log_df(spark, frame):
    schema = "entity int, day string, id int, value double, flag int"
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, schema).withColumn("day", F.to_date("day")).cache()


def logs(df, slice_rows):
    plain = entity_log(df, ["entity"], ["day", "id"])
    cut = entity_log(df, ["entity"], ["day", "id"], slice_rows)
    assert not plain.is_cut and cut.is_cut
    return plain, cut


def same(a, b, columns, decimals=9):
    key = lambda d: d.select("entity", "id", *columns).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(key(a), key(b), check_dtype=False, atol=10.0**-decimals)


@pytest.mark.parametrize("slice_rows", [25, 64])
def test_bounded_frames(log_df, slice_rows):
    plain, cut = logs(log_df, slice_rows)
    run = lambda log: wn.lag_std(wn.lag_mean(log, ["value"], [3, 20], min_rows=2), "value", "std").result
    same(run(plain), run(cut), ["value_roll3", "value_roll20", "std"])


@pytest.mark.parametrize("slice_rows", [7, 50])
def test_running_aggregates(log_df, slice_rows):
    plain, cut = logs(log_df, slice_rows)
    kinds = {k: (k, F.col("value")) for k in ("sum", "count", "max", "min", "last")}
    for current in (False, True):
        same(plain.running(kinds, current), cut.running(kinds, current), list(kinds))


def test_numbers_and_streaks(log_df):
    plain, cut = logs(log_df, 11)
    same(plain.numbered("n"), cut.numbered("n"), ["n"])
    same(wn.streak(plain, "flag").result, wn.streak(cut, "flag").result, ["streak"])
    ends = lambda log: sorted(map(tuple, wn.run_at_end(log, "flag").collect()))
    assert ends(plain) == ends(cut)


def test_streak_against_a_loop(log_df, frame):
    got = {r["id"]: r["streak"] for r in wn.streak(entity_log(log_df, ["entity"], ["day", "id"], 13), "flag").result.collect()}
    for _, group in frame.sort_values(["day", "id"]).groupby("entity"):
        current = 0
        for row in group.itertuples():
            assert got[row.id] == current
            step = 1 if row.flag else -1
            current = current + step if current * step > 0 else step


@pytest.mark.parametrize("span", [7, 15])
def test_ewma_matches_pandas(log_df, frame, span):
    ordered = frame.sort_values(["day", "id"])
    want = ordered.groupby("entity")["value"].transform(lambda s: s.shift(1).ewm(span=span, min_periods=1).mean())
    want = dict(zip(ordered["id"], want))
    for slice_rows in (None, 2 * wn.ewma_rows(span) + 1):
        df = log_df if slice_rows is None else log_df.unionByName(log_df.withColumns({"id": F.col("id") + 10_000})).unionByName(
            log_df.withColumns({"id": F.col("id") + 20_000}))
        if slice_rows is None:
            result = wn.ewma(entity_log(df, ["entity"], ["day", "id"]), ["value"], [span]).result
            for row in result.collect():
                expected = want[row["id"]]
                assert (row[f"value_ewma{span}"] is None) == np.isnan(expected)
                if row[f"value_ewma{span}"] is not None:
                    assert row[f"value_ewma{span}"] == pytest.approx(expected, abs=1e-10)
        else:
            plain = wn.ewma(entity_log(df, ["entity"], ["day", "id"]), ["value"], [span]).result
            cut = wn.ewma(entity_log(df, ["entity"], ["day", "id"], slice_rows), ["value"], [span]).result
            same(plain, cut, [f"value_ewma{span}"])


def test_calendar_counts(log_df, frame):
    days = pd.to_datetime(frame["day"])
    count = lambda df, rows=None: {
        r["id"]: r["rows_last_5_days"] for r in wn.calendar_counts(df, ["entity"], "day", ["id"], [5], slice_rows=rows).collect()
    }
    plain, cut = count(log_df), count(log_df, 20)
    assert plain == cut
    for row in frame.itertuples():
        day = pd.Timestamp(row.day)
        earlier = (frame["entity"] == row.entity) & ((days < day) | ((days == day) & (frame["id"] < row.id)))
        assert plain[row.id] == int((earlier & (days > day - pd.Timedelta(days=5))).sum())


def test_slopes_and_drawdown(log_df):
    plain, cut = logs(log_df.withColumn("value", F.coalesce("value", F.lit(0.0))), 30)
    same(wn.slope(plain, "value", "s").result, wn.slope(cut, "value", "s").result, ["s"])
    same(wn.drawdown(plain, "value").result, wn.drawdown(cut, "value").result, ["running_profit", "drawdown"])


def test_global_rank_is_the_same_when_cut(log_df):
    rank = lambda rows=None: {r["id"]: r["r"] for r in ranked(log_df, [F.col("value")], ["id"], "r", rows).collect()}
    plain = rank()
    assert plain == rank(40)
    assert sorted(plain.values()) == list(range(1, len(plain) + 1))


def test_changing_a_row_does_not_change_its_own_or_earlier_features(log_df):
    columns = ["value_roll3", "value_ewma7", "value_mean"]

    def build(df):
        log = entity_log(df, ["entity"], ["day", "id"], 290)
        log = wn.ewma(wn.lag_mean(log, ["value"], [3]), ["value"], [7])
        return wn.expanding_mean(log, F.col("value"), "value_mean").result

    changed = log_df.withColumn("value", F.when(F.col("id") == 200, 1e6).otherwise(F.col("value")))
    before = build(log_df).filter("id <= 200")
    after = build(changed).filter("id <= 200")
    same(before, after, columns)


@pytest.fixture(scope="module")
def null_keys(spark):
    """A third of the rows has no entity, a few have no day."""
    rng = random.Random(5)
    rows = [
        (rng.choice([None, 1, 2]), None if i % 29 == 0 else f"2024-01-{1 + i * 28 // 200:02d}", i, None if i % 7 == 0 else float(i % 13), i % 3 % 2)
        for i in range(200)
    ]
    return spark.createDataFrame(rows, "entity int, day string, id int, value double, flag int").withColumn("day", F.to_date("day"))


NULL_KEY_RUNS = {
    "running": (lambda log: log.running({"a": ("sum", F.col("value")), "b": ("last", F.col("value")), "c": ("count", F.col("value"))}), ["a", "b", "c"]),
    "numbered": (lambda log: log.numbered("n"), ["n"]),
    "means": (lambda log: wn.lag_mean(log, ["value"], [5]).result, ["value_roll5"]),
    "expanding": (lambda log: wn.expanding_mean(log, F.col("value"), "m").result, ["m"]),
    "streak": (lambda log: wn.streak(log, "flag").result, ["streak"]),
    "drawdown": (lambda log: wn.drawdown(log, "value").result, ["running_profit", "drawdown"]),
    "downsample": (lambda log: wn.downsample(log), ["value"]),
}


@pytest.mark.parametrize("name", sorted(NULL_KEY_RUNS))
def test_null_keys_are_an_entity_cut_or_not(null_keys, name):
    run, columns = NULL_KEY_RUNS[name]
    plain, cut = logs(null_keys, 20)
    a, b = run(plain), run(cut)
    assert dict(a.select(columns).dtypes) == dict(b.select(columns).dtypes)
    same(a, b, columns)


def test_calendar_counts_with_null_keys(null_keys):
    count = lambda slice_rows: wn.calendar_counts(null_keys, ["entity"], "day", ["id"], [3, 7], slice_rows=slice_rows)
    assert count(20).count() == count(None).count() == 200
    same(count(None), count(20), ["rows_last_3_days", "rows_last_7_days"])


@pytest.mark.parametrize("slice_rows", [None, 300])
def test_ewma_across_long_runs_of_nulls(spark, slice_rows):
    values = [float(i % 17) if i < 150 or i > 1180 or i == 700 else None for i in range(1300)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "entity int, id int, value double")
    log = entity_log(df, ["entity"], ["id"], slice_rows)
    got = wn.ewma(log, ["value"], [7, 3]).result.toPandas().sort_values("id")
    for span in (3, 7):
        want = pd.Series(values).ewm(span=span, adjust=True, ignore_na=False).mean().shift(1)
        np.testing.assert_allclose(got[f"value_ewma{span}"].to_numpy(float), want.to_numpy(), rtol=1e-9)
