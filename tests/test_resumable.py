"""Steps over a stored state against one run over all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import ordered, windows as wn
from duelframe.operators.ordered import entity_log
from duelframe.operators.resumable import Resumable, late_rows, resume, step

SPEC = Resumable(
    entity=["team", "league"], order=["day", "game"], means={"x": [3, 7], "y": [2]}, decays={"x": [3, 20], "y": [5]}, streaks={"run": "won"},
    records={"won": ("wins", "losses", "rate")}, within=["season"],
)
COLUMNS = "team long, league string, day long, game long, season long, x double, y double, won int, extra string"


def rows_of(n=900, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        day = i // 9
        # x of team 5 is missing for so long that its weight vanishes
        x = None if rng.random() < 0.3 or (rng.random() < 2 and i % 6 == 5 and 100 < i < 800) else rng.uniform(-5, 5)
        out.append((None if i % 6 == 0 else i % 6, "ab"[i % 2] if i % 10 else None, day, i, day // 30, x, rng.uniform(0, 1), int(rng.random() < 0.6), "e"))
    return out


def whole(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    log = wn.lag_mean(wn.lag_mean(entity_log(df, SPEC.entity, SPEC.order), ["x"], [3, 7]), ["y"], [2])
    log = wn.streak(wn.ewma(wn.ewma(log, ["x"], [3, 20]), ["y"], [5]), "won", "run")
    return wn.cumulative_record(entity_log(log.result, [*SPEC.entity, "season"], SPEC.order), "won", "wins", "losses", "rate").result


def answers(df):
    return {r["game"]: {c: r[c] for c in SPEC.features} for r in df.collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for game, values in want.items():
        for c, v in values.items():
            assert (got[game][c] is None) == (v is None), (game, c, got[game][c], v)
            assert v is None or got[game][c] == pytest.approx(v, abs=1e-9), (game, c)


@pytest.mark.parametrize("cuts", [[0, 900], [0, 450, 451, 459, 459, 700, 900], list(range(0, 901, 150))])
def test_steps_give_what_one_run_gives(spark, cuts):
    rows = rows_of()
    want, got, state = answers(whole(spark, rows)), {}, None
    for a, b in zip(cuts, cuts[1:], strict=False):
        features, state = step(SPEC, spark.createDataFrame(rows[a:b], COLUMNS), state)
        assert features.columns == [*[c.split()[0] for c in COLUMNS.split(", ")], *SPEC.features]
        got |= answers(features)
    assert_same(got, want)
    tails = state.select(F.max(F.size("__tail"))).first()[0]
    assert tails == SPEC.look_back
    assert state.count() == len({(r[0], r[1]) for r in rows})


def test_steps_with_cut_entities(spark, monkeypatch):
    rows = rows_of(600)
    want = answers(whole(spark, rows))
    monkeypatch.setattr(ordered, "SLICE_ROWS", 700)
    monkeypatch.setattr(wn, "ewma_rows", lambda span, epsilon=1e-16: 60)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 130)
    first, state = step(SPEC, spark.createDataFrame(rows[:500], COLUMNS))
    second, _ = step(SPEC, spark.createDataFrame(rows[500:], COLUMNS), state)
    got = answers(first) | answers(second)
    for game, values in want.items():
        for c in ("x_roll3", "x_roll7", "y_roll2", "run", "wins", "losses", "rate"):
            assert got[game][c] == (None if values[c] is None else pytest.approx(values[c], abs=1e-9)), (game, c)


def test_rows_that_come_late_are_told(spark):
    rows = rows_of(300)
    _, state = step(SPEC, spark.createDataFrame(rows[100:200], COLUMNS))
    late = late_rows(SPEC, spark.createDataFrame(rows[95:105] + rows[200:], COLUMNS), state)
    assert sorted(r["game"] for r in late.collect()) == list(range(95, 105))


def test_runs_read_new_files_only(spark, tmp_path):
    import time

    rows, source, root = rows_of(300), str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], COLUMNS).schema
    spark.createDataFrame(rows[:200], COLUMNS).write.parquet(f"{source}/a")
    files = lambda: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(source)
    assert resume(SPEC, files(), root) == 1
    assert resume(SPEC, files(), root) == 1
    time.sleep(0.01)
    spark.createDataFrame(rows[200:], COLUMNS).write.parquet(f"{source}/b")
    assert resume(SPEC, files(), root) == 2
    assert_same(answers(spark.read.parquet(f"{root}/features")), answers(whole(spark, rows)))
    time.sleep(0.01)
    spark.createDataFrame(rows[:5], COLUMNS).write.parquet(f"{source}/c")
    with pytest.raises(ValueError, match="run over all rows"):
        resume(SPEC, files(), root)
