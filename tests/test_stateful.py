"""Keyed state with timers: final rows come once, and nothing is kept of days that are over."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from duelframe.streaming import stateful, twins


def run(spark, source, rows, table, checkpoint):
    final = stateful.open_and_latest(twins.arriving(spark, source, rows.schema), ["who", "kind"], "quote", "ts")
    with stateful.keyed_state(spark):
        twins.append_final(final, table, checkpoint)
    return final


def test_rows_of_window_aggregates_and_state_gone(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 3, 1)
    data = []
    for i in range(600):
        data.append((rng.choice([1, 2, None]), rng.choice("xy"), start + timedelta(minutes=20 * i), rng.choice([None, round(rng.uniform(-5, 5), 1)])))
    data += [(1, "x", start + timedelta(days=1), 1.5), (1, "x", start + timedelta(days=1), -1.5)]
    data.sort(key=lambda r: r[2])
    schema = "who long, kind string, ts timestamp, quote double"
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame(data, schema)
    for i in range(0, len(data), 250):
        spark.createDataFrame(data[i : i + 250], schema).write.parquet(f"{source}/{i}")
        final = run(spark, source, rows, table, checkpoint)
    for n in (1, 2):
        twins.closing(rows, "ts", {"quote": 0.0}).write.parquet(f"{source}/closing-{n}")
        run(spark, source, rows, table, checkpoint)
    got = spark.read.schema(final.schema).parquet(table)
    moment = F.struct("ts", "quote")
    want = rows.where("quote IS NOT NULL").groupBy(F.to_date("ts").alias("day"), "who", "kind").agg(
        F.min_by("quote", moment).alias("opening"), F.max_by("quote", moment).alias("latest"), F.count(F.lit(1)).alias("snapshots"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.select(*got.columns).collect()), key=key)
    with stateful.keyed_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "quotes").load(checkpoint)
        assert [str(r["key"]["day"]) for r in state.select("key").collect()] == ["2024-03-12"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


def test_state_rows_follow_days_and_not_keys(spark, tmp_path):
    start = datetime(2024, 3, 1)
    data = [(i, "x", start + timedelta(seconds=i), float(i)) for i in range(3000)]
    rows = spark.createDataFrame(data, "who long, kind string, ts timestamp, quote double")
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.write.parquet(f"{source}/0")
    run(spark, source, rows, table, checkpoint)
    with stateful.keyed_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "quotes").load(checkpoint)
        assert state.count() <= stateful.BUCKETS
        assert state.selectExpr("sum(size(value.key))").first()[0] == 3000
