"""Stored sketches and key filters against the rows they stand for."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from duelframe.operators import filters, sketches


def test_quantiles_of_any_range_of_seasons(spark):
    rng = np.random.default_rng(2)
    rows = [(int(s), float(v)) for s in range(6) for v in rng.lognormal(s / 3, 1, 4000)] + [(2, None), (None, 5.0)]
    df = spark.createDataFrame(rows, "season long, v double").repartition(9)
    stored = sketches.sketch(df, F.col("v"), ["season"]).cache()
    assert {r["season"]: r["n"] for r in stored.collect()} == {**dict.fromkeys(range(6), 4000), None: 1}
    spans = sketches.ranges(stored, "season")
    got = spans.select("first", "last", "n", *[sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9))]).collect()
    assert len(got) == 21
    for r in got:
        values = np.array([v for s, v in rows if s is not None and v is not None and r["first"] <= s <= r["last"]])
        assert r["n"] == len(values)
        for i, q in enumerate((0.1, 0.5, 0.9)):
            assert abs((values <= r[f"q{i}"]).mean() - q) <= 2 * sketches.rank_error()


def test_sketch_size_does_not_follow_the_rows(spark):
    size = lambda n: sketches.sketch(spark.range(n), F.col("id"), []).select(F.octet_length("sketch")).first()[0]
    assert size(1_000_000) < 3 * size(20_000)


def test_conformal_half_width_of_small_groups_is_exact(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 20)], "g int, r double")
    row = sketches.conformal(sketches.sketch(df, F.col("r"), ["g"]), 0.9).first()
    assert row["quantile"] == 18.0


def keys(rng, n):
    return [(rng.choice([None, "a", "b", "c"]), rng.randint(0, 40_000)) for _ in range(n)]


def test_known_keys_like_a_full_join(spark, tmp_path):
    rng = random.Random(4)
    history = [(k, v, p) for p in [*range(8), None] for k, v in keys(rng, 3000 if p != 3 else 40)]
    columns = "k string, v long, part int"
    spark.createDataFrame(history, columns).write.partitionBy("part").parquet(str(tmp_path / "history"))
    old = spark.read.parquet(str(tmp_path / "history"))
    stored = filters.key_filters(old, ["k", "v"], "part").cache()
    new = [(rng.choice([None, "a", "z"]), 50_000 + i) for i in range(300)] + [(k, v) for k, v, p in rng.sample(history, 60)]
    table = spark.createDataFrame(new + new[-3:], "k string, v long")
    found, read = filters.known_keys(table, old, stored, ["k", "v"], "part")
    want = {}
    for k, v, p in history:
        if (k, v) in set(new):
            want[k, v, p] = want.get((k, v, p), 0) + 1
    assert {(r["k"], r["v"], r["part"]): r["n"] for r in found.collect()} == want
    assert {p for _, _, p in want} <= set(read)


def test_partitions_without_a_hit_are_not_read(spark, tmp_path, capsys):
    history = spark.range(20_000).select("id", (F.col("id") % 20).cast("int").alias("part"))
    history.write.partitionBy("part").parquet(str(tmp_path / "history"))
    old = spark.read.parquet(str(tmp_path / "history"))
    stored = filters.key_filters(old, ["id"], "part").cache()
    assert stored.groupBy("part").agg(F.max("words").alias("w")).where("w > 512").count() == 0
    new = spark.createDataFrame([(7,), (27,), (10**9,), (10**9 + 1,)], "id long")
    found, read = filters.known_keys(new, old, stored, ["id"], "part")
    assert sorted(r["id"] for r in found.collect()) == [7, 27] and {r["part"] for r in found.collect()} == {7}
    assert len(read) <= 4
    found.explain("formatted")
    assert "PartitionFilters" in capsys.readouterr().out


def test_few_false_suspects(spark):
    old = spark.range(50_000).select("id", F.lit(1).alias("part"))
    stored = filters.key_filters(old, ["id"], "part")
    suspects = filters.suspects(spark.range(100_000, 150_000), ["id"], stored, "part").count()
    assert suspects < 0.05 * 50_000


def test_nothing_known_of_nothing(spark):
    old = spark.range(0).select("id", F.lit(1).alias("part"))
    stored = filters.key_filters(old, ["id"], "part")
    found, read = filters.known_keys(spark.range(3), old, stored, ["id"], "part")
    assert found.count() == 0 and read == []
