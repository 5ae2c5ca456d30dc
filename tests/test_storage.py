"""Stored tables and the files that were shuffled for them."""

from __future__ import annotations

from duelframe.storage import FREEING_SETTING, materialise


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_what_was_shuffled_for_a_stored_table_goes_when_it_is_written(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("id % 97 AS k", "id").groupBy("k").agg({"id": "sum"})
    before, setting = shuffle_files(spark), spark.conf.get(FREEING_SETTING, None)
    kept = materialise(df, "kept")
    left = shuffle_files(spark)
    assert left - before
    freed = materialise(df, "freed", once=True)
    assert not shuffle_files(spark) - left
    assert spark.conf.get(FREEING_SETTING, None) == setting
    assert sorted(kept.collect()) == sorted(freed.collect()) and kept.count() == 97
