"""Sinks: snapshot log and nested JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.topk import on_date_or_latest, paged_array


def append_snapshot(df: DataFrame, path: str, taken: Column, date: str = "game_date") -> None:
    """Append a batch of quotes, stamped with the time it was taken, by date."""
    stamped = df.withColumn("snapshot_ts", taken)
    stamped.write.mode("append").partitionBy(date).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write nested documents, one JSON object per line."""
    df.write.mode("overwrite").json(path)


def daily_document(df: DataFrame, date: str, day: Column, order: list[str], columns: list[str]) -> DataFrame:
    """The rows of one day (or of the latest day) as documents with a count header, one per page."""
    rows = on_date_or_latest(df, date, day)
    pages = paged_array(rows, [date], order, [*order, *[c for c in columns if c not in order]], "rows")
    counts = rows.groupBy(date).agg(F.count(F.lit(1)).alias("count"))
    return pages.join(counts, date)
