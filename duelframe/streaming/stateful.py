"""Opening and latest quotes as keyed state with event-time timers.

A key has one small entry, whatever the number of its snapshots. The keys of a day are kept in ``BUCKETS`` groups, each with one state row and one timer, so
that calls into the state store follow the days, not the keys. A timer fires when the watermark passes the end of the window: it gives the final
rows and clears the state, so what is kept follows the open windows, not the history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Groups of keys per day; a task holds one at a time.
BUCKETS = 256
_ENTRY = ["key", "opening", "opened", "latest", "seen", "snapshots"]
_STATE = "key array<string>, opening array<double>, opened array<long>, latest array<double>, seen array<long>, snapshots array<long>"
_FINAL = "day date, key string, opening double, latest double, snapshots long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside use the state store that has timers; the session's setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class OpenLatest(StatefulProcessor):
    """State of one (day, group of keys): per key the first and last quote by (time, quote), and the number of snapshots."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quotes = handle.getValueState("quotes", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.quotes.get()
        if held is None:
            self.handle.registerTimer(_day_end(key[0]))
        entries = None if held is None else _entries(held)
        for batch in rows:
            new = pd.DataFrame({
                "key": batch["key"], "opening": batch["quote"], "opened": batch["micros"], "latest": batch["quote"], "seen": batch["micros"], "snapshots": 1})
            entries = _merged(new if entries is None else pd.concat([entries, new], ignore_index=True))
        self.quotes.update(tuple(entries[c].tolist() for c in _ENTRY))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        final = _entries(self.quotes.get())[["key", "opening", "latest", "snapshots"]]
        self.quotes.clear()
        final.insert(0, "day", key[0])
        yield final

    def close(self) -> None:
        pass


def _entries(held) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_ENTRY, map(list, held), strict=True)))


def _merged(entries: pd.DataFrame) -> pd.DataFrame:
    """One entry per key."""
    by_key = lambda columns: entries.sort_values(["key", *columns]).groupby("key", sort=True)
    first = by_key(["opened", "opening"])[["opening", "opened"]].nth(0).reset_index(drop=True)
    last = by_key(["seen", "latest"])[["latest", "seen"]].nth(-1).reset_index(drop=True)
    counted = entries.groupby("key", sort=True)["snapshots"].sum().reset_index()
    return pd.concat([counted["key"], first, last, counted["snapshots"]], axis=1)


def _day_end(day) -> int:
    """Milliseconds at the end of a UTC day."""
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() + 86_400) * 1000


def open_and_latest(stream: DataFrame, keys: Sequence[str], quote: str, time: str, lateness_seconds: int = 7200) -> DataFrame:
    """Opening and latest quote per UTC day and key, once the watermark has passed the day's end by the lateness.

    The rows of ``twins.open_and_latest`` on the same input: NULL quotes and times do not count, of equal times the smallest quote is the first and
    the largest the last. Rows behind the watermark are dropped. To be started inside ``keyed_state``.
    """
    timed = stream.where(F.col(quote).isNotNull() & F.col(time).isNotNull()).withWatermark(time, f"{lateness_seconds} seconds")
    # one text for all key columns, as a NULL does not survive the way of a number through pandas
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    slim = timed.select(F.to_date(time).alias("day"), key.alias("key"), F.unix_micros(time).alias("micros"), F.col(quote).cast("double").alias("quote"), F.col(time))
    grouped = slim.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    final = grouped.groupBy("day", "bucket").transformWithStateInPandas(OpenLatest(), _FINAL, "Append", "EventTime")
    named = F.from_json("key", T.StructType([stream.schema[k] for k in keys]))
    return final.select("day", named.alias("key"), "opening", "latest", "snapshots").select("day", "key.*", "opening", "latest", "snapshots")
