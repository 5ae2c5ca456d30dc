"""Streaming queries. The given tables arrive as files, oldest first, and the result is read back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.ledger import LINE_KEYS
from duelframe.plans.queries_ledger import dated
from duelframe.plans.registry import query
from duelframe.plans.shapes import Shapes
from duelframe.storage import new_path
from duelframe.streaming import stateful, twins


def staged(s: Shapes, df: DataFrame, time: str, label: str, parts: int = 3) -> Iterator[str]:
    """Write ``df`` in ``parts`` steps of time into one folder, and give the folder after each, as if rows arrived that way.

    Rows without a time arrive first; if all times are equal, so does everything.
    """
    path = new_path(s.spark, label)
    first, last = df.agg(F.min(time).cast("double"), F.max(time).cast("double")).first()
    width = ((last or 0.0) - (first or 0.0)) / parts or 1.0
    part = F.coalesce(F.least(F.floor((F.col(time).cast("double") - (first or 0.0)) / width), F.lit(parts - 1)), F.lit(0))
    for n in range(parts):
        df.filter(part == n).write.parquet(f"{path}/part-{n}")
        yield path


@query(
    "st_incremental_ingest",
    "event:l entity:l ts:t kind:s value:f4",
    "SELECT event, entity, ts, kind, value FROM event_log",
)
def incremental_ingest(s: Shapes) -> DataFrame:
    rows = s.log()
    table, checkpoint = new_path(s.spark, "ingested"), new_path(s.spark, "state")
    for source in staged(s, rows, "ts", "arrivals"):
        # The second run finds nothing new.
        for _ in range(2):
            twins.ingest(twins.arriving(s.spark, source, rows.schema), table, checkpoint)
    return s.spark.read.schema(rows.schema).parquet(table)


@query(
    "st_open_latest",
    "day:d entity:l opening:f6 latest:f6 snapshots:l",
    """SELECT day, entity, arg_min(quote, struct_pack(t := ts, q := quote)) AS opening, arg_max(quote, struct_pack(t := ts, q := quote)) AS latest,
      count(*) AS snapshots FROM event_log WHERE quote IS NOT NULL GROUP BY day, entity""",
)
def open_latest(s: Shapes) -> DataFrame:
    rows = s.log().select("entity", "ts", "quote")
    table, checkpoint = new_path(s.spark, "final"), new_path(s.spark, "state")

    def take(source: str) -> DataFrame:
        final = twins.open_and_latest(twins.arriving(s.spark, source, rows.schema), ["entity"], "quote", "ts")
        twins.append_final(final, table, checkpoint)
        return final

    for source in staged(s, rows, "ts", "quotes"):
        take(source)
    # Closing rows move the watermark past the last window; the windows they open themselves stay open.
    for n in (1, 2):
        twins.closing(rows, "ts", {"quote": 0.0}).write.parquet(f"{source}/closing-{n}")
        final = take(source)
    return s.spark.read.schema(final.schema).parquet(table)


@query(
    "st_write_once",
    "id:l game_date:d home:i away:i p_home:f6 created_at:t",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_date, home, away ORDER BY created_at, id) AS n FROM dated) WHERE n = 1",
)
def write_once(s: Shapes) -> DataFrame:
    rows = dated(s).select("id", "game_date", "home", "away", "p_home", "created_at")
    store, checkpoint = new_path(s.spark, "store"), new_path(s.spark, "state")
    for source in staged(s, rows, "created_at", "predictions"):
        twins.store_first(twins.arriving(s.spark, source, rows.schema), store, checkpoint, LINE_KEYS, ["created_at", "id"], "game_date")
    return twins.stored(s.spark, store, rows.schema)


@query(
    "st_open_latest_timers",
    "day:d entity:l opening:f6 latest:f6 snapshots:l",
    """SELECT day, entity, arg_min(quote, struct_pack(t := ts, q := quote)) AS opening, arg_max(quote, struct_pack(t := ts, q := quote)) AS latest,
      count(*) AS snapshots FROM event_log WHERE quote IS NOT NULL GROUP BY day, entity""",
)
def open_latest_timers(s: Shapes) -> DataFrame:
    rows = s.log().select("entity", "ts", "quote")
    table, checkpoint = new_path(s.spark, "final"), new_path(s.spark, "state")

    def take(source: str) -> DataFrame:
        final = stateful.open_and_latest(twins.arriving(s.spark, source, rows.schema), ["entity"], "quote", "ts")
        with stateful.keyed_state(s.spark):
            twins.append_final(final, table, checkpoint)
        return final

    for source in staged(s, rows, "ts", "quotes"):
        take(source)
    # As above: the watermark follows the closing rows, whose own day stays open.
    for n in (1, 2):
        twins.closing(rows, "ts", {"quote": 0.0}).write.parquet(f"{source}/closing-{n}")
        final = take(source)
    return s.spark.read.schema(final.schema).parquet(table)
