"""Structured Streaming twins of batch operators.

Each gives the rows of its batch twin on the same input, when no row is later
than the watermark and arrival follows event time. All run with
``availableNow``: they take what has arrived since their checkpoint and stop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from duelframe.operators.ledger import write_once

WAIT_SECONDS = 3600


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files that appear in a folder, oldest first."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def finish(query: StreamingQuery, seconds: int = WAIT_SECONDS) -> None:
    """Wait for an ``availableNow`` query; raise if it failed or hangs."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream {query.id} did not finish in {seconds} s")


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is new to a table; the checkpoint makes it exactly once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    finish(writer.trigger(availableNow=True).start(path))


def open_and_latest(stream: DataFrame, keys: Sequence[str], quote: str, time: str, lateness: str = "2 hours", width: str = "1 day") -> DataFrame:
    """Opening and latest quote per key and time window.

    The window is part of the key, so state is dropped once the watermark has
    passed it. In append mode the rows are final. Of equal times the smallest
    quote counts as first, the largest as last.
    """
    moment = F.struct(F.col(time), F.col(quote))
    timed = stream.filter(F.col(quote).isNotNull()).withWatermark(time, lateness)
    return timed.groupBy(F.window(time, width).alias("window"), *keys).agg(
        F.min_by(quote, moment).alias("opening"),
        F.max_by(quote, moment).alias("latest"),
        F.count(F.lit(1)).alias("snapshots"),
    ).select(F.to_date("window.start").alias("day"), *keys, "opening", "latest", "snapshots")


def append_final(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write the final rows of a windowed aggregate."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    finish(writer.trigger(availableNow=True).start(path))


def closing(rows: DataFrame, time: str, values: dict[str, object], beyond: str = "INTERVAL 3 DAYS") -> DataFrame:
    """One row like ``rows``, far enough behind their last time to close all their windows; other columns are NULL.

    A watermark moves with the rows of a batch and takes effect in the next, so such a row is sent twice.
    """
    last = rows.agg(F.max(time).alias("__last"))
    at = F.expr(f"__last + {beyond}")
    columns = [(at if f.name == time else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    return last.filter("__last IS NOT NULL").select(*columns)


_STORE_DATE = "store_date"


def store_first(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], date: str) -> None:
    """First row per key. Each batch has its own folder, so that a repeated batch replaces itself.

    Within a batch rows are stored by ``date``, one of the keys: a batch reads only the dates that it brings.
    """
    schema = stream.schema

    def add(batch: DataFrame, number: int) -> None:
        earlier = _store(batch.sparkSession, path, schema)
        if earlier is not None:
            dates = batch.select(F.col(date).alias(_STORE_DATE)).distinct()
            earlier = earlier.filter(F.col("batch") < number).join(dates, _STORE_DATE, "left_semi").drop("batch", _STORE_DATE)
        fresh = write_once(earlier, batch, keys, order).withColumn(_STORE_DATE, F.col(date))
        fresh.write.mode("overwrite").partitionBy(_STORE_DATE).parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    finish(writer.trigger(availableNow=True).start())


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a store, in the columns of ``schema``."""
    found = _store(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found.select(*schema.names)


def _store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """What earlier batches stored; None before the first. Any other failure to read is an error."""
    found = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField(_STORE_DATE, T.DateType())])
    try:
        return spark.read.schema(found).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
