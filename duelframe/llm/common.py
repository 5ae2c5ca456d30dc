"""Helpers shared by the training-data operators.

Intermediate tables are written to the folder named by ``spark.checkpoint.dir`` (see ``duelframe.storage``), so a lost
executor costs a re-read. Nothing here moves rows to the driver except single totals.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.storage import materialise

# The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# A side of a join is broadcast only if it has been counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 200_000

# monotonically_increasing_id keeps the partition above these bits and the row's place within the partition below.
_PLACE_BITS = 33


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Lower the session's Arrow batches to ``size`` bytes, if they are larger: a task then holds a few MB of whole texts, not 64.

    The setting stays, since Spark reads it when a result is computed, which may be after an operator has returned.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", spark.conf.get(setting).lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit or "b") > size:
        spark.conf.set(setting, f"{size}b")


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for mapInArrow, giving memory back to the system at its end: workers are used again by other tasks."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    """Give memory that Arrow and the C library keep for later back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, else as it is: a shuffled join.

    ``df`` should be a stored table or cheap to count, and narrow.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes; 0 for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _ranged(df: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, Column]:
    """``df`` stored in total order; its ranges number the rows. Also the column with the range."""
    stored = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()),
        label,
    )
    return stored, F.shiftright("_row", _PLACE_BITS)


def numbered(df: DataFrame, order: list[Column], label: str, position: str = "position") -> DataFrame:
    """Add each row's place in the total ``order`` of the whole table, from 0, as long.

    One range shuffle, no global window: rows are numbered within their range when stored, and each range starts
    where the earlier ones end. The table of starts has one row per range.
    """
    stored, part = _ranged(df, order, label)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = _before(sizes, "_n")
    place = F.col("_row").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(position, F.col("_before") + place)
        .drop("_part", "_row", "_before")
    )


def running(df: DataFrame, order: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """Add the sums over all earlier rows of the total ``order``; ``sums`` maps new columns to summed ones."""
    stored, part = _ranged(df, order, label)
    stored = stored.withColumn("_part", part)
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = stored.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{new}") for new, c in sums.items()])
    parts = stored.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{new}") for new, c in sums.items()])
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_sum_{new}").over(ranges), F.lit(0)).alias(f"_at_{new}") for new in sums])
    out = out.join(F.broadcast(starts), "_part")
    return out.select(*df.columns, *[(F.col(f"_in_{new}") + F.col(f"_at_{new}")).alias(new) for new in sums])


def _before(sizes: DataFrame, n: str) -> DataFrame:
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum(n).over(ranges), F.lit(0)).cast("long").alias("_before"))


def light(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its measured strings and numbers have at most ``limit`` bytes, else as it is: a shuffled join.

    ``df`` should be a stored table: measuring reads it once.
    """
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(0)) + 16 for c, t in df.dtypes)
    return F.broadcast(df) if (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit else df
