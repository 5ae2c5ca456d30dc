"""Stored quantile sketches: one small row per group, merged for any range of groups without another look at the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: it keeps a few times so many numbers, whatever it has seen.
SIZE = 2000


def rank_error(size: int = SIZE) -> float:
    """Share of the rows by which the rank of a quantile may be off, with a confidence of 99 %; the bound published for KLL sketches."""
    return 2.296 / size**0.9021


def sketch(df: DataFrame, value: Column, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """(keys, sketch, n) of the values that are not NULL. Sketches are made in the tasks and merged after the shuffle. A group without a value has no row."""
    rows = df.select(*keys, value.cast("double").alias("__value")).where(F.col("__value").isNotNull())
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double("__value", F.lit(size)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sketch, n) over coarser keys, or any other grouping of the stored rows."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def ranges(sketches: DataFrame, period: str) -> DataFrame:
    """(first, last, sketch, n): a merged sketch for every range of periods, from one row per period.

    A stored row goes to every range that holds its period, so this is for some hundred periods at most; the rows of the table are not touched.
    A NULL period is in no range.
    """
    known = F.array(*[F.lit(r[0]) for r in sketches.select(period).distinct().orderBy(period).collect() if r[0] is not None])
    held = sketches.withColumn("first", F.explode(F.filter(known, lambda p: p <= F.col(period))))
    held = held.withColumn("last", F.explode(F.filter(known, lambda p: p >= F.col(period))))
    return merged(held, ["first", "last"])


def quantile(level: float) -> Column:
    """The quantile of a row's ``sketch``."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(level))


#: Steps between the coverage and 1 at which a half-width is looked up.
STEPS = 512


def conformal(sketches: DataFrame, coverage: float = 0.9) -> DataFrame:
    """Add ``quantile``: the half-width that covers ``coverage`` of the absolute residuals, with the finite-sample correction, from sketches of them.

    The corrected level depends on the row; it is taken down to one of ``STEPS`` steps of the share that is not covered, far below the rank error.
    """
    level = F.least(F.ceil((F.col("n") + 1) * coverage) / F.col("n"), F.lit(1.0))
    step = F.floor((level - coverage) / (1 - coverage) * STEPS + 1e-9).cast("int")
    levels = F.array(*[F.lit(min(1.0, coverage + (1 - coverage) * i / STEPS)) for i in range(STEPS + 1)])
    return sketches.withColumn("quantile", F.element_at(F.kll_sketch_get_quantile_double("sketch", levels), step + 1))
