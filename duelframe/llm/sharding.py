"""Sharding along a Hilbert curve: documents that are close in several metadata dimensions share files.

Each dimension is cut into 2^bits equally filled steps, the steps of all dimensions give a place on the Hilbert curve, and runs of
the curve become shards. A reader that knows the smallest and largest value of every dimension per shard skips the
shards that cannot match, whichever dimensions it filters on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from duelframe.llm.common import numbered, running, small, utf8_bytes
from duelframe.storage import materialise

#: Steps per doubling of a number; sizes up to 2^64 give at most 64 * 16 distinct values.
STEPS_PER_DOUBLING = 16


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with one row per dimension and ``bits`` bits per coordinate.

    Skilling's transform ("Programming the Hilbert curve", 2004), on whole columns of points at once.
    """
    x = axes.astype(np.uint64).copy()
    n = len(x)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        low = q - one
        for i in range(n):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - one), flip)
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << one) | ((x[i] >> np.uint64(bit)) & one)
    return index.astype(np.int64)


def _coarse(df: DataFrame, name: str) -> Column:
    """What is counted per dimension: the value itself for strings, the logarithm's step for numbers."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, StringType):
        return column
    value = column.cast("double")
    usable = value.isNotNull() & ~F.isnan(value)
    return F.when(usable, F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * STEPS_PER_DOUBLING))


def quantised(df: DataFrame, name: str, bits: int, out: str) -> DataFrame:
    """Add step ``out`` (0 to 2^bits - 1) of column ``name``: the share of rows with a smaller value. NULL sorts first."""
    keyed = df.withColumn("_value", _coarse(df, name))
    counts = keyed.groupBy("_value").agg(F.count("*").alias("_rows"))
    total = df.count()
    below = running(counts, [F.col("_value").asc_nulls_first()], {"_below": "_rows"}, f"steps-{out}")
    step = F.floor(F.col("_below") * F.lit(1 << bits) / F.lit(max(total, 1)))
    steps = materialise(below.select(F.col("_value").alias("_step_value"), step.cast("int").alias(out)), f"steps-{out}")
    return keyed.join(small(steps), F.col("_value").eqNullSafe(F.col("_step_value"))).drop("_value", "_step_value")


def hilbert(df: DataFrame, dimensions: list[str], bits: int = 8, index: str = "curve_index") -> DataFrame:
    """Add the place on the Hilbert curve over ``dimensions`` (2 or more, at most 63 bits together) as ``index``."""
    if len(dimensions) * bits > 63:
        raise ValueError("the curve index has 63 bits")
    out = df
    steps = [f"_step{i}" for i in range(len(dimensions))]
    for name, step in zip(dimensions, steps, strict=True):
        out = quantised(out, name, bits, step)

    @F.pandas_udf("long")
    def curve(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a.to_numpy() for a in axes]), bits))

    return out.withColumn(index, curve(*steps)).drop(*steps)


def shards(df: DataFrame, dimensions: list[str], ties: list[str], n: int = 16, bits: int = 8) -> DataFrame:
    """Add ``curve_index``, ``shard`` and ``slot``: ``n`` runs of the curve whose row counts differ by at most one.

    ``ties`` order rows of the same place (equal rows may swap places). Slots count from 0 without gaps. NULLs in a dimension are its smallest
    value. A hot value or a large group of copies is cut wherever a run ends, so no shard grows with it. An empty table gives an empty table.
    """
    placed = materialise(hilbert(df, dimensions, bits), "shard-curve")
    total = placed.count()
    ranked = numbered(placed, [F.col(c) for c in ("curve_index", *ties)], "shard-order", "_position")
    # in whole numbers: doubles may be off by one at the ends of runs
    shard = F.expr(f"_position * {n} div {max(total, 1)}")
    first = F.expr(f"((_position * {n} div {max(total, 1)}) * {total} + {n - 1}) div {n}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_position") - first).drop("_position")


def manifest(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows, and smallest and largest value of each dimension, per shard: what a reader prunes by."""
    bounds = [f(F.col(f"`{d}`")).alias(f"{name}_{d}") for d in dimensions for name, f in (("min", F.min), ("max", F.max))]
    nulls = [F.count_if(F.col(f"`{d}`").isNull()).alias(f"nulls_{d}") for d in dimensions]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *bounds, *nulls)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op2_hilbert_shards: all documents in 16 shards along (lang, source, size); law ``rows``.

    A NULL text has no bytes: size 1 and checksum 0.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    slim = docs.select(
        "doc_id",
        "lang",
        "source",
        (utf8_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    slim = materialise(slim, "shard-documents")
    out = shards(slim, ["lang", "source", "size"], ["text_crc32", "size", "doc_id"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )
