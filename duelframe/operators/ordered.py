"""Window calculations over entity logs whose entities may be arbitrarily large.

A plain ``Window.partitionBy(entity)`` puts each entity into one task. With a
few dozen entities, or one that owns a third of all rows, that does not scale.
Here an entity larger than ``slice_rows`` is cut into consecutive blocks:

* the log is range-partitioned by (entity, order), so Spark's own sampling cuts
  a large entity wherever its rows are, and each row gets an increasing number;
* rows with a bounded look-back get the last rows of the block before as a halo;
* running aggregates get the combined aggregates of all earlier blocks as carry.

Only entities that straddle a range boundary need block offsets: at most two
per range, so the tables of offsets and carries have at most two rows per
``slice_rows`` input rows. Both paths give the same rows and types; a NULL key is an entity. Logs without large entities take the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from duelframe.storage import materialise

SLICE_ROWS = 2_000_000
_SEQ, _BLOCK, _RANGE, _HALO, _POS = "__seq", "__block", "__range", "__halo", "__pos"


@dataclass(frozen=True)
class EntityLog:
    """A log, its entity key and its total order, cut into blocks if it has to be."""

    df: DataFrame
    entity: tuple[str, ...]
    order: tuple[str, ...]
    block_rows: int | None = None

    @property
    def is_cut(self) -> bool:
        return self.block_rows is not None

    @property
    def keys(self) -> list[str]:
        """What a window has to be partitioned by."""
        return [*self.entity, _BLOCK] if self.is_cut else list(self.entity)

    def window(self, *within: str) -> WindowSpec:
        """The window of an entity, or of a part of it given by further columns."""
        return Window.partitionBy(*self.keys, *within).orderBy(*[F.col(c).asc_nulls_last() for c in self.order])

    def lagged(self, lookback: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
        """Add window columns that look back at most ``lookback`` rows."""
        return self.lagged_log(lookback, columns)._plain()

    def lagged_log(self, lookback: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> EntityLog:
        if not self.is_cut:
            return self._with(self.df.withColumns(columns(self.window())))
        if lookback > self.block_rows:
            raise ValueError(f"look-back {lookback} exceeds the block size {self.block_rows}")
        near_end = F.col(_POS) % self.block_rows >= self.block_rows - lookback
        own = F.struct(F.col(_BLOCK).alias("b"), F.lit(False).alias("h"))
        following = F.struct((F.col(_BLOCK) + 1).alias("b"), F.lit(True).alias("h"))
        spread = self.df.withColumn(
            "__copy", F.explode(F.when(near_end, F.array(own, following)).otherwise(F.array(own)))
        ).withColumns({_BLOCK: F.col("__copy.b"), _HALO: F.col("__copy.h")})
        done = spread.withColumns(columns(self.window())).filter(~F.col(_HALO))
        return self._with(done.drop("__copy", _HALO))

    def running(self, columns: dict[str, tuple[str, Column]], include_current: bool = False) -> DataFrame:
        """Add aggregates over all earlier rows of the entity (``sum count max min last``).

        ``sum`` and ``count`` are 0 before the first value; the others are NULL.
        """
        return self.running_log(columns, include_current)._plain()

    def running_log(self, columns: dict[str, tuple[str, Column]], include_current: bool = False) -> EntityLog:
        end = Window.currentRow if include_current else -1
        frame = self.window().rowsBetween(Window.unboundedPreceding, end)
        local = {name: _aggregate(kind, value).over(frame) for name, (kind, value) in columns.items()}
        if not self.is_cut:
            return self._with(
                self.df.withColumns({n: _finish(columns[n][0], c) for n, c in local.items()})
            )
        # Aggregates of whole blocks, combined over the earlier blocks of the entity.
        whole = (
            self.df.filter(F.col(_POS).isNotNull())
            .groupBy(*self.entity, _BLOCK)
            .agg(*[
                (F.max_by(value, F.when(value.isNotNull(), F.col(_SEQ))) if kind == "last" else _aggregate(kind, value))
                .alias(f"__whole_{name}")
                for name, (kind, value) in columns.items()
            ])
        )
        before = Window.partitionBy(*self.entity).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carry = whole.select(
            *[F.col(c).alias(f"__key_{c}") for c in (*self.entity, _BLOCK)],
            *[
                _merge(kind, F.col(f"__whole_{name}")).over(before).alias(f"__carry_{name}")
                for name, (kind, _) in columns.items()
            ],
        )
        # A NULL key is an entity like any other.
        same = [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in (*self.entity, _BLOCK)]
        joined = self.df.withColumns(local).join(carry, same, "left").drop(*[f"__key_{c}" for c in (*self.entity, _BLOCK)])
        merged = {
            name: _finish(kind, _combine(kind, F.col(name), F.col(f"__carry_{name}")))
            for name, (kind, _) in columns.items()
        }
        return self._with(joined.withColumns(merged).drop(*[f"__carry_{n}" for n in columns]))

    def numbered(self, name: str, start: int = 1) -> DataFrame:
        """Add the row number within the entity."""
        return self.numbered_log(name, start)._plain()

    def numbered_log(self, name: str, start: int = 1) -> EntityLog:
        if not self.is_cut:
            return self._with(self.df.withColumn(name, F.row_number().over(self.window()).cast("long") + F.lit(start - 1)))
        within = F.row_number().over(self.window()) - 1
        position = F.coalesce(F.col(_POS), within.cast("long"))
        return self._with(self.df.withColumn(name, position + F.lit(start)))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> EntityLog:
        """Apply a row-wise change (added columns) without losing the cut."""
        return self._with(change(self.df))

    def regroup(self, entity: Sequence[str], order: Sequence[str], sized_by: DataFrame | None = None, slice_rows: int | None = None) -> EntityLog:
        """The same rows under another key. A finer key of a log that was not cut needs no new size check."""
        if not self.is_cut and set(self.entity) <= set(entity):
            return EntityLog(self.df, tuple(entity), tuple(order))
        return entity_log(self.result, entity, order, slice_rows, sized_by)

    def _with(self, df: DataFrame) -> EntityLog:
        return EntityLog(df, self.entity, self.order, self.block_rows)

    def _plain(self) -> DataFrame:
        return self.df.drop(_SEQ, _BLOCK, _POS) if self.is_cut else self.df

    result = property(_plain)


def entity_log(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], slice_rows: int | None = None, sized_by: DataFrame | None = None
) -> EntityLog:
    """Wrap ``df``; cut its entities into blocks if one is larger than ``slice_rows``.

    The size check is one partial aggregate over the key columns only. Where
    ``df`` is derived, ``sized_by`` names a cheaper table with the same keys and
    at least as many rows, such as the log that ``df`` adds columns to.
    """
    slice_rows = slice_rows or SLICE_ROWS
    sizes = (df if sized_by is None else sized_by).groupBy(*entity).count()
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    if largest is None or largest <= slice_rows:
        return EntityLog(df, tuple(entity), tuple(order))
    return EntityLog(_cut(df, entity, order, slice_rows, total), tuple(entity), tuple(order), slice_rows)


def ranked(df: DataFrame, scores: Sequence[Column], ties: Sequence[str], name: str, slice_rows: int | None = None) -> DataFrame:
    """Position of each row over the whole table, largest ``scores`` first and NULL last."""
    keys = [f"__score{i}" for i in range(len(scores))]
    keyed = df.withColumns({k: -c for k, c in zip(keys, scores)}).withColumn("__whole", F.lit(0))
    log = entity_log(keyed, ["__whole"], [*keys, *ties], slice_rows)
    return log.numbered(name).drop("__whole", *keys)


def _cut(df: DataFrame, entity: Sequence[str], order: Sequence[str], slice_rows: int, total: int) -> DataFrame:
    ranges = math.ceil(total / slice_rows) + 1
    keys = [*[F.col(c).asc_nulls_last() for c in entity], *[F.col(c).asc_nulls_last() for c in order]]
    # The number of the range is in the upper 31 bits of the id, the row in the lower 33.
    # It is stored with the row, so a retried task can never renumber anything.
    numbered = materialise(
        df.repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SEQ, F.monotonically_increasing_id()),
        "log",
    ).withColumn(_RANGE, F.shiftright(F.col(_SEQ), 33))
    parts = numbered.groupBy(*entity, _RANGE).agg(
        F.count(F.lit(1)).alias("__n"), F.min(_SEQ).alias("__first")
    )
    by_entity = Window.partitionBy(*entity)
    before = by_entity.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    straddling = (
        parts.withColumns({
            "__parts": F.count(F.lit(1)).over(by_entity),
            "__before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
        })
        .filter(F.col("__parts") > 1)
        .select(
            *[F.col(c).alias(f"__key_{c}") for c in entity],
            F.col(_RANGE).alias("__key_range"),
            (F.col("__before") - F.col("__first")).alias("__shift"),
        )
    )
    match = F.col(_RANGE) == F.col("__key_range")
    for c in entity:
        match = match & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    return (
        numbered.join(straddling, match, "left")
        .withColumn(_POS, F.col(_SEQ) + F.col("__shift"))
        .withColumn(_BLOCK, F.coalesce(F.floor(F.col(_POS) / slice_rows), F.lit(0)))
        .drop("__shift", "__key_range", _RANGE, *[f"__key_{c}" for c in entity])
    )


def _aggregate(kind: str, value: Column) -> Column:
    match kind:
        case "sum":
            return F.sum(value)
        case "count":
            return F.count(value)
        case "max":
            return F.max(value)
        case "min":
            return F.min(value)
        case "last":
            return F.last(value, ignorenulls=True)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _merge(kind: str, value: Column) -> Column:
    return F.sum(value) if kind in ("sum", "count") else _aggregate(kind, value)


def _combine(kind: str, local: Column, carried: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if kind == "max":
        return F.greatest(local, carried)
    if kind == "min":
        return F.least(local, carried)
    return F.coalesce(local, carried)


def _finish(kind: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if kind in ("sum", "count") else value
