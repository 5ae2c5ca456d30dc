"""Logs of few, large entities whose games join two of them, cut into blocks of whole days.

Where all entities are ordered by the same date, a block of days holds both sides of a game and a part of every entity. A narrow
log is dealt to its blocks twice; in between, what an entity has before a block is a small table (``carried``), and the last rows before a
block go with it as a halo. The wide rows that windows make never leave their block: bringing both sides together needs no shuffle of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.storage import materialise

BLOCK_ROWS = 150_000
BLOCK, HALO, PLACE = "__days", "__before", "__nth"
#: The halo may be this share of a block at most; a day may be this many blocks.
HALO_SHARE, DAY_BLOCKS = 4, 8


@dataclass(frozen=True)
class DayBlocks:
    """The block of each date, and the rows of each (entity, date)."""

    table: DataFrame
    daily: DataFrame
    blocks: int
    entity: str
    date: str

    def deal(self, df: DataFrame) -> DataFrame:
        """Rows with their block, each block in a task of its own."""
        return df.join(self.table, self.date).repartitionById(self.blocks, F.col(BLOCK))


def day_blocks(log: DataFrame, entity: str, date: str, known: Sequence[str], look_back: int, block_rows: int | None = None) -> DayBlocks | None:
    """Blocks of about ``block_rows`` rows, or None where the log is better taken by entity.

    That is: it fits into two blocks, a column of ``known`` has a NULL, a single day is too large, or there are so many entities that
    ``look_back`` rows of each are much against a block.
    """
    block_rows = block_rows or BLOCK_ROWS
    missing = F.count_if(F.greatest(F.lit(False), *[F.col(c).isNull() for c in known])).alias("missing")
    daily = materialise(log.groupBy(entity, date).agg(F.count(F.lit(1)).alias("rows"), missing), "daily", once=True)
    days = daily.groupBy(date).agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    total, largest, nulls = days.agg(F.sum("rows"), F.max("rows"), F.sum("missing")).first()
    if not total or total <= 2 * block_rows or nulls or largest > DAY_BLOCKS * block_rows:
        return None
    if daily.select(entity).distinct().count() * look_back * HALO_SHARE > block_rows:
        return None
    # one row per date
    before = F.coalesce(F.sum("rows").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = days.select(date, F.floor(before / block_rows).alias("at"))
    table = materialise(cut.select(date, (F.dense_rank().over(Window.orderBy("at")) - 1).cast("int").alias(BLOCK)), "days", once=True)
    return DayBlocks(table, daily, table.agg(F.max(BLOCK)).first()[0] + 1, entity, date)


def carried(parts: DataFrame, keys: Sequence[str], sums: Sequence[str], lasts: Sequence[str] = (), positions: Mapping[str, str] | None = None) -> DataFrame:
    """What ``keys`` have before each of their blocks, from one row per (block, keys); stored.

    ``sums`` are added up and ``lasts`` taken from the block before. ``positions`` are positions within a block, whose size is the named column
    of ``sums``: the largest earlier one, counted from the start.
    """
    order = Window.partitionBy(*keys).orderBy(BLOCK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumns({f"__{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums} | {f"__{c}": F.lag(c).over(order) for c in lasts})
    placed = {f"__{c}": F.max(F.col(c) + F.col(f"__{size}")).over(before) for c, size in (positions or {}).items()}
    named = {c: F.col(f"__{c}") for c in (*sums, *lasts, *(positions or {}))}
    return materialise(summed.withColumns(placed).select(BLOCK, *keys, *[c.alias(f"carried_{n}") for n, c in named.items()]), "carried", once=True)


def with_halo(rows: DataFrame, blocks: DayBlocks, look_back: int) -> DataFrame:
    """Rows dealt to their blocks, each block with the last ``look_back`` earlier rows of its entities, marked by ``HALO``.

    ``PLACE`` is the row's number within (block, entity) from 1; it becomes its number within the entity from 0.
    """
    entity = blocks.entity
    sizes = rows.groupBy(BLOCK, entity).agg(F.count(F.lit(1)).alias("rows"))
    starts = carried(sizes, [entity], ["rows"])
    by_entity = Window.partitionBy(entity)
    # A block reaches into every earlier one whose end is less than the look-back before its start: those before the blocks that start there.
    reached = F.collect_list("earlier").over(by_entity.orderBy("carried_rows").rangeBetween(-(look_back - 1), 0))
    sources = starts.withColumn("earlier", F.lag(BLOCK).over(by_entity.orderBy(BLOCK))).withColumn("reached", reached)
    reach = sources.select(entity, F.col(BLOCK).alias("b"), F.col("carried_rows").alias("start"), F.explode("reached").alias(BLOCK))
    later = reach.groupBy(BLOCK, entity).agg(F.collect_list(F.struct("b", "start")).alias("__later"))
    table = materialise(starts.join(later, [BLOCK, entity], "left"), "starts", once=True)
    placed = rows.join(table, [BLOCK, entity]).withColumn(PLACE, F.col("carried_rows") + F.col(PLACE) - 1)
    nothing = F.array().cast("array<int>")
    goes = F.transform(F.filter("__later", lambda t: F.col(PLACE) >= t["start"] - look_back), lambda t: t["b"])
    copies = F.explode(F.concat(F.array(BLOCK), F.coalesce(goes, nothing)))
    spread = placed.withColumn("__to", copies).withColumn(HALO, F.col("__to") != F.col(BLOCK)).drop(BLOCK, "carried_rows", "__later")
    return spread.withColumnRenamed("__to", BLOCK).repartitionById(blocks.blocks, F.col(BLOCK))


def calendar_counts(rows: DataFrame, blocks: DayBlocks, days: Sequence[int], prefix: str) -> DataFrame:
    """As ``windows.calendar_counts``, from the rows per day and the row's number within the entity (``PLACE``)."""
    entity, date = blocks.entity, blocks.date
    by_entity = Window.partitionBy(entity)
    in_days = by_entity.orderBy(F.date_diff(F.col(date), F.lit("1970-01-01").cast("date")))
    earlier = materialise(blocks.daily.select(
        entity, date, F.coalesce(F.sum("rows").over(by_entity.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__started"),
        *[F.coalesce(F.sum("rows").over(in_days.rangeBetween(-(n - 1), -1)), F.lit(0)).alias(f"__d{n}") for n in days]), "earlier-days", once=True)
    today = F.col(PLACE) - F.col("__started")
    counted = rows.join(earlier, [entity, date]).withColumns({f"{prefix}{n}_days": F.col(f"__d{n}") + today for n in days})
    return counted.drop("__started", *[f"__d{n}" for n in days])


def other_side(game: str, entity: str, opponent: str, columns: Mapping[str, Column]) -> Column:
    """``columns`` of the row of the same game that is the opponent's; NULL without one. For rows dealt to blocks."""
    sides = F.collect_list(F.struct(F.col(entity).alias("__side"), *[c.alias(n) for n, c in columns.items()])).over(Window.partitionBy(BLOCK, game))
    return F.get(F.filter(sides, lambda side: side["__side"] == F.col(opponent)), F.lit(0))
