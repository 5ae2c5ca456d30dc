"""Latest rows, top-n per group, deduplication.

Ranking filters of the form ``row_number() <= n`` keep at most ``n`` rows per
group and task before the shuffle, so a large group never travels whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.ordered import entity_log


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in ``order``; ``rank`` keeps their 1-based position."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_columns(order))))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in a total order."""
    return first_rows(df, keys, order, 1)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in a total order."""
    return first_row(df, keys, [F.col(c).desc_nulls_last() for c in order])


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over the last ``n`` rows per key."""
    newest = [F.col(c).desc_nulls_last() for c in order]
    return first_rows(df, keys, newest, n).groupBy(*keys).agg(*aggregates)


def latest_nonnull(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, the latest value of each column that is not NULL."""
    position = F.struct(*order)
    return df.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in columns
    ])


def latest_array(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int, name: str = "latest") -> DataFrame:
    """The last ``n`` rows per key as an array of structs, newest first.

    The rows are limited before they are collected, so an array never grows with its key.
    """
    newest = [F.col(c).desc_nulls_last() for c in order]
    kept = first_rows(df, keys, newest, n, rank="__rank")
    items = F.array_sort(F.collect_list(F.struct("__rank", *columns)))
    bare = F.transform(items, lambda i: F.struct(*[i[c].alias(c) for c in columns]))
    return kept.groupBy(*keys).agg(bare.alias(name))


PAGE_ROWS = 10_000


def paged_array(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """All rows of a key as arrays of structs in order, at most ``page_rows`` to an array.

    A key of any size becomes as many ``page`` rows as it needs; nothing is dropped.
    """
    numbered = entity_log(df, keys, order).numbered("__n", start=0)
    item = F.struct("__n", *columns)
    bare = F.transform(F.array_sort(F.collect_list(item)), lambda i: F.struct(*[i[c].alias(c) for c in columns]))
    paged = numbered.withColumn("page", F.floor(F.col("__n") / page_rows))
    return paged.groupBy(*keys, "page").agg(bare.alias(name))


def heaviest(df: DataFrame, keys: Sequence[str], weight: str, ties: Sequence[str], minimum: float = 0) -> DataFrame:
    """The row with the largest weight per key, if it reaches ``minimum``."""
    return first_row(df, keys, [F.col(weight).desc(), *ties]).filter(F.col(weight) >= minimum)


def pair_history(contests: DataFrame, home: str, away: str, order: Sequence[str], home_pts: str, away_pts: str, n: int = 10) -> DataFrame:
    """Last ``n`` meetings per pair in either role: record, mean total and the meetings, newest first."""
    first_at_home = F.col(home) < F.col(away)
    keyed = contests.select(
        F.least(home, away).alias("side_a"),
        F.greatest(home, away).alias("side_b"),
        *order,
        F.when(first_at_home, F.col(home_pts)).otherwise(F.col(away_pts)).alias("pts_a"),
        F.when(first_at_home, F.col(away_pts)).otherwise(F.col(home_pts)).alias("pts_b"),
        ((F.col(home_pts) >= F.col(away_pts)) == first_at_home).cast("int").alias("a_won"),
    )
    newest = [F.col(c).desc() for c in order]
    kept = first_rows(keyed, ["side_a", "side_b"], newest, n, rank="__rank")
    return kept.groupBy("side_a", "side_b").agg(
        F.count(F.lit(1)).alias("meetings"),
        F.sum("a_won").alias("wins_a"),
        F.avg(F.col("pts_a") + F.col("pts_b")).alias("mean_total"),
        F.array_sort(F.collect_list(F.struct("__rank", *order, "pts_a", "pts_b"))).alias("history"),
    ).withColumn("wins_b", F.col("meetings") - F.col("wins_a"))


def form_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, recent: int = 5, minimum: int = 10) -> DataFrame:
    """Mean of the last rows against the overall mean, for keys with enough rows."""
    overall = df.groupBy(*keys).agg(F.count(value).alias("games"), F.avg(value).alias("overall"))
    lately = last_n(df, keys, order, recent, [F.avg(value).alias("recent")])
    return (
        overall.filter(F.col("games") >= minimum)
        .join(lately, list(keys))
        .withColumn("gap", F.col("recent") - F.col("overall"))
    )


def hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, at_least: float = 5.0, n: int = 4, recent: int = 5, minimum: int = 10) -> DataFrame:
    """The ``n`` keys whose recent mean is furthest above their overall mean."""
    gaps = form_gap(df, keys, order, value, recent, minimum).filter(F.col("gap") >= at_least)
    return gaps.orderBy(F.col("gap").desc(), *keys).limit(n)


def cold(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, at_least: float, n: int = 4, recent: int = 5, minimum: int = 10) -> DataFrame:
    """The ``n`` keys whose recent mean is furthest below their overall mean."""
    gaps = form_gap(df, keys, order, value, recent, minimum).filter(F.col("gap") <= -at_least)
    return gaps.orderBy(F.col("gap").asc(), *keys).limit(n)


def top_by_mean(df: DataFrame, group: Sequence[str], member: str, value: str, n: int = 5) -> DataFrame:
    """Top ``n`` members per group by mean value."""
    means = df.groupBy(*group, member).agg(F.avg(value).alias("mean"))
    return first_rows(means, group, [F.col("mean").desc_nulls_last(), member], n, rank="rank")


def records(df: DataFrame, name: str, values: Sequence[str], ties: Sequence[str], n: int = 15) -> DataFrame:
    """Largest single values of each measure, one entry per (name, value), ranked within the measure."""
    long = df.select(name, *ties, *values).unpivot([name, *ties], list(values), "measure", "value")
    once = first_row(long, ["measure", name, "value"], list(ties))
    return first_rows(once, ["measure"], [F.col("value").desc_nulls_last(), name, *ties], n, rank="rank")


def latest_dates(df: DataFrame, date: str, n: int = 3) -> DataFrame:
    """Rows of the latest ``n`` distinct dates."""
    days = df.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
    return df.join(F.broadcast(days), date, "left_semi")


def on_date_or_latest(df: DataFrame, date: str, target: Column) -> DataFrame:
    """Rows of the target date, or of the latest date present if there are none."""
    chosen = df.agg(F.coalesce(F.max(F.when(F.col(date) == target, F.col(date))), F.max(date)).alias(date))
    return df.join(F.broadcast(chosen), date, "left_semi")
