"""Data-quality checks. Each returns rows (check, status, metric, detail).

A check is one aggregate over its table; the rows of a stage are a union.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.sets import union_by_name

COLUMNS = ("check", "status", "metric", "detail")


class QualityError(ValueError):
    """A check of a strict stage failed."""


def _result(df: DataFrame, check: str | Column, metric: Column, fail: Column, warn: Column | None = None, detail: Column | None = None) -> DataFrame:
    status = F.when(fail, "FAIL")
    if warn is not None:
        status = status.when(warn, "WARN")
    return df.select(
        (F.lit(check) if isinstance(check, str) else check).alias("check"),
        status.otherwise("PASS").alias("status"),
        metric.cast("double").alias("metric"),
        (F.lit("") if detail is None else detail.cast("string")).alias("detail"),
    )


def row_counts(tables: Mapping[str, DataFrame], least: int = 10) -> DataFrame:
    """Empty tables fail, small ones warn."""
    n = F.col("n")
    return union_by_name([
        _result(df.agg(F.count(F.lit(1)).alias("n")), f"rows:{name}", n, n == 0, n < least) for name, df in tables.items()
    ])


def key_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    surplus = counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))
    return _result(surplus, f"unique:{name}", F.col("surplus"), F.col("surplus") > 0)


def future_dates(df: DataFrame, date: str, today: Column, name: str) -> DataFrame:
    """Dates after tomorrow."""
    late = df.agg(F.count_if(F.col(date) > F.date_add(today, 1)).alias("n"))
    return _result(late, f"future:{name}", F.col("n"), F.col("n") > 0)


def season_range(df: DataFrame, season: str, current: Column, name: str, first: int = 194647) -> DataFrame:
    """Season codes outside the known range, with the range found."""
    s = F.col(season)
    found = df.agg(F.count_if((s < first) | (s > current)).alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi"))
    return _result(found, f"season:{name}", F.col("n"), F.col("n") > 0, detail=F.concat_ws("-", "lo", "hi"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_rate) of many columns from one aggregate."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in columns
    ])))


def null_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> DataFrame:
    """Columns that are mostly NULL fail; partly NULL ones warn."""
    rate = F.col("null_rate")
    return _result(null_rates(df, columns), F.concat(F.lit("nulls:"), "column"), rate, rate >= limit, rate > 0)


def guard_null_rates(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> DataFrame:
    """``df`` itself, or an error naming the features that are mostly NULL."""
    bad = null_rates(df, columns).filter(F.col("null_rate") >= limit).select("column").collect()
    if bad:
        raise QualityError(f"mostly NULL features: {sorted(r[0] for r in bad)}")
    return df


def _two_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row with the sizes of two tables as ``n`` and ``m``."""
    n = first.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(0).cast("long").alias("m"))
    m = second.agg(F.count(F.lit(1)).alias("m")).select(F.lit(0).cast("long").alias("n"), "m")
    return n.unionByName(m).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def row_ratio(contests: DataFrame, log: DataFrame, name: str, tolerance: float = 0.05) -> DataFrame:
    """Contest rows against half the log rows."""
    sides = _two_counts(contests, log)
    ratio = F.coalesce(F.try_divide(F.col("n"), F.col("m") / 2), F.lit(0.0))
    return _result(sides, f"ratio:{name}", ratio, F.abs(ratio - 1) > tolerance)


def value_ranges(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside [low, high] per column; None is unbounded."""

    def outside(c: str) -> Column:
        low, high = ranges[c]
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        return F.count_if(bad).alias(c)

    counts = df.agg(*[outside(c) for c in ranges]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in ranges
    ])))
    return _result(counts, F.concat(F.lit("range:"), "column"), F.col("n"), F.col("n") > 0)


def rate_ranges(df: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """Ranges by column name: rates in [0, 1], rest and counts not negative."""
    ranges: dict[str, tuple[float | None, float | None]] = {}
    for c in df.columns:
        if "win_pct" in c or c.endswith("_rate") or "prob" in c:
            ranges[c] = (0.0, 1.0)
        elif "rest" in c or c.endswith("_pct"):
            ranges[c] = (0.0, None)
    return ranges


def required_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Expected columns that the schema lacks, next to the row count."""
    missing = [c for c in columns if c not in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    return _result(counted, f"columns:{name}", F.lit(len(missing)), F.lit(bool(missing)), detail=F.lit(",".join(missing)))


def fill_rates(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """A family of columns that is entirely NULL fails; the metric is its best fill rate."""
    best = df.agg(*[
        F.greatest(*[F.avg(F.col(c).isNotNull().cast("double")) for c in columns], F.lit(0.0)).alias(name)
        for name, columns in families.items()
    ]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("fill")) for n in families])))
    return _result(best, F.concat(F.lit("filled:"), "family"), F.col("fill"), F.col("fill") == 0)


def probabilities(df: DataFrame, home: str, away: str, name: str, tolerance: float = 0.05) -> DataFrame:
    """Probabilities outside [0, 1] fail; pairs that do not sum to one warn."""
    outside = lambda c: ~F.col(c).between(0, 1)
    counts = df.agg(
        F.count_if(outside(home) | outside(away)).alias("bad"),
        F.count_if(F.abs(F.col(home) + F.col(away) - 1) > tolerance).alias("off"),
    )
    inside = _result(counts, f"probability:{name}", F.col("bad"), F.col("bad") > 0)
    return inside.unionByName(_result(counts, f"sum:{name}", F.col("off"), F.lit(False), F.col("off") > 0))


def run_stage(stage: str, checks: Mapping[str, Callable[[], DataFrame]], strict: bool = False) -> DataFrame:
    """All checks of a stage as one table; ``strict`` raises on the first that fails."""
    results = []
    for name, check in checks.items():
        result = check()
        if strict:
            failed = result.filter(F.col("status") == "FAIL").limit(1).collect()
            if failed:
                raise QualityError(f"{stage}/{name}: {failed[0]['check']} {failed[0]['metric']}")
        results.append(result)
    return union_by_name(results).select(F.lit(stage).alias("stage"), *COLUMNS)


def join_cardinality(before: DataFrame, after: DataFrame, name: str, most_lost: float = 0.1) -> DataFrame:
    """Warn when a join multiplied rows or dropped more than ``most_lost`` of them."""
    counts = _two_counts(before, after)
    ratio = F.coalesce(F.try_divide(F.col("m"), F.col("n")), F.lit(1.0))
    return _result(counts, f"join:{name}", ratio, F.lit(False), (ratio > 1) | (ratio < 1 - most_lost))
