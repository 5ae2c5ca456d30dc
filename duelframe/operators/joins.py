"""Joins between entity logs, contests, dimensions and validity intervals.

Equi keys always come first, OR conditions are turned into canonical keys, and
no join builds all pairs of a group. Small sides are left to Spark's own size
check (``spark.sql.autoBroadcastJoinThreshold``); only sides whose size is a
fixed number of rows carry a broadcast hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.ordered import entity_log
from duelframe.operators.topk import first_row

# Seasons of each era, both ends included.
ERAS = (
    ("Foundational", 194647, 195354),
    ("Shot Clock Era", 195455, 197879),
    ("3-Point Introduction", 197980, 199394),
    ("Physical / Isolation", 199495, 200304),
    ("Open Court", 200405, 201415),
    ("3-Point Revolution", 201516, 999999),
)


def opponent_lookup(df: DataFrame, keys: Sequence[str], entity: str, opponent: str, columns: Mapping[str, str]) -> DataFrame:
    """Left self-join that fetches ``{column: new name}`` from the opponent's row of the same contest."""
    other = df.select(
        *keys, F.col(entity).alias(opponent), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return df.join(other, [*keys, opponent], "left")


def opponent_columns(df: DataFrame, keys: Sequence[str], entity: str, opponent: str, columns: Sequence[str], prefix: str = "opp_") -> DataFrame:
    """Add the other side's ``columns`` to each row; rows without another side in the contest get NULLs.

    A left join on the contest and the opponent's name: a contest that lacks a side keeps the one it has.
    """
    other = df.select(
        *[F.col(c).alias(f"__key_{c}") for c in keys], F.col(entity).alias("__other"),
        *[F.col(c).alias(f"{prefix}{c}") for c in columns],
    )
    match = [F.col(c) == F.col(f"__key_{c}") for c in keys] + [F.col(opponent) == F.col("__other")]
    return df.join(other, match, "left").drop("__other", *[f"__key_{c}" for c in keys])


def two_sided(df: DataFrame, keys: Sequence[str], home_flag: str, columns: Sequence[str], home: str = "home_", away: str = "away_", shared: Sequence[str] = ()) -> DataFrame:
    """Entity log to one row per contest with both sides' columns; contests without both sides drop out. ``shared`` is taken from the home side only.

    One hash aggregate on the contest key, a value per side and column, instead of a join of two filtered copies,
    so that the features of the log are computed once. Each side has one row per contest.
    """
    sides = [(1, home), (0, away)]
    values = [F.expr(f"max(CASE WHEN `{home_flag}` = {flag} THEN `{c}` END) AS `{prefix}{c}`") for flag, prefix in sides for c in columns]
    values += [F.expr(f"max(CASE WHEN `{home_flag}` = 1 THEN `{c}` END) AS `{c}`") for c in shared]
    there = [F.count_if(F.col(home_flag) == flag).alias(f"__there{flag}") for flag, _ in sides]
    return df.groupBy(*keys).agg(*values, *there).filter("__there1 > 0 AND __there0 > 0").drop("__there1", "__there0")


def as_of_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tie: str, columns: Sequence[str], slice_rows: int | None = None) -> DataFrame:
    """For each left row, ``columns`` of the last right row at or before its time.

    Both sides form one ordered log; the last right row seen is a running
    aggregate, so a key of any size can be cut into blocks. ``tie`` orders rows
    of the same side and time and exists on both sides. A NULL key matches nothing.
    """
    for c in keys:
        right = right.filter(F.col(c).isNotNull())
    value = F.struct(*columns)
    empty = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    events = left.select(
        *keys, F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"),
        F.struct(*left.columns).alias("__left"), empty.alias("__right"),
    ).unionByName(right.select(
        *keys, F.col(right_time).alias("__time"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"),
        value.alias("__right"),
    ), allowMissingColumns=True)
    log = entity_log(events, keys, ["__time", "__side", "__tie"], slice_rows)
    seen = log.running({"__match": ("last", F.col("__right"))}, include_current=True)
    return seen.filter(F.col("__side") == 1).select("__left.*", *[F.col(f"__match.{c}").alias(c) for c in columns])


def valid_on(status: DataFrame, dates: DataFrame, entity: Sequence[str], group: Sequence[str], since: str, date: str, max_days: int = 25, where: Column | None = None, slice_rows: int | None = None) -> DataFrame:
    """Status rows that are valid on the dates of their group.

    A status holds from the day after ``since`` until the entity's next status,
    at most ``max_days``. ``where`` filters the statuses after the end of each is
    known. Each validity is spread over the one or two date ranges of
    ``max_days`` that it touches, which gives the join a second equi key: a large
    group is spread over its date ranges.
    """
    # Newest first, the next status is the row before.
    newest = status.withColumn("__ago", -F.unix_date(since))
    ending = entity_log(newest, entity, ["__ago"], slice_rows).lagged(
        1, lambda w: {"__until": F.lag(since).over(w)}
    ).drop("__ago")
    if where is not None:
        ending = ending.filter(where)
    number = lambda c: F.floor(F.date_diff(c, F.lit("1970-01-01").cast("date")) / max_days)
    spread = ending.withColumn(
        "__range", F.explode(F.sequence(number(F.date_add(since, 1)), number(F.date_add(since, max_days))))
    )
    ranged = dates.withColumn("__range", number(F.col(date)))
    later = F.col(date) > F.col(since)
    in_time = F.date_diff(F.col(date), F.col(since)) <= max_days
    replaced = F.col("__until").isNotNull() & (F.col(date) >= F.col("__until"))
    return (
        spread.join(ranged, [*group, "__range"]).filter(later & in_time & ~replaced).drop("__range", "__until")
    )


def missing_from(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected rows without an actual counterpart."""
    return expected.join(actual.select(*keys), list(keys), "left_anti")


def enrich(df: DataFrame, dimension: DataFrame, keys: Sequence[str], fills: Mapping[str, float] | None = None) -> DataFrame:
    """Left join of a dimension that has one row per key, with fills for unmatched rows."""
    joined = df.join(dimension, list(keys), "left")
    return joined.fillna(dict(fills)) if fills else joined


def both_sides_context(df: DataFrame, context: DataFrame, game: str, team: str, opponent: str, columns: Sequence[str]) -> DataFrame:
    """Attach the context of the own team and of the opponent, prefixed ``team_`` and ``opp_``."""
    own = context.select(game, team, *[F.col(c).alias(f"team_{c}") for c in columns])
    other = context.select(game, F.col(team).alias(opponent), *[F.col(c).alias(f"opp_{c}") for c in columns])
    return df.join(own, [game, team], "left").join(other, [game, opponent], "left")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lookup table of a keyed log: the last row per key."""
    return first_row(df, keys, [F.col(c).desc_nulls_last() for c in order])


def map_names(df: DataFrame, name: str, mapping: DataFrame, label: str, code: str, out: str) -> DataFrame:
    """Code of a name: exact match, then trimmed lower case, else the name itself."""
    exact = first_row(mapping, [label], [code]).select(F.col(label).alias("__exact"), F.col(code).alias("__code1"))
    relaxed = mapping.select(F.lower(F.trim(label)).alias("__relaxed"), F.col(code).alias("__code2"))
    relaxed = first_row(relaxed, ["__relaxed"], ["__code2"])
    return (
        df.join(exact, F.col(name) == F.col("__exact"), "left")
        .join(relaxed, F.lower(F.trim(F.col(name))) == F.col("__relaxed"), "left")
        .withColumn(out, F.coalesce("__code1", "__code2", name))
        .drop("__exact", "__relaxed", "__code1", "__code2")
    )


def unmapped_names(df: DataFrame, name: str, mapping: DataFrame, label: str) -> DataFrame:
    """Distinct names without any mapping, with their row counts."""
    known = mapping.select(F.lower(F.trim(label)).alias("__known")).distinct()
    counted = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(known, F.lower(F.trim(F.col(name))) == F.col("__known"), "left_anti")


def text_key(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def canonical_pair(a: str, b: str) -> dict[str, Column]:
    """The two sides in a fixed order, so that meetings in either role share a key."""
    return {"side_a": F.least(F.col(a), F.col(b)), "side_b": F.greatest(F.col(a), F.col(b))}


def met_pairs(contests: DataFrame, home: str, away: str) -> DataFrame:
    """Every ordered pair of entities that have met, each in both orders."""
    pairs = contests.select(
        F.explode(F.array(F.struct(F.col(home).alias("a"), F.col(away).alias("b")),
                          F.struct(F.col(away).alias("a"), F.col(home).alias("b")))).alias("p")
    )
    return pairs.select("p.a", "p.b").distinct()


def era_of(code: Column, unknown: str = "Unknown") -> Column:
    """Era name of a season code. Six closed intervals need no join."""
    chain = F.when(code.isNull(), unknown)
    for name, first, last in ERAS:
        chain = chain.when(code.between(first, last), name)
    return chain.otherwise(unknown)


def in_interval(df: DataFrame, point: str, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Left join with a table of closed intervals, of which the last that starts at or before a point counts.

    That interval is found as of the point, and its end is checked; for disjoint intervals it is the only one
    that can match. NULL points and intervals match nothing.
    """
    left = df.withColumns({"__whole": F.lit(0), "__tie": F.col(point)})
    right = intervals.filter(F.col(start).isNotNull()).withColumns({"__whole": F.lit(0), "__tie": F.col(start)})
    names = intervals.columns
    found = as_of_backward(left, right, ["__whole"], point, start, "__tie", names)
    inside = F.col(point) <= F.col(end)
    return found.select(*df.columns, *[F.when(inside, F.col(c)).alias(c) for c in names])


def forbid_columns(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error if it holds a column that would leak the result."""
    leaked = sorted(set(df.columns) & set(forbidden))
    if leaked:
        raise ValueError(f"columns that leak the result: {leaked}")
    return df
