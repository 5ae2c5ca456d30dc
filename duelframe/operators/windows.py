"""Leak-free window features: every value uses rows strictly before the current one.

All operators work on an ``EntityLog`` and return one, so a family of features
shares one partitioning and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from duelframe.functions.geo import great_circle_miles
from duelframe.operators.ordered import EntityLog, entity_log, ranked
from duelframe.operators.topk import first_rows


def means(w: WindowSpec, columns: Sequence[str], windows: Sequence[int], min_rows: int = 1) -> dict[str, Column]:
    """Mean of the previous ``n`` rows as ``<column>_roll<n>``; NULL below ``min_rows`` values."""
    return {f"{c}_roll{n}": _guarded(F.avg, c, w.rowsBetween(-n, -1), min_rows) for n in windows for c in columns}


def deviation(w: WindowSpec, column: str, window: int = 10, min_rows: int = 2, fill: float | None = 0.0) -> Column:
    """Sample standard deviation of the previous rows, ``fill`` below ``min_rows`` values."""
    value = _guarded(F.stddev_samp, column, w.rowsBetween(-window, -1), min_rows)
    return value if fill is None else F.coalesce(value, F.lit(fill))


def fitted_slope(w: WindowSpec, column: str, number: str, window: int = 5) -> Column:
    """Least-squares slope of the previous rows over their ``number``, 0 with fewer than two."""
    frame = w.rowsBetween(-window, -1)
    slope = F.regr_slope(F.col(column), F.col(number)).over(frame)
    return F.when(F.count(F.lit(1)).over(frame) >= 2, slope).otherwise(0.0)


def gap_days(w: WindowSpec, date: str, first: int = 7, cap: int = 14) -> Column:
    """Days since the previous row, ``first`` at the start, at most ``cap``."""
    return F.least(F.coalesce(F.date_diff(F.col(date), F.lag(date).over(w)), F.lit(first)), F.lit(cap))


def before(w: WindowSpec, condition: Column) -> Column:
    """1 if the previous row met ``condition``."""
    return F.coalesce(F.lag(condition.cast("int")).over(w), F.lit(0))


def moved_miles(w: WindowSpec, lat: str, lon: str) -> Column:
    """Miles from the previous location, 0 at the start."""
    miles = great_circle_miles(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    return F.coalesce(miles, F.lit(0.0))


def zone_change(w: WindowSpec, zone: str) -> Column:
    """1 if the zone differs from the previous row's."""
    return F.coalesce((F.lag(zone).over(w) != F.col(zone)).cast("int"), F.lit(0))


def _guarded(function, column: str, frame, min_rows: int) -> Column:
    value = function(column).over(frame)
    return value if min_rows <= 1 else F.when(F.count(column).over(frame) >= min_rows, value)


def lag_mean(log: EntityLog, columns: Sequence[str], windows: Sequence[int], min_rows: int = 1) -> EntityLog:
    """Add the mean of the previous rows, see ``means``."""
    return log.lagged_log(max(windows), lambda w: means(w, columns, windows, min_rows))


def stack_parts(w: WindowSpec, columns: Sequence[str], first: int) -> dict[str, Column]:
    """Sums and counts of the previous ``first`` rows, which ``stacked_means`` goes on from."""
    frame = w.rowsBetween(-first, -1)
    sums = {f"__sum_{c}": F.coalesce(F.sum(F.col(c).cast("double")).over(frame), F.lit(0.0)) for c in columns}
    return sums | {f"__count_{c}": F.count(c).over(frame) for c in columns}


def stacked_means(log: EntityLog, columns: Sequence[str], first: int, doublings: int) -> EntityLog:
    """``means`` of ``first``, twice as many, four times as many rows and so on, for a log that is not cut and has the ``stack_parts``.

    A window of twice the rows is a window and the same one as many rows earlier, so only the first one costs as much per row as it has rows. The sums are
    those of ``means`` up to the order of adding.
    """
    scratch = [f"__{part}_{c}" for part in ("sum", "count") for c in columns]
    ratio = lambda c: F.try_divide(F.col(f"__sum_{c}"), F.col(f"__count_{c}"))
    done = log.map(lambda df: df.withColumns({f"{c}_roll{first}": ratio(c) for c in columns}))
    for n in [first * 2**i for i in range(doublings)]:
        doubled = {name: F.col(name) + F.lag(name, n, 0).over(done.window()) for name in scratch}
        done = done.map(lambda df: df.withColumns(doubled).withColumns({f"{c}_roll{2 * n}": ratio(c) for c in columns}))
    return done.map(lambda df: df.drop(*scratch))


def lag_std(log: EntityLog, column: str, name: str, window: int = 10, min_rows: int = 2, fill: float | None = 0.0) -> EntityLog:
    """Add the standard deviation of the previous rows, see ``deviation``."""
    return log.lagged_log(window, lambda w: {name: deviation(w, column, window, min_rows, fill)})


def ewma_rows(span: int, epsilon: float = 1e-16) -> int:
    """Rows after which the weight of an exponential mean falls below ``epsilon``."""
    return math.ceil(math.log(epsilon) / math.log(1 - 2 / (span + 1)))


def ewma(log: EntityLog, columns: Sequence[str], spans: Sequence[int]) -> EntityLog:
    """Exponentially weighted mean of prior rows as ``<column>_ewma<span>``.

    Weight ``(1 - a) ** i`` with ``a = 2 / (span + 1)`` and ``i`` the row
    distance; a NULL takes up a position but adds nothing. As the weights are
    normalised, the mean stays what it was while only NULLs follow: it is
    computed at each value, then carried to the next one, however far that is.
    At a value, the rows of an entity are taken in chunks long enough for a weight
    to vanish against the value's own: the sums of its own chunk so far and of the
    chunk before suffice, so the cost per row does not depend on the span and no
    weight overflows.
    """
    size = max(ewma_rows(s) for s in spans)
    # The largest factor is keep ** -size of the shortest span; keep it far from overflow.
    if max(-size * math.log(1 - 2 / (s + 1)) for s in spans) > 600:
        shortest, *others = sorted(spans)
        return ewma(ewma(log, columns, [shortest]), columns, others)
    position = F.col("__n") % size
    chunked = log.numbered_log("__n", start=0).map(lambda df: df.withColumn("__chunk", F.floor(F.col("__n") / size)))
    names = {(c, s): f"{c}_ewma{s}" for s in spans for c in columns}

    def build(_):
        own = log.window("__chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = Window.partitionBy(*log.keys).orderBy("__chunk").rangeBetween(-1, -1)

        def mean(c: str, span: int) -> Column:
            keep = F.lit(1 - 2 / (span + 1))
            grow = F.pow(keep, -position)

            def decayed(value: Column) -> Column:
                here = F.sum(value).over(own) * F.pow(keep, position)
                there = F.coalesce(F.sum(value).over(earlier), F.lit(0.0)) * F.pow(keep, position + size)
                return here + there

            weight = decayed(F.when(F.col(c).isNotNull(), grow))
            return F.when(F.col(c).isNotNull(), F.try_divide(decayed(F.col(c) * grow), weight))

        return {f"__at_{name}": mean(c, s) for (c, s), name in names.items()}

    at_values = chunked.lagged_log(2 * size, build)
    carried = at_values.running_log({name: ("last", F.col(f"__at_{name}")) for name in names.values()})
    return carried.map(lambda df: df.drop("__n", "__chunk", *[f"__at_{name}" for name in names.values()]))


def expanding_means(log: EntityLog, columns: Mapping[str, Column], fill: float | None = None) -> EntityLog:
    """Add means of all prior non-null values, in one pass."""
    parts = {}
    for name, column in columns.items():
        parts[f"__sum_{name}"] = ("sum", column.cast("double"))
        parts[f"__n_{name}"] = ("count", column)

    def mean(name: str) -> Column:
        value = F.try_divide(F.col(f"__sum_{name}"), F.col(f"__n_{name}"))
        return value if fill is None else F.coalesce(value, F.lit(fill))

    return log.running_log(parts).map(lambda df: df.withColumns({n: mean(n) for n in columns}).drop(*parts))


def expanding_mean(log: EntityLog, column: Column, name: str, fill: float | None = None) -> EntityLog:
    """Add the mean of all prior non-null values."""
    return expanding_means(log, {name: column}, fill)


def cumulative_record(log: EntityLog, flag: str, wins: str = "cum_wins", losses: str = "cum_losses", rate: str = "cum_win_pct", empty: float = 0.5) -> EntityLog:
    """Wins, losses and rate before this row."""
    counted = log.running_log({wins: ("sum", F.col(flag)), losses: ("sum", 1 - F.col(flag))})
    played = F.col(wins) + F.col(losses)
    return counted.map(lambda df: df.withColumn(rate, F.coalesce(F.try_divide(F.col(wins), played), F.lit(empty))))


def slope(log: EntityLog, column: str, name: str, window: int = 5) -> EntityLog:
    """Add the least-squares slope of the previous rows, see ``fitted_slope``."""
    numbered = log.numbered_log("__n")
    return numbered.lagged_log(window, lambda w: {name: fitted_slope(w, column, "__n", window)}).map(lambda df: df.drop("__n"))


def run_lengths(log: EntityLog, flag: str, name: str) -> EntityLog:
    """Signed length of the run of equal flags that ends at this row."""
    numbered = log.numbered_log("__n").lagged_log(1, lambda w: {"__before": F.lag(flag).over(w)})
    changed = F.col("__before").isNull() | (F.col("__before") != F.col(flag))
    starts = numbered.running_log({"__start": ("max", F.when(changed, F.col("__n")))}, include_current=True)
    length = F.col("__n") - F.col("__start") + 1
    return starts.map(
        lambda df: df.withColumn(name, F.when(F.col(flag) == 1, length).otherwise(-length)).drop(
            "__n", "__before", "__start"
        )
    )


def streak(log: EntityLog, flag: str, name: str = "streak") -> EntityLog:
    """Signed run length entering each row, 0 at the start."""
    return (
        run_lengths(log, flag, "__run")
        .lagged_log(1, lambda w: {name: F.coalesce(F.lag("__run").over(w), F.lit(0))})
        .map(lambda df: df.drop("__run"))
    )


def days_since(log: EntityLog, date: str, name: str = "days_rest", first: int = 7, cap: int = 14) -> EntityLog:
    """Add the days since the previous row and a flag for 0 or 1 day, see ``gap_days``."""
    return log.lagged_log(1, lambda w: {name: gap_days(w, date, first, cap)}).map(
        lambda df: df.withColumn("is_back_to_back", (F.col(name) <= 1).cast("int"))
    )


def _day_number(date: str) -> Column:
    return F.date_diff(F.col(date), F.lit("1970-01-01").cast("date"))


def calendar_counts_within(df: DataFrame, entity: Sequence[str], date: str, order: Sequence[str], days: Sequence[int], prefix: str = "rows_last_") -> DataFrame:
    """``calendar_counts`` for entities that fit into one task each."""
    by_day = Window.partitionBy(*entity).orderBy(_day_number(date))
    today = F.row_number().over(Window.partitionBy(*entity, date).orderBy(*order)).cast("long") - 1
    return df.withColumns({
        f"{prefix}{n}_days": F.count(F.lit(1)).over(by_day.rangeBetween(-(n - 1), -1)) + today for n in days
    })


def calendar_counts(df: DataFrame, entity: Sequence[str], date: str, order: Sequence[str], days: Sequence[int], prefix: str = "rows_last_", slice_rows: int | None = None, sized_by: DataFrame | None = None) -> DataFrame:
    """Earlier rows with a date in the last ``N`` calendar days, same-day rows included.

    Rows of earlier days are counted by a range frame, rows of the same day by
    the position within the day. Where an entity is too large for one task, the
    frame runs on one row per (entity, day) and is joined back.
    """
    log = entity_log(df, entity, [date, *order], slice_rows, sized_by)
    if not log.is_cut:
        return calendar_counts_within(df, entity, date, order, days, prefix)
    names = {n: f"{prefix}{n}_days" for n in days}
    number = _day_number(date)
    daily = df.groupBy(*entity, date).agg(F.count(F.lit(1)).alias("__rows"))
    w = Window.partitionBy(*entity).orderBy(number)
    earlier = daily.select(
        *entity,
        date,
        *[F.coalesce(F.sum("__rows").over(w.rangeBetween(-(n - 1), -1)), F.lit(0)).alias(f"__d{n}") for n in days],
    )
    placed = entity_log(df, [*entity, date], order, slice_rows, sized_by).numbered("__today", start=0)
    keys = [*entity, date]
    earlier = earlier.withColumnsRenamed({c: f"__key_{c}" for c in keys})
    return (
        placed.join(earlier, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys])
        .withColumns({name: F.col(f"__d{n}") + F.col("__today") for n, name in names.items()})
        .drop("__today", *[f"__d{n}" for n in days], *[f"__key_{c}" for c in keys])
    )


def travel(log: EntityLog, lat: str, lon: str, zone: str) -> EntityLog:
    """Add miles from the previous location and a flag for a changed zone."""
    return log.lagged_log(1, lambda w: {"travel_miles": moved_miles(w, lat, lon), "zone_changed": zone_change(w, zone)})


def previous_flag(log: EntityLog, condition: Column, name: str) -> EntityLog:
    """Add 1 if the previous row met ``condition``."""
    return log.lagged_log(1, lambda w: {name: before(w, condition)})


def run_at_end(log: EntityLog, flag: str) -> DataFrame:
    """Signed run length at the end of each entity: rows after the last opposite one."""
    numbered = log.numbered("__n")
    last = F.max_by(flag, "__n")
    opposite = F.coalesce(
        F.when(last == 1, F.max(F.when(F.col(flag) == 0, F.col("__n")))).otherwise(
            F.max(F.when(F.col(flag) == 1, F.col("__n")))
        ),
        F.lit(0),
    )
    length = F.max("__n") - opposite
    return numbered.groupBy(*log.entity).agg(F.when(last == 1, length).otherwise(-length).alias("streak"))


def best_run(log: EntityLog, flag: str, date: str) -> DataFrame:
    """Longest run of 1 flags per entity with its end date (earliest wins) and the current run."""
    runs = run_lengths(log, flag, "__run").numbered_log("__n").result
    longest = F.coalesce(F.max(F.when(F.col("__run") > 0, F.col("__run"))), F.lit(0))
    position = F.struct(F.col("__run").alias("run"), (-F.col("__n")).alias("before"))
    return runs.groupBy(*log.entity).agg(
        longest.alias("best_streak"),
        F.max_by(date, F.when(F.col("__run") > 0, position)).alias("best_end"),
        F.max_by("__run", "__n").alias("current_streak"),
    )


def drawdown(log: EntityLog, profit: str) -> EntityLog:
    """Running profit and its distance below the running maximum."""
    total = log.running_log({"running_profit": ("sum", F.col(profit))}, include_current=True)
    peak = total.running_log({"__peak": ("max", F.col("running_profit"))}, include_current=True)
    return peak.map(
        lambda df: df.withColumn("drawdown", F.col("running_profit") - F.col("__peak")).drop("__peak")
    )


def downsample(log: EntityLog, every: int = 3) -> DataFrame:
    """Every ``every``-th row per entity, counted from the first, plus the last row."""
    forward = log.numbered_log("__n", start=0)
    backward = [F.col(c).desc_nulls_last() for c in log.order]
    ends = first_rows(forward.result, log.entity, backward, 1)
    ends = ends.select(*[F.col(c).alias(f"__key_{c}") for c in log.entity], F.col("__n").alias("__last"))
    return (
        forward.result.join(ends, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in log.entity])
        .filter((F.col("__n") % every == 0) | (F.col("__n") == F.col("__last")))
        .drop("__n", "__last", *[f"__key_{c}" for c in log.entity])
    )


def open_and_latest(df: DataFrame, keys: Sequence[str], quote: str, time: str, reverse_at: float = 0.5) -> DataFrame:
    """First and last non-null quote per key, the move, and whether it went against the opening favourite.

    Of quotes with equal times the smallest counts as first, the largest as last.
    """
    moment = F.struct(F.col(time), F.col(quote))
    opened, latest = F.col("opening"), F.col("latest")
    move = latest - opened
    against = F.when(opened < 0, move >= reverse_at).when(opened > 0, move <= -reverse_at).otherwise(False)
    return (
        df.filter(F.col(quote).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min_by(quote, moment).alias("opening"),
            F.max_by(quote, moment).alias("latest"),
            F.count(F.lit(1)).alias("snapshots"),
        )
        .withColumn("move", move)
        .withColumn("reverse_move", against.cast("int"))
    )


#: Days of a range by which rates and dates meet.
STANDING_DAYS = 32


def standings_as_of(df: DataFrame, entity: str, groups: Sequence[str], date: str, order: Sequence[str], rate: str, seats: Sequence[int] = (6, 10), within: int = 2, min_entities: int = 6) -> DataFrame:
    """Rank of each entity in its group on every date it plays, from the latest rates.

    A rate holds from its date until the entity's next date; only the dates in
    between on which the group plays matter. The grid therefore has one row per
    (entity, date of the group), independent of the number of log rows. A NULL in ``groups`` is a group of its own.
    """
    keys = [*groups, entity]
    daily = df.groupBy(*keys, date).agg(F.max_by(rate, F.struct(*order)).alias("rate"))
    until = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    bucket = lambda c: F.floor(_day_number(c) / STANDING_DAYS)
    last = df.groupBy(*groups).agg(F.max(date).alias("__last"))
    held = daily.withColumn("until", until).alias("h")
    held = held.join(last.alias("l"), [F.col(f"h.{c}").eqNullSafe(F.col(f"l.{c}")) for c in groups]).select("h.*", "__last")
    # a rate meets the dates of its group by ranges of days, so that each row sees the dates it holds on and few others
    held = held.withColumn("__through", F.coalesce(F.date_sub("until", 1), F.col("__last")))
    held = held.withColumn("__bucket", F.explode(F.sequence(bucket(date), bucket("__through"))))
    dates = daily.select(*groups, F.col(date).alias("__on")).distinct().withColumn("__bucket", bucket("__on"))
    match = [F.col(f"h.{c}").eqNullSafe(F.col(f"d.{c}")) for c in groups] + [F.col("h.__bucket") == F.col("d.__bucket")]
    met = held.alias("h").join(dates.alias("d"), match).where(F.col("__on").between(F.col(f"h.{date}"), F.col("h.__through")))
    grid = met.select(*[F.col(f"h.{c}").alias(c) for c in keys], F.col("h.rate").alias("rate"), F.col(f"h.{date}").alias("from_date"), F.col("__on").alias(date))
    standing = Window.partitionBy(*groups, date)
    ranked = grid.withColumns({
        "position": F.row_number().over(standing.orderBy(F.col("rate").desc(), F.col(entity))),
        "entities": F.count(F.lit(1)).over(standing),
    }).filter(F.col("from_date") == F.col(date))
    first, *others = seats
    close = F.abs(F.col("position") - first) <= within
    for seat in others:
        close = close | ((F.col("entities") >= seat) & (F.abs(F.col("position") - seat) <= within))
    enough = F.col("entities") >= min_entities
    return ranked.drop("from_date").withColumn("close_race", F.when(enough & close, 1).otherwise(0))


def rank_then_and_now(log: DataFrame, entity: str, order: Sequence[str], score: Column, back: int = 10, steady: float = 1.0) -> DataFrame:
    """Rank by the newest score and by the score ``back`` rows ago, with the direction of the score."""
    newest_first = [F.col(c).desc() for c in order]
    picked = first_rows(log.withColumn("__score", score), [entity], newest_first, back + 1, rank="__n")
    pair = picked.groupBy(entity).agg(
        F.max(F.when(F.col("__n") == 1, F.col("__score"))).alias("score_now"),
        F.max(F.when(F.col("__n") == back + 1, F.col("__score"))).alias("score_before"),
    )
    change = F.col("score_now") - F.col("score_before")
    trend = F.when(change > steady, "up").when(change < -steady, "down").otherwise("same")
    now = ranked(pair.withColumn("trend", trend), [F.col("score_now")], [entity], "rank_now")
    both = ranked(now, [F.col("score_before")], [entity], "rank_before")
    return both.withColumn("rank_change", F.col("rank_before") - F.col("rank_now"))


def games_behind(df: DataFrame, group: Sequence[str], entity: str, wins: str, losses: str, season_games: Column, direct: int = 6, play_in: int = 10) -> DataFrame:
    """Position, games behind the leader, and what each entity of a group has clinched.

    ``z`` first place, ``x`` a direct seat, ``pi`` a play-in seat, ``e`` out of the
    play-in, ``o`` out of the direct seats. One row per entity goes in.
    """
    table = Window.partitionBy(*group).orderBy(F.col(wins).desc(), F.col(losses), F.col(entity))
    whole = table.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.col(wins) + F.col("remaining")
    ranked = df.withColumn("remaining", season_games - F.col(wins) - F.col(losses)).withColumns({
        "position": F.row_number().over(table),
        "__size": F.count(F.lit(1)).over(whole),
        "games_behind": ((F.first(wins).over(whole) - F.col(wins)) + (F.col(losses) - F.first(losses).over(whole))) / 2,
        "__chasers": F.max(best).over(table.rowsBetween(1, Window.unboundedFollowing)),
        "__next_direct": F.nth_value(best, direct + 1).over(whole),
        "__next_play_in": F.nth_value(best, play_in + 1).over(whole),
        "__last_direct": F.nth_value(wins, direct).over(whole),
        "__last_play_in": F.nth_value(wins, play_in).over(whole),
    })
    place, won = F.col("position"), F.col(wins)
    letter = (
        F.when((place == 1) & (won > F.col("__chasers")), "z")
        .when((place <= direct) & (won > F.col("__next_direct")), "x")
        .when((place <= play_in) & (won > F.col("__next_play_in")), "pi")
        .when((place > play_in) & (best < F.col("__last_play_in")), "e")
        .when((place > direct) & (place <= play_in) & (best < F.col("__last_direct")), "o")
    )
    return ranked.withColumn("clinch", letter).drop(*[c for c in ranked.columns if c.startswith("__")])
