"""Grouped aggregates: records, returns, calibration, significance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.linear import vector_sums


def running_accuracy(df: DataFrame, date: str, correct: Column) -> DataFrame:
    """Accuracy per day, up to the day, and over the last seven days with entries.

    The windows run over one row per day.
    """
    daily = df.groupBy(date).agg(
        F.count(F.lit(1)).alias("graded"), F.sum(correct.cast("int")).alias("correct")
    )
    so_far = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seven = Window.orderBy(date).rowsBetween(-6, Window.currentRow)
    ratio = lambda w: F.sum("correct").over(w) / F.sum("graded").over(w)
    return daily.withColumns({
        "accuracy": F.col("correct") / F.col("graded"),
        "running_accuracy": ratio(so_far),
        "last7_accuracy": ratio(seven),
    })


def period_averages(df: DataFrame, period: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """Mean per period over qualifying rows, and the mean of the periods next to it."""
    rows = df if where is None else df.filter(where)
    averages = rows.groupBy(period).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])
    # One row per period is left.
    overall = Window.partitionBy()
    return averages.withColumns({f"all_{c}": F.avg(f"avg_{c}").over(overall) for c in columns})


def rate(wins: Column, games: Column) -> Column:
    return F.try_divide(wins, games)


def conditional_record(df: DataFrame, keys: list[str], flag: str, split: str) -> DataFrame:
    """Wins, losses and rate overall, where ``split`` is 1 and where it is 0, in one pass."""
    parts = {"": F.lit(True), "home_": F.col(split) == 1, "away_": F.col(split) == 0}
    counts = []
    for prefix, condition in parts.items():
        counts += [
            F.count_if(condition & (F.col(flag) == 1)).alias(f"{prefix}wins"),
            F.count_if(condition & (F.col(flag) == 0)).alias(f"{prefix}losses"),
        ]
    totals = df.groupBy(*keys).agg(*counts)
    return totals.withColumns({
        f"{p}pct": F.try_divide(F.col(f"{p}wins"), F.col(f"{p}wins") + F.col(f"{p}losses")) for p in parts
    })


def counts_pivot(df: DataFrame, keys: list[str], category: str, values: list[str]) -> DataFrame:
    """Counts of each category as columns, 0 where it does not occur."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(category) == v).alias(v) for v in values])


def unpivot_slots(df: DataFrame, ids: list[str], slots: list[str], name: str, slot: str = "slot") -> DataFrame:
    """Wide slots to long rows, blanks and NULL dropped, names trimmed."""
    long = df.unpivot(ids, slots, slot, name)
    return long.withColumn(name, F.trim(name)).filter(F.col(name).isNotNull() & (F.col(name) != ""))


def lineup_summary(df: DataFrame, keys: list[str], order: list[Column], min_games: int = 5) -> DataFrame:
    """Best, top-three, minutes-weighted and spread of ratings per group, by use."""
    net = F.col("off_rating") - F.col("def_rating")
    qualified = df.filter(F.col("gp") >= min_games).withColumn("net", net)
    by_use = Window.partitionBy(*keys).orderBy(*order)
    top3 = (
        qualified.withColumn("__rank", F.row_number().over(by_use))
        .filter(F.col("__rank") <= 3)
        .groupBy(*keys)
        .agg(F.avg("net").alias("top3_net"))
    )
    weighted = F.try_divide(F.sum(F.col("net") * F.col("minutes")), F.sum("minutes"))
    summary = qualified.groupBy(*keys).agg(
        F.max("net").alias("top1_net"),
        F.coalesce(weighted, F.avg("net")).alias("avg_net"),
        F.coalesce(F.stddev_samp("net"), F.lit(0.0)).alias("net_std"),
        F.max("off_rating").alias("best_off"),
        F.min("def_rating").alias("best_def"),
        F.count(F.lit(1)).alias("n"),
    )
    return summary.join(top3, keys)


# Weights of the effort measures in the composite index.
EFFORT_WEIGHTS = {
    "contested_shots": 0.25,
    "deflections": 0.25,
    "loose_balls_recovered": 0.15,
    "charges_drawn": 0.10,
    "screen_assists": 0.15,
    "box_outs": 0.10,
}


def zscore_index(df: DataFrame, period: list[str], weights: dict[str, float], name: str) -> DataFrame:
    """Weighted sum of z-scores within the period; a measure without spread counts 0.

    Means and deviations come from one grouped aggregate that is joined back, so
    a large period never has to fit into one task.
    """
    stats = df.groupBy(*period).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in weights], *[F.stddev_samp(c).alias(f"__s_{c}") for c in weights]
    )

    def z(c: str) -> Column:
        spread = F.col(f"__s_{c}")
        return F.when(spread > 0, (F.col(c) - F.col(f"__m_{c}")) / spread).otherwise(0.0)

    total = sum((z(c) * w for c, w in weights.items()), F.lit(0.0))
    stats = stats.withColumnsRenamed({c: f"__key_{c}" for c in period})
    same = [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in period]
    joined = df.join(stats, same).withColumn(name, total)
    return joined.drop(*[f"__{k}_{c}" for k in "ms" for c in weights], *[f"__key_{c}" for c in period])


def absence_rollup(df: DataFrame, keys: list[str], star_usage: float = 0.25) -> DataFrame:
    """Expected and missing minutes, usage and heads per team and game in one aggregate."""
    absent = F.col("was_absent") == 1
    missing = lambda c: F.coalesce(F.sum(F.when(absent, F.col(c))), F.lit(0.0))
    rolled = df.groupBy(*keys).agg(
        F.sum("min_roll5").alias("expected_minutes"),
        missing("min_roll5").alias("missing_minutes"),
        missing("usage").alias("missing_usage"),
        F.count_if(absent).alias("n_missing"),
        F.coalesce(F.max((absent & (F.col("usage") >= star_usage)).cast("int")), F.lit(0)).alias("star_out"),
    )
    share = F.coalesce(F.try_divide(F.col("missing_minutes"), F.col("expected_minutes")), F.lit(0.0))
    return rolled.withColumn("availability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - share)))


def career_rollup(df: DataFrame, key: str, season: str, games: str, measures: list[str], best: str, min_seasons: int = 5, min_games: int = 500) -> DataFrame:
    """Career means weighted by games, best season, span and eligibility."""
    g = F.col(games)
    return df.groupBy(key).agg(
        F.sum(g).alias("games"),
        F.count(F.lit(1)).alias("seasons"),
        F.min(season).alias("first_season"),
        F.max(season).alias("last_season"),
        F.max_by(season, F.struct(F.col(best), -F.col(season))).alias("best_season"),
        F.max(best).alias(f"best_{best}"),
        *[F.try_divide(F.sum(F.col(c) * g), F.sum(g)).alias(f"career_{c}") for c in measures],
    ).withColumn("eligible", ((F.col("seasons") >= min_seasons) | (F.col("games") >= min_games)).cast("int"))


WIN_PAYOUT = 100.0 / 110.0


def flat_roi(df: DataFrame, won: str, keys: list[str] = (), min_sample: int = 500, extra: dict[str, Column] | None = None) -> DataFrame:
    """Return of equal stakes at -110; NULL outcomes are pushes. Groups below ``min_sample`` drop out."""
    wins = F.count_if(F.col(won) == 1)
    losses = F.count_if(F.col(won) == 0)
    totals = df.groupBy(*keys).agg(
        F.count(won).alias("n_bets"), wins.alias("wins"), losses.alias("losses"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    units = F.col("wins") * WIN_PAYOUT - F.col("losses")
    return totals.filter(F.col("n_bets") >= max(min_sample, 1)).withColumns({
        "hit_rate": F.try_divide(F.col("wins"), F.col("n_bets")),
        "net_units": units,
        "roi": F.try_divide(units, F.col("n_bets")),
    })


# Rules by which a mean closing-line value counts as an edge.
CLV_RULES = {
    "tracker": lambda n, mean, share, least: (n >= least) & (mean > 0) & (share > 0.5),
    "mean": lambda n, mean, share, least: mean > 0,
    "rate": lambda n, mean, share, least: (n >= least) & (share > 0.5),
}


def clv_summary(df: DataFrame, clv: str, rule: str = "tracker", min_games: int = 50) -> DataFrame:
    """Count, mean and positive share of closing-line values, and whether they confirm an edge."""
    summary = df.agg(
        F.count(F.lit(1)).alias("games"),
        F.count(clv).alias("closed"),
        F.avg(clv).alias("mean_clv"),
        F.try_divide(F.count_if(F.col(clv) > 0), F.count(clv)).alias("positive_rate"),
    )
    edge = CLV_RULES[rule](F.col("closed"), F.col("mean_clv"), F.col("positive_rate"), min_games)
    return summary.withColumn("has_edge", F.coalesce(edge, F.lit(False)).cast("int"))


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10, keys: list[str] = (), closed: bool = False) -> DataFrame:
    """Equal-width bins [low, high): size, mean prediction, actual rate, gap.

    A probability of exactly 1 falls out unless ``closed``.
    """
    number = F.floor(F.col(p) * bins)
    if closed:
        number = F.least(number, F.lit(bins - 1))
    inside = (number >= 0) & (number < bins)
    binned = df.withColumn("bin", number).filter(inside).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("actual_rate")
    )
    return binned.withColumns({
        "bin_low": F.col("bin") / bins,
        "bin_high": (F.col("bin") + 1) / bins,
        "gap": F.col("mean_pred") - F.col("actual_rate"),
    })


def calibration_error(df: DataFrame, p: str, y: str, keys: list[str], bins: int = 10, closed: bool = False) -> DataFrame:
    """Expected calibration error and Brier score per group.

    One pass: the bins carry the sums from which the group totals follow.
    """
    number = F.floor(F.col(p) * bins)
    if closed:
        number = F.least(number, F.lit(bins - 1))
    binned = df.groupBy(*keys, number.alias("__bin")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(p).alias("__p"),
        F.sum(y).alias("__y"),
        F.sum(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("__sq"),
    )
    inside = F.col("__bin") < bins
    return binned.groupBy(*keys).agg(
        F.sum("__n").alias("n"),
        F.try_divide(F.sum(F.when(inside, F.abs(F.col("__p") - F.col("__y")))), F.sum("__n")).alias("ece"),
        F.try_divide(F.sum("__sq"), F.sum("__n")).alias("brier"),
    )


def quantile_by_rank(df: DataFrame, value: str, position: Column, keys: list[str] = (), slice_rows: int | None = None) -> DataFrame:
    """Exact interpolated quantile per group; ``position`` in [0, 1] may use the group size ``n``.

    Equal values are counted first, then a running count over the distinct
    values locates the two order statistics, so no group is collected.
    """
    from duelframe.operators.ordered import entity_log

    group = list(keys) or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    counted = base.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    upto = entity_log(counted, group, [value], slice_rows).running({"__upto": ("sum", F.col("__c"))}, include_current=True)
    sizes = counted.groupBy(*group).agg(F.sum("__c").alias("n")).withColumn("__at", position * (F.col("n") - 1))
    sizes = sizes.withColumnsRenamed({c: f"__key_{c}" for c in group})
    ranked = upto.join(sizes, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in group])
    at = lambda k: F.min(F.when(F.col("__upto") > k, F.col(value)))
    found = ranked.groupBy(*group, "n", "__at").agg(
        at(F.floor("__at")).alias("__low"), at(F.ceil("__at")).alias("__high")
    )
    inside = F.col("__at") - F.floor("__at")
    out = found.withColumn("quantile", F.col("__low") + (F.col("__high") - F.col("__low")) * inside)
    return out.select(*keys, "n", "quantile")


def conformal_quantile(df: DataFrame, residual: Column, coverage: float = 0.9, keys: list[str] = ()) -> DataFrame:
    """Half-width that covers ``coverage`` of the absolute residuals, with the finite-sample correction."""
    n = F.col("n")
    position = F.least(F.ceil((n + 1) * coverage) / n, F.lit(1.0))
    return quantile_by_rank(df.withColumn("__abs", F.abs(residual)), "__abs", position, keys)


Z_95 = 1.959963984540054


def accuracy_test(df: DataFrame, correct: Column, keys: list[str] = (), null_rate: float = 0.5) -> DataFrame:
    """Accuracy, Wilson 95% interval and exact one-sided binomial p-value per group; ``significant`` at 5%."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(correct.cast("int")).alias("wins"))
    n, p = F.col("n"), F.col("wins") / F.col("n")
    z2 = Z_95**2
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    spread = Z_95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)
    return counts.withColumns({
        "accuracy": p, "ci_lower": centre - spread, "ci_upper": centre + spread,
        "p_value": binomial_tail(F.col("wins"), n, null_rate),
    }).withColumn("significant", (F.col("p_value") < 0.05).cast("int"))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight steps further on."""
    steps = F.lit(1.0)
    for i in range(8):
        steps = steps * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(steps)


def binomial_tail(wins: Column, n: Column, rate: float) -> Column:
    """P(at least ``wins`` of ``n``): the regularised incomplete beta function by its continued fraction.

    The fraction converges within a few square roots of ``n`` steps; so many are taken, whatever the values. It is
    evaluated on the side of the mean where it converges, the other side is the complement.
    """
    a, b = wins.cast("double"), (n - wins + 1).cast("double")
    swap = F.lit(rate) > (a + 1) / (a + b + 2)
    p = F.when(swap, b).otherwise(a)
    q = F.when(swap, a).otherwise(b)
    x = F.when(swap, 1 - rate).otherwise(F.lit(rate))
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(x) + q * F.log(1 - x)) / p
    steps = F.sequence(F.lit(1), F.ceil(50 + 8 * F.sqrt(n)).cast("int"))
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def half(at: Column, term: Column) -> Column:
        c, d = safe(1 + term / at["c"]), 1 / safe(1 + term * at["d"])
        return state(c, d, at["h"] * c * d)

    first = 1 / safe(1 - (p + q) * x / (p + 1))
    odd = lambda at, m: half(at, -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1)))
    even = lambda at, m: half(at, m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)))
    # two terms to a step, each as a step of its own so that no expression is evaluated twice over
    halves = F.flatten(F.transform(steps, lambda m: F.array(F.struct(m.alias("m"), F.lit(True).alias("e")), F.struct(m.alias("m"), F.lit(False).alias("e")))))
    folded = F.aggregate(
        halves, state(F.lit(1.0), first, first), lambda at, s: F.when(s["e"], even(at, s["m"])).otherwise(odd(at, s["m"])), lambda at: at["h"]
    )
    value = front * folded
    inner = F.when(swap, 1 - value).otherwise(value)
    return F.when(wins <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner)))


def paired_models_test(df: DataFrame, a: Column, b: Column, keys: list[str] = ()) -> DataFrame:
    """McNemar's test of two models' hits, with continuity correction."""
    from duelframe.functions.market import normal_cdf

    counts = df.groupBy(*keys).agg(
        F.avg(a.cast("int")).alias("accuracy_a"),
        F.avg(b.cast("int")).alias("accuracy_b"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
    )
    apart = F.abs(F.col("only_a") - F.col("only_b")) - 1
    statistic = F.coalesce(F.try_divide(apart * apart, F.col("only_a") + F.col("only_b")), F.lit(0.0))
    # A chi-square variable with one degree of freedom is a squared normal one.
    tail = F.when(F.col("only_a") + F.col("only_b") == 0, 1.0).otherwise(2 * (1 - normal_cdf(F.sqrt("statistic"))))
    return counts.withColumn("statistic", statistic).withColumn("p_value", tail).withColumn("significant", (F.col("p_value") < 0.05).cast("int"))


def bootstrap_roi(df: DataFrame, profit: str, replicates: int = 10_000) -> DataFrame:
    """Bootstrap interval and p-value of the return on equal resamples.

    Bets with the same profit are counted first. In a replicate such a group of ``c`` bets is drawn Poisson(c) times, by a generator that the profit
    seeds: exact for every count, and a retried task draws the same. A task adds its draws to one vector with a profit and a stake per
    replicate and emits that, so memory and shuffle do not depend on the number of bets or of different profits. Bets without a profit do not count.
    """
    groups = df.where(F.col(profit).isNotNull()).groupBy(F.col(profit).cast("double").alias("profit")).agg(F.count(F.lit(1)).alias("c"))

    def draw(batch: pa.RecordBatch, vectors: dict[int, np.ndarray]) -> None:
        sums = vectors.setdefault(0, np.zeros(2 * replicates))
        for gain, count, seed in zip(*(batch[n].to_pylist() for n in ("profit", "c", "seed")), strict=True):
            k = np.random.default_rng([seed & (1 << 63) - 1, 1]).poisson(count, replicates)
            # The stake of a bet is what it risks: one unit lost, or the profit of a win.
            sums[:replicates] += k * gain
            sums[replicates:] += k * abs(gain)

    cells = vector_sums(groups.withColumn("seed", F.xxhash64("profit")), draw)
    of = lambda stake: F.sum(F.when((F.col("pos") >= replicates) == stake, F.col("value")))
    per_replicate = cells.groupBy((F.col("pos") % replicates + 1).alias("replicate")).agg(F.try_divide(of(False), of(True)).alias("roi"))
    # Replicate 0 is the data itself.
    actual = groups.agg(
        F.try_divide(F.sum(F.col("c") * F.col("profit")), F.sum(F.col("c") * F.abs("profit"))).alias("roi"),
        F.sum("c").alias("n_bets"),
    ).withColumn("replicate", F.lit(0))
    everything = per_replicate.unionByName(actual, allowMissingColumns=True)
    drawn_roi = F.when(F.col("replicate") > 0, F.col("roi"))
    return everything.agg(
        F.max(F.when(F.col("replicate") == 0, F.col("roi"))).alias("mean_roi"),
        F.percentile(drawn_roi, F.lit(0.025)).alias("ci_lower"),
        F.percentile(drawn_roi, F.lit(0.975)).alias("ci_upper"),
        F.avg((drawn_roi <= 0).cast("int")).alias("p_value"),
        F.max("n_bets").alias("n_bets"),
        F.count(drawn_roi).alias("replicates"),
    ).withColumn("significant", (F.col("p_value") < 0.05).cast("int"))


def weight_grid(df: DataFrame, p: str, margin: str, y: str, scales: tuple[float, ...] = (5.0, 10.0, 15.0, 20.0, 25.0, 30.0), steps: int = 20) -> DataFrame:
    """Brier score of every (weight, scale) of a blend, best first.

    For one scale the score is a quadratic in the weight, so three sums per
    scale give all weights exactly: one pass over the rows, no row is repeated.
    """
    sums = []
    for i, scale in enumerate(scales):
        signal = 1 / (1 + F.exp(-F.col(margin) / scale))
        base, gap = signal - F.col(y), F.col(p) - signal
        sums += [
            F.avg(base * base).alias(f"b{i}"), F.avg(base * gap).alias(f"bg{i}"), F.avg(gap * gap).alias(f"g{i}")
        ]
    moments = df.agg(*sums)
    per_scale = F.explode(F.array(*[
        F.struct(F.lit(s).alias("scale"), F.col(f"b{i}").alias("b"), F.col(f"bg{i}").alias("bg"), F.col(f"g{i}").alias("g"))
        for i, s in enumerate(scales)
    ]))
    grid = moments.select(per_scale.alias("m")).select("m.*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    weight = F.col("k") / steps
    return grid.select("scale", weight.alias("weight"), (F.col("b") + 2 * weight * F.col("bg") + weight * weight * F.col("g")).alias("brier"))


def threshold_accuracy(df: DataFrame, p: str, y: str, first: int = 35, last: int = 66) -> DataFrame:
    """Accuracy of every cut-off in hundredths from ``first`` to ``last``.

    Rows are first counted by the number of cut-offs they reach; the cut-offs
    are then read off these few counts.
    """
    reached = F.greatest(F.lit(first - 1), F.least(F.lit(last), F.floor(F.col(p) * 100 + 1e-9)))
    counts = df.groupBy(reached.cast("int").alias("reached"), F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    cut = counts.withColumn("cut", F.explode(F.sequence(F.lit(first), F.lit(last))))
    right = (F.col("reached") >= F.col("cut")) == (F.col("y") == 1)
    return cut.groupBy("cut").agg(
        (F.sum(F.when(right, F.col("c")).otherwise(0)) / F.sum("c")).alias("accuracy")
    ).withColumn("threshold", F.col("cut") / 100)


def best_threshold(accuracies: DataFrame) -> DataFrame:
    """Mark the cut-off with the best accuracy, the first one on a tie. The table has one row per cut-off."""
    order = Window.orderBy(F.col("accuracy").desc(), "cut")
    return accuracies.withColumn("best", (F.row_number().over(order) == 1).cast("int"))


def walk_forward(df: DataFrame, season: str, order: list[str], p: str, market: str, y: str, train_seasons: int = 3, threshold: float = 0.03, vig: float = 0.0455, kelly_fraction: float | None = None, slice_rows: int | None = None) -> DataFrame:
    """Betting results per test season: stakes, return, win rate, mean edge, deepest drawdown."""
    from duelframe.operators.ordered import entity_log
    from duelframe.operators.windows import drawdown

    edge = F.col(p) - F.col(market)
    # The seasons are few; their order decides which ones are test seasons.
    numbered = df.select(season).distinct().withColumn("__nth", F.row_number().over(Window.orderBy(season)))
    tested = numbered.filter(F.col("__nth") > train_seasons).drop("__nth")
    bets = df.join(F.broadcast(tested), season, "left_semi").filter(F.abs(edge) >= threshold)
    won = ((edge > 0) & (F.col(y) == 1)) | ((edge <= 0) & (F.col(y) == 0))
    stake = F.lit(1.0)
    if kelly_fraction is not None:
        sure, payout = F.when(edge > 0, F.col(p)).otherwise(1 - F.col(p)), 1 - vig
        stake = F.greatest((payout * sure - (1 - sure)) / payout, F.lit(0.0)) * kelly_fraction
    staked = bets.withColumns({"__edge": F.abs(edge), "__won": won.cast("int"), "__stake": stake}).withColumn(
        "__profit", F.when(F.col("__won") == 1, F.col("__stake") * (1 - vig)).otherwise(-F.col("__stake"))
    )
    running = drawdown(entity_log(staked, [season], order, slice_rows), "__profit").result
    return running.groupBy(season).agg(
        F.count(F.lit(1)).alias("n_bets"),
        F.sum("__stake").alias("total_wagered"),
        F.sum("__profit").alias("profit"),
        F.try_divide(F.sum("__profit"), F.sum("__stake")).alias("roi"),
        F.avg("__won").alias("win_rate"),
        F.avg("__edge").alias("avg_edge"),
        F.min("drawdown").alias("max_drawdown"),
    )


def walk_forward_total(seasons: DataFrame) -> DataFrame:
    """All test seasons together."""
    return seasons.agg(
        F.sum("n_bets").alias("n_bets"),
        F.sum("total_wagered").alias("total_wagered"),
        F.sum("profit").alias("profit"),
        F.coalesce(F.try_divide(F.sum("profit"), F.sum("total_wagered")), F.lit(0.0)).alias("roi"),
        F.coalesce(F.try_divide(F.sum(F.col("win_rate") * F.col("n_bets")), F.sum("n_bets")), F.lit(0.0)).alias("win_rate"),
    )


def segmented_error(df: DataFrame, predicted: str, actual: str, edges: tuple[float, ...] = (3.0, 7.0)) -> DataFrame:
    """Mean absolute error by the size of the predicted margin."""
    size = F.abs(F.col(predicted))
    segment = F.when(size < edges[0], "close").when(size < edges[1], "medium").otherwise("clear")
    return df.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae")
    )
