"""Feature tables: teams, contests, players, props, cover bets, crews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import measures
from duelframe.operators import aggregates as ag, days, joins, windows as wn
from duelframe.operators.ordered import EntityLog, entity_log
from duelframe.storage import materialise

ROLL_WINDOWS = (5, 10, 20)
BOX = ("pts", "fga", "fgm", "fg3m", "fg3a", "fta", "oreb", "dreb", "tov")
ROLLED = (
    "pts", "plus_minus", "win", "fga", "fgm", "fg3m", "fta", "oreb", "dreb", "tov", "expected",
    "off_rtg", "def_rtg", "net_rtg", "pace", "efg", "ts", "tov_poss", "oreb_pct", "ft_rate", "four_factors",
)
STYLE = ("three_rate", "opponent_three_allowed_rate", "opp_dreb_roll20")
SHORT_ROLLED = ("pts", "plus_minus", "off_rtg", "def_rtg", "net_rtg")
EWMA_SPANS = (7, 15)


def team_features(
    log: DataFrame, places: DataFrame, groups: DataFrame | None = None, race: Mapping[str, object] | None = None, slice_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """One row per (team, game) with what was known before the game.

    ``log`` has two rows per game and date: ``game game_date season team opp is_home win
    plus_minus`` and the box score; ``places`` has ``place lat lon zone`` of the
    home sides. ``groups`` maps ``team`` to ``conference`` for the flag of a close race, whose seats
    ``race`` can set. The log is shuffled by team for the season's record, by game for the opponent's
    box score and record, and by team once more for every other window. A log of few teams and more rows than two blocks of
    ``block_rows`` is dealt to blocks of days instead (``operators.days``), unless ``slice_rows`` asks for blocks of a team; the block stays as a column.
    """
    order = ["game_date", "game"]
    if slice_rows is None:
        known = ["team", "opp", "season", "is_home", "win", "plus_minus", "game"]
        blocks = days.day_blocks(log, "team", "game_date", known, LOOK_BACK, block_rows)
        if blocks is not None:
            return _by_days(log, places, groups, race, blocks)
    recorded = wn.cumulative_record(entity_log(log, ["team", "season"], order, slice_rows), "win").result
    boxed = joins.opponent_columns(recorded.drop("opp_pts"), ["game"], "team", "opp", [*BOX, "cum_win_pct"])
    career = _career(entity_log(_located(boxed, places), ["team"], order, slice_rows, sized_by=log))
    if career.is_cut:
        counted = wn.calendar_counts(career.result, ["team"], "game_date", ["game"], [5, 7], "games_last_", slice_rows, log)
        season = entity_log(counted, ["team", "season"], order, slice_rows, sized_by=log)
    else:
        counted = career.map(lambda df: wn.calendar_counts_within(df, ["team"], "game_date", ["game"], [5, 7], "games_last_"))
        season = counted.regroup(["team", "season"], order)
    met = _season(season).result
    pairs = entity_log(met, ["team", "opp"], order, slice_rows, sized_by=log) if career.is_cut else EntityLog(met, ("team", "opp"), tuple(order))
    done = wn.previous_flag(pairs, F.col("win") == 0, "revenge_game").result.withColumn("era", joins.era_of(F.col("season")))
    if groups is None:
        return done
    table = wn.standings_as_of(recorded.join(groups, "team"), "team", ["season", "conference"], "game_date", ["game"], "cum_win_pct", **(race or {}))
    return joins.enrich(done, table.select("team", "season", "game_date", "close_race"), ["team", "season", "game_date"], {"close_race": 0})


def _located(boxed: DataFrame, places: DataFrame) -> DataFrame:
    """Ratings of a game from both box scores, and where it was."""
    share = lambda made, tried: F.coalesce(F.try_divide(F.col(made), F.col(tried)), F.lit(0.0))
    rated = boxed.withColumns(measures.efficiency()).withColumns({
        "expected": measures.pythagorean(F.col("pts"), F.col("opp_pts")),
        "four_factors": measures.four_factors(F.col("efg"), F.col("tov_pct"), F.col("oreb_pct"), F.col("ft_rate")),
        "three_raw": share("fg3a", "fga"),
        "opp_three_raw": share("opp_fg3a", "opp_fga"),
        "place": F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opp")),
    })
    return rated.join(places, "place", "left")


#: Earlier rows that the windows of ``_career`` need: two chunks of the exponential means.
LOOK_BACK = 2 * max(wn.ewma_rows(s) for s in EWMA_SPANS) + 1


def _by_days(log: DataFrame, places: DataFrame, groups: DataFrame | None, race: Mapping[str, object] | None, blocks: days.DayBlocks) -> DataFrame:
    """``team_features`` on blocks of days: counts and runs within a block first, then what the teams bring into it, then all other windows."""
    c, order, block = F.col, ["game_date", "game"], days.BLOCK
    at = lambda flag: F.when(c("is_home") == flag, c("plus_minus").cast("double"))
    season = Window.partitionBy(block, "team", "season").orderBy(*order)
    prior = season.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda value: F.coalesce(F.sum(value).over(prior), F.lit(0))
    held = {"wins": c("win"), "home": at(1), "away": at(0), "homes": at(1).isNotNull().cast("int"), "aways": at(0).isNotNull().cast("int")}
    runs = {"won": F.when(c("win") == 1, c("__rn")), "lost": F.when(c("win") != 1, c("__rn"))}
    other = days.other_side("game", "team", "opp", {"season": c("season"), "rn": c("__rn"), "wins": c("__wins"), **{f"opp_{b}": c(b) for b in BOX}})
    dealt = blocks.deal(log.drop("opp_pts")).withColumns({"__rn": F.row_number().over(season)} | {f"__{n}": total(v) for n, v in held.items()})
    local = dealt.withColumns({f"__{n}": F.max(v).over(prior) for n, v in runs.items()} | {
        days.PLACE: F.row_number().over(Window.partitionBy(block, "team").orderBy(*order)),
        "__met": F.lag("win").over(Window.partitionBy(block, "team", "opp").orderBy(*order)),
    }).withColumn("__opp", other)
    flat = [c("__opp.season").alias("__opp_season"), c("__opp.rn").alias("__opp_rn"), c("__opp.wins").alias("__opp_wins"), *[c(f"__opp.opp_{b}") for b in BOX]]
    stored = materialise(local.select("*", *flat).drop("__opp"), "day-blocks", once=True, codec="zstd")

    parts = stored.groupBy(block, "team", "season").agg(
        F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(v), F.lit(0)).alias(n) for n, v in held.items()], *[F.max(v).alias(n) for n, v in runs.items()])
    seasons = days.carried(parts, ["team", "season"], ["rows", *held], positions={n: "rows" for n in runs})
    pairs = stored.groupBy(block, "team", "opp").agg(F.max_by("win", F.struct(*order)).alias("met"))
    others = seasons.select(block, c("team").alias("opp"), c("season").alias("__opp_season"), c("carried_rows").alias("__opp_rows"), c("carried_wins").alias("__opp_before"))
    joined = stored.join(seasons, [block, "team", "season"]).join(others, [block, "opp", "__opp_season"], "left")
    joined = joined.join(days.carried(pairs, ["team", "opp"], [], ["met"]), [block, "team", "opp"], "left")
    so_far = lambda n: c(f"__{n}") + c(f"carried_{n}")
    played = c("__rn") - 1 + c("carried_rows")
    last = lambda n: F.coalesce(c(f"__{n}") + c("carried_rows"), c(f"carried_{n}"), F.lit(0))
    pct = lambda won, games: F.coalesce(F.try_divide(won, games), F.lit(0.5))
    net = lambda side: F.coalesce(F.try_divide(c(f"__so_far_{side}"), c(f"__so_far_{side}s")), F.lit(0.0))
    # numbers of games and points go into the halos; their ratios, which compress badly, are made after
    counted = {
        "cum_wins": so_far("wins"), "season_game_num": played, "streak": last("won") - last("lost"),
        "__own_wins": c("__opp_wins") + c("__opp_before"), "__own_played": c("__opp_rn") - 1 + c("__opp_rows"),
        **{f"__so_far_{n}": so_far(n) for n in ("home", "away", "homes", "aways")},
        "revenge_game": F.coalesce((F.coalesce("__met", "carried_met") == 0).cast("int"), F.lit(0)),
    }
    ratios = {
        "cum_losses": c("season_game_num") - c("cum_wins"), "cum_win_pct": pct(c("cum_wins"), c("season_game_num")),
        "opp_cum_win_pct": F.when(c("__own_played").isNotNull(), pct(c("__own_wins"), c("__own_played"))),
        "home_net_season": net("home"), "away_net_season": net("away"),
    }
    # of the last won and the last lost game, the later one is the row before: the run goes back to the other
    scratch = [n for n in joined.columns if n.startswith(("__", "carried_")) and n not in (block, days.PLACE)]
    recorded = joined.withColumns(counted).drop(*scratch)
    with_ratios = lambda df: df.withColumns(ratios).drop(*[n for n in counted if n.startswith("__")])

    located = _located(with_ratios(days.with_halo(recorded, blocks, LOOK_BACK)), places)
    kept = located.withColumnRenamed(days.PLACE, "__place")
    career = _career(EntityLog(kept, (block, "team"), tuple(order)), stacked=True).result.filter(~c(days.HALO)).drop(days.HALO).withColumnRenamed("__place", days.PLACE)
    full = days.calendar_counts(career, blocks, [5, 7], "games_last_").drop(days.PLACE).withColumn("era", joins.era_of(c("season")))
    if groups is None:
        return full
    table = wn.standings_as_of(with_ratios(recorded).join(groups, "team"), "team", ["season", "conference"], "game_date", ["game"], "cum_win_pct", **(race or {}))
    race_table = materialise(table.select("team", "season", "game_date", "close_race"), "races", once=True)
    return joins.enrich(full, race_table, ["team", "season", "game_date"], {"close_race": 0})


def _career(log: EntityLog, stacked: bool = False) -> EntityLog:
    """Windows over all seasons of a team, in one window operator but for the exponential means; ``stacked``: two more, for less work per row."""
    styles = dict(zip(("three_raw", "opp_three_raw", "opp_dreb"), STYLE, strict=True))

    def rolled_means(w) -> dict[str, Column]:
        return {
            **wn.means(w, ROLLED, ROLL_WINDOWS),
            **{f"sos_roll{n}": c for n, c in zip((10, 20), wn.means(w, ["opp_cum_win_pct"], [10, 20]).values(), strict=True)},
            **dict(zip(STYLE, wn.means(w, list(styles), [20]).values(), strict=True)),
        }

    def columns(w) -> dict[str, Column]:
        return {
            **(wn.stack_parts(w, stack, ROLL_WINDOWS[0]) if stacked else rolled_means(w)),
            **wn.means(w, SHORT_ROLLED, [3]),
            "travel_miles": wn.moved_miles(w, "lat", "lon"),
            "zone_changed": wn.zone_change(w, "zone"),
            "days_rest": wn.gap_days(w, "game_date"),
            "is_back_to_back": (wn.gap_days(w, "game_date") <= 1).cast("int"),
            "net_trend_5": wn.fitted_slope(w, "plus_minus", "__nth"),
            "off_trend_5": wn.fitted_slope(w, "pts", "__nth"),
            "def_trend_5": wn.fitted_slope(w, "opp_pts", "__nth"),
            "net_std_10": wn.deviation(w, "plus_minus"),
            "blowout_loss_last_game": wn.before(w, F.col("plus_minus") <= -20),
        }

    edges = {
        "three_style_mismatch": F.col("three_rate") - F.col("opponent_three_allowed_rate"),
        "rebounding_edge": F.col("oreb_roll20") - F.col("opp_dreb_roll20"),
    }
    stack = [*ROLLED, "opp_cum_win_pct", *styles]
    rolled = log.numbered_log("__nth").lagged_log(max(ROLL_WINDOWS), columns)
    if stacked:
        named = {f"opp_cum_win_pct_roll{n}": f"sos_roll{n}" for n in (10, 20)} | {f"{c}_roll20": name for c, name in styles.items()}
        unnamed = [f"{c}_roll{n}" for c in ("opp_cum_win_pct", *styles) for n in ROLL_WINDOWS if f"{c}_roll{n}" not in named]
        rolled = wn.stacked_means(rolled, stack, ROLL_WINDOWS[0], 2).map(lambda df: df.drop(*unnamed).withColumnsRenamed(named))
    rolled = rolled.map(lambda df: df.withColumns(edges).drop("__nth"))
    return wn.ewma(rolled, ["plus_minus", "win"], EWMA_SPANS)


def _season(log: EntityLog) -> EntityLog:
    """Windows within a season."""
    at = lambda flag: F.when(F.col("is_home") == flag, F.col("plus_minus"))
    log = wn.streak(log, "win").numbered_log("season_game_num", start=0)
    return wn.expanding_means(log, {"home_net_season": at(1), "away_net_season": at(0)}, fill=0.0)


TEAM_FEATURES = (
    *[f"{c}_roll{w}" for w in ROLL_WINDOWS for c in ROLLED],
    *[f"{c}_roll3" for c in SHORT_ROLLED],
    *[f"{c}_ewma{s}" for s in EWMA_SPANS for c in ("plus_minus", "win")],
    "travel_miles", "zone_changed", "days_rest", "is_back_to_back", "games_last_5_days", "games_last_7_days",
    "net_trend_5", "off_trend_5", "def_trend_5", "net_std_10", "blowout_loss_last_game", "revenge_game",
    "cum_wins", "cum_losses", "cum_win_pct", "streak", "season_game_num", "home_net_season", "away_net_season",
    "sos_roll10", "sos_roll20", *STYLE, "three_style_mismatch", "rebounding_edge", "close_race",
)


@dataclass(frozen=True)
class Dimension:
    """A table with one row per ``keys``, and for each of its columns the value of team rows that it does not have; None leaves them NULL."""

    table: DataFrame
    keys: tuple[str, ...]
    fills: Mapping[str, float | None]

    def join(self, rows: DataFrame) -> DataFrame:
        known = {c: v for c, v in self.fills.items() if v is not None}
        return joins.enrich(rows, self.table.select(*self.keys, *self.fills), self.keys, known)


def with_dimensions(features: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Team rows with the columns of all dimensions."""
    for dimension in dimensions:
        features = dimension.join(features)
    return features


# What counts where nothing is known of a side.
NOBODY_ABSENT = {"missing_minutes": 0.0, "missing_usage": 0.0, "n_missing": 0, "star_out": 0, "availability": 1.0}
NO_LINEUPS = {f"lineup_{c}": 0.0 for c in ("top1_net", "top3_net", "avg_net", "net_std", "best_off", "best_def", "n")}
NO_EFFORT = {f"effort_{c}": 0.0 for c in (*ag.EFFORT_WEIGHTS, "index")}
NO_CREW = {"crew_fta10": None, "crew_fta20": None, "pace_impact": None}


def lineup_dimension(lineups: DataFrame, order: Sequence[Column]) -> Dimension:
    """Best, typical and spread of the ratings of a team's lineups in a season."""
    found = ag.lineup_summary(lineups, ["season", "team"], list(order))
    return Dimension(found.withColumnsRenamed({c.removeprefix("lineup_"): c for c in NO_LINEUPS}), ("season", "team"), NO_LINEUPS)


def effort_dimension(log: DataFrame) -> Dimension:
    """A team's mean effort measures in a season, and their index among the season's teams; the log has the measures by their names."""
    means = log.groupBy("season", "team").agg(*[F.avg(c).alias(c) for c in ag.EFFORT_WEIGHTS])
    found = ag.zscore_index(means, ["season"], ag.EFFORT_WEIGHTS, "index")
    return Dimension(found.withColumnsRenamed({c.removeprefix("effort_"): c for c in NO_EFFORT}), ("season", "team"), NO_EFFORT)


def contest_features(features: DataFrame, dimensions: Sequence[Dimension] = (), shared: Sequence[str] = ()) -> DataFrame:
    """One row per game: both sides' features, their differences and interactions, and the outcome.

    Dimensions by team are joined to the team rows before both sides are brought together; those by ``game`` once to each contest.
    ``shared`` are columns of the game that the home side's row already has. Rows dealt to blocks of days meet within their block.
    """
    columns = [c for c in TEAM_FEATURES if c in features.columns]
    of_game = [d for d in dimensions if "game" in d.keys]
    of_team = [d for d in dimensions if "game" not in d.keys]
    features = with_dimensions(features, of_team)
    columns += [c for d in of_team for c in d.fills]
    dealt = [days.BLOCK] if days.BLOCK in features.columns else []
    sides = joins.two_sided(features, [*dealt, "game", "game_date", "season", "era"], "is_home", ["team", "win", *columns], shared=shared).drop(*dealt)
    wide = measures.difference_block(sides, columns).drop("away_win")
    c = F.col
    home_edge = c("home_off_rtg_roll20") - c("away_def_rtg_roll20")
    away_edge = c("away_off_rtg_roll20") - c("home_def_rtg_roll20")
    fatigue = lambda side: c(f"{side}_is_back_to_back") * c(f"{side}_travel_miles")
    factors = {"diff_efg_roll10": 0.40, "diff_tov_poss_roll10": -0.25, "diff_oreb_pct_roll10": 0.20, "diff_ft_rate_roll10": 0.15}
    return with_dimensions(wide, of_game).select(
        "*",
        home_edge.alias("home_off_vs_away_def"),
        away_edge.alias("away_off_vs_home_def"),
        (home_edge - away_edge).alias("matchup_edge"),
        (fatigue("home") - fatigue("away")).alias("diff_fatigue"),
        measures.weighted_sum([(c(n), w) for n, w in factors.items()]).alias("diff_factors_composite"),
    )


def add_ratings(contests: DataFrame, rated: DataFrame) -> DataFrame:
    """Attach pre-game ratings and what they mean in context."""
    return rating_context(contests.join(rated.select("game", *RATINGS), "game", "left"))


RATINGS = ("home_elo", "away_elo", "diff_elo", "home_momentum", "away_momentum", "home_expected")


def rating_context(contests: DataFrame) -> DataFrame:
    """What the ratings mean in context; a game without them has two unrated sides."""
    joined = contests.fillna({"home_elo": 1500.0, "away_elo": 1500.0, "diff_elo": 0.0})
    return joined.select(
        "*",
        *[(F.col("diff_elo") * F.col(f"diff_{c}")).alias(f"elo_x_{c}") for c in ("days_rest", "is_back_to_back", "streak")],
    )


PLAYER_ROLLED = ("pts", "reb", "ast", "fg3m", "fga", "fta", "tov", "minutes")
PLAYER_FORM = ("pts", "reb", "ast", "minutes")


def player_features(log: DataFrame, context: DataFrame, min_games: int = 5, slice_rows: int | None = None) -> DataFrame:
    """Player rows with rolling form, volatility, and both teams' context; players with enough games only.

    ``context`` is by (game, team): ``pts_allowed_roll20 net_roll20 days_rest``.
    """
    kept = log.join(log.groupBy("player").agg(F.count(F.lit(1)).alias("__games")), "player").filter(F.col("__games") >= min_games)
    career = entity_log(kept.drop("__games"), ["player"], ["game_date", "game"], slice_rows, sized_by=log)
    career = career.lagged_log(max(ROLL_WINDOWS), lambda w: {
        **wn.means(w, PLAYER_ROLLED, ROLL_WINDOWS),
        **{f"{c}_std{n}": wn.deviation(w, c, n, fill=None) for c in PLAYER_FORM for n in ROLL_WINDOWS},
        "days_rest": wn.gap_days(w, "game_date"),
        "is_back_to_back": (wn.gap_days(w, "game_date") <= 1).cast("int"),
    })
    career = wn.expanding_means(career, {f"{c}_mean": F.col(c) for c in PLAYER_FORM})
    numbered = career.regroup(["player", "season"], ["game_date", "game"], log, slice_rows).numbered("season_game_num")
    form = {f"{c}_form": F.col(f"{c}_roll5") - F.col(f"{c}_roll20") for c in PLAYER_FORM}
    pace = {f"{c}_per_min": measures.ratio(F.col(f"{c}_roll10"), F.col("minutes_roll10")) for c in ("pts", "reb", "ast")}
    shaped = numbered.withColumns(form | pace)
    full = joins.both_sides_context(shaped, context, "game", "team", "opp", ["pts_allowed_roll20", "net_roll20", "days_rest"])
    return full.withColumns({
        "scoring_edge": F.col("pts_roll10") - 0.1 * F.col("opp_pts_allowed_roll20"),
        "rest_advantage": F.col("team_days_rest") - F.col("opp_days_rest"),
        "era": joins.era_of(F.col("season")),
    })


PROP_EWMA = {"minutes": "minutes", "usage_rate": "usage", "pts": "pts", "reb": "reb", "ast": "ast", "fg3m": "fg3m"}


def prop_features(log: DataFrame, span: int = 10, slice_rows: int | None = None) -> DataFrame:
    """Exponential form of a player before each game, and per-36 rates of the game as targets."""
    played = log.withColumn("minutes", F.coalesce("minutes", F.lit(0.0)))
    rate = lambda c: F.coalesce(measures.per_unit(F.col(c), F.col("minutes"), 36), F.lit(0.0))
    rated = played.withColumns({f"{c}_per36": rate(c) for c in ("pts", "reb", "ast", "fg3m")} | {"usage": rate("fga")})
    career = entity_log(rated, ["player"], ["game_date", "game"], slice_rows, sized_by=log)
    career = wn.ewma(career, list(PROP_EWMA.values()), [span])
    career = career.lagged_log(1, lambda w: {
        "is_b2b": F.coalesce((F.date_diff(F.col("game_date"), F.lag("game_date").over(w)) <= 1).cast("int"), F.lit(0))
    })
    renamed = career.map(lambda df: df.withColumnsRenamed({f"{c}_ewma{span}": f"{n}_ewma" for n, c in PROP_EWMA.items()}))
    return renamed.regroup(["player", "season"], ["game_date", "game"], log, slice_rows).numbered("season_game_num")


def cover_features(contests: DataFrame, odds: DataFrame, slice_rows: int | None = None, sized_by: DataFrame | None = None) -> DataFrame:
    """Contests with odds and the features of the cover market.

    ``contests`` has ``game game_date home away home_covers home_days_rest
    away_days_rest home_cum_win_pct``; ``odds`` the quotes by date and teams. The
    cover record of a side is the mean of the home side's cover flag over its
    previous games in that role. ``sized_by`` is a plain table of the contests,
    for the size check.
    """
    from duelframe.functions.market import no_vig

    joined = contests.join(odds, ["game_date", "home", "away"])
    p_home, p_away = no_vig(F.col("home_ml"), F.col("away_ml"))
    rows = joined.withColumns({"home_implied": p_home, "away_implied": p_away})
    for side in ("home", "away"):
        log = entity_log(rows, [side], ["game_date", "game"], slice_rows, sized_by)
        rolled = wn.lag_mean(wn.lag_mean(log, ["home_covers"], [5], min_rows=2), ["home_covers"], [10], min_rows=2)
        rows = rolled.result.withColumnsRenamed({f"home_covers_roll{w}": f"{side}_ats_{w}" for w in (5, 10)})
    dog = (F.col("home_implied") < 0.5).cast("double")
    line = F.coalesce("spread", F.lit(0.0))
    return rows.withColumns({
        "diff_ats_5": F.col("home_ats_5") - F.col("away_ats_5"),
        "diff_ats_10": F.col("home_ats_10") - F.col("away_ats_10"),
        "spread_bucket": measures.bucket(line, [3.0, 7.0, 10.0], [0, 1, 2, 3], closed_right=True),
        "home_dog": dog,
        "rest_advantage": F.col("home_days_rest") - F.col("away_days_rest"),
        "record_vs_expectation": F.col("home_cum_win_pct") - F.col("home_implied"),
        "spread_x_home_dog": F.col("spread") * dog,
        "implied_gap": F.abs(F.col("home_implied") - F.col("away_implied")),
    })


def crew_features(long: DataFrame, game_means: DataFrame, league: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Per game: mean form of its officials and their pace against the league's.

    ``long`` is one row per (game, official), ``game_means`` by game, ``league``
    one row per day with ``pace``.
    """
    rows = long.join(game_means, ["game", "game_date"])
    log = entity_log(rows, ["referee"], ["game_date", "game", "slot"], slice_rows)
    form = wn.lag_mean(log, ["mean_fta", "mean_poss"], [10, 20]).result
    crews = form.groupBy("game", "game_date", "home").agg(
        F.avg("mean_fta_roll10").alias("crew_fta10"), F.avg("mean_fta_roll20").alias("crew_fta20"),
        F.avg("mean_poss_roll10").alias("__poss"),
    )
    daily = entity_log(league.withColumn("__league", F.lit(0)), ["__league"], ["game_date"], slice_rows)
    baseline = wn.lag_mean(daily, ["pace"], [10]).result.select("game_date", "pace_roll10")
    joined = crews.join(baseline, "game_date", "left")
    return joined.withColumn("pace_impact", F.col("__poss") - F.col("pace_roll10")).drop("__poss", "pace_roll10")


def availability(absence_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per team and game: what share of the expected minutes was available."""
    return ag.absence_rollup(absence_rows, list(keys))


def state_before(log: DataFrame, entity: Sequence[str], day: str, order: Sequence[str], states: Sequence[str]) -> DataFrame:
    """State of an entity before each of its days: the state after its last earlier day.

    ``states`` are columns of ``log`` that include the current row. Games of the
    same day do not count for each other.
    """
    position = F.struct(*order)
    daily = log.groupBy(*entity, day).agg(*[F.max_by(c, position).alias(c) for c in states], F.max(day).alias("__day"))
    before = entity_log(daily, entity, [day]).lagged(
        1, lambda w: {c: F.lag(c).over(w) for c in states} | {"last_day": F.lag("__day").over(w)}
    )
    return before.drop("__day")


def as_text(wins: Column, losses: Column) -> Column:
    """``W-L`` text, ``0-0`` without games."""
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return F.concat(count(wins), F.lit("-"), count(losses))
