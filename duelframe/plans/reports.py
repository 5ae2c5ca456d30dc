"""Reports composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions import explain, market, measures
from duelframe.functions.text import season_label
from duelframe.operators import aggregates as ag, joins, windows as wn
from duelframe.operators.ordered import entity_log
from duelframe.operators.sets import union_by_name
from duelframe.operators.topk import (
    PAGE_ROWS, first_row, heaviest, last_n, latest_array, latest_dates, latest_nonnull, latest_row, paged_array, top_by_mean,
)
from duelframe.plans.features import as_text, state_before

CONFIDENCE_LABELS = ["50-55%", "55-60%", "60-65%", "65-70%", "70-75%", "75-80%", "80%+"]


def confidence_bins(df: DataFrame, p_home: str, correct: Column) -> DataFrame:
    """Size, mean confidence and hit rate per band of the favourite's probability."""
    confidence = F.greatest(F.col(p_home), 1 - F.col(p_home))
    band = measures.bucket(confidence, [0.55, 0.60, 0.65, 0.70, 0.75, 0.80], CONFIDENCE_LABELS)
    return df.groupBy(band.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("predicted"), F.avg(correct.cast("int")).alias("actual")
    )


def absences(status: DataFrame, days: DataFrame) -> DataFrame:
    """Player and team-day table: 1 for expected players without an appearance, 0 for rotation players who played."""
    since = status.select("player", "team", F.col("day").alias("since"), "min_roll5", "usage", "in_rotation")
    dates = days.select("team", "day").distinct()
    expected = joins.valid_on(since, dates, ["player"], ["team"], "since", "day", 25, where=F.col("in_rotation"))
    columns = ["player", "team", "day", "min_roll5", "usage"]
    absent = joins.missing_from(expected, days, ["player", "day"]).select(*columns, F.lit(1).alias("was_absent"))
    played = status.filter("in_rotation").select(*columns, F.lit(0).alias("was_absent"))
    return first_row(absent.unionByName(played), ["player", "team", "day"], [F.col("was_absent").desc(), "min_roll5", "usage"])


def standings(log: DataFrame, groups: DataFrame, season_games: int | Column, direct: int = 6, play_in: int = 10, slice_rows: int | None = None) -> DataFrame:
    """Standings per (season, group): record, splits, last ten, streak, position, games behind, what is clinched.

    ``groups`` maps ``team`` to ``conference``.
    """
    keys = ["season", "team"]
    record = ag.conditional_record(log, keys, "win", "is_home")
    last10 = last_n(log, keys, ["game_date", "game"], 10, [F.sum("win").alias("wins10"), F.sum(1 - F.col("win")).alias("losses10")])
    streaks = wn.run_at_end(entity_log(log, keys, ["game_date", "game"], slice_rows), "win")
    table = record.join(last10, keys).join(streaks, keys).join(groups, "team")
    games = season_games if isinstance(season_games, Column) else F.lit(season_games)
    placed = wn.games_behind(table, ["season", "conference"], "team", "wins", "losses", games, direct, play_in)
    text = lambda w, lo: F.concat_ws("-", w, lo)
    return placed.withColumns({
        "home_record": text("home_wins", "home_losses"),
        "away_record": text("away_wins", "away_losses"),
        "last10": text("wins10", "losses10"),
        "streak_text": F.when(F.col("streak") > 0, F.concat(F.lit("+"), F.col("streak").cast("string"))).otherwise(F.col("streak").cast("string")),
    })


def season_history(contests: DataFrame, log: DataFrame) -> DataFrame:
    """One document per season: final records and the number of games and points per team, nested."""
    rows = log.groupBy("season", "team").agg(
        F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"), F.sum("pts").alias("pts")
    )
    ordered = rows.withColumn("__order", -F.col("wins"))
    table = paged_array(ordered, ["season"], ["__order", "team"], ["team", "wins", "losses", "pts"], "standings")
    games = contests.groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.min("game_date").alias("first"), F.max("game_date").alias("last"))
    return games.join(table, "season").withColumn("label", season_label(F.col("season")))


def playoff_chances(table: DataFrame, season: str = "season", cap: float = 25.0) -> DataFrame:
    """Chance of a play-off place from position and games behind, and of the title from the inverse gap.

    ``table`` has ``season conference team wins losses``, one row per team.
    """
    group = Window.partitionBy(season, "conference").orderBy(F.col("pct").desc(), F.col("wins").desc(), "losses", "team")
    overall = Window.partitionBy(season)
    leader = overall.orderBy(F.col("pct").desc(), F.col("wins").desc(), "team").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rated = table.withColumn("pct", F.coalesce(F.try_divide("wins", F.col("wins") + F.col("losses")), F.lit(0.0)))
    behind = lambda w: ((F.first("wins").over(w) - F.col("wins")) + (F.col("losses") - F.first("losses").over(w))) / 2
    placed = rated.withColumns({"position": F.row_number().over(group), "gap": behind(group), "__overall": behind(leader)})
    gap = F.col("gap")
    chance = (
        F.when(F.col("position") <= 6, 100.0)
        .when(F.col("position") <= 8, F.when(gap > 10, 15.0).when(gap > 5, 50.0).otherwise(75.0))
        .when(F.col("position") <= 10, F.greatest(F.lit(0.0), 50.0 - gap * 8.0))
        .otherwise(0.0)
    )
    # Best rate leads; a team ahead of the leader in games counts as level with it.
    ahead = F.greatest(F.col("__overall"), F.lit(0.0))
    share = placed.withColumn("__score", 1 / (ahead + 1)).withColumn(
        "__share", F.col("__score") / F.sum("__score").over(overall) * 100)
    top = F.max("__share").over(overall)
    scaled = share.withColumn("__top", top).withColumn(
        "title_pct", F.when(F.col("__top") > cap, F.col("__share") * cap / F.col("__top")).otherwise(F.col("__share")))
    return scaled.withColumn("playoff_pct", chance).drop("__overall", "__score", "__share", "__top")


def game_context(schedule: DataFrame, log: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Rest, streaks, recent and season records of both sides before each scheduled game, flags and a summary.

    ``schedule`` has ``game game_date season home away home_star_out
    away_star_out``. Only games on earlier days count.
    """
    order = ["game_date", "game"]
    venue = wn.run_lengths(entity_log(log, ["team", "season", "is_home"], order, slice_rows), "win", "run").result
    season = entity_log(venue, ["team", "season"], order, slice_rows, sized_by=log)
    at = lambda flag, c: F.when(F.col("is_home") == flag, F.col(c))
    season = season.lagged_log(9, lambda w: {
        "wins10": F.sum("win").over(w.rowsBetween(-9, 0)), "games10": F.count("win").over(w.rowsBetween(-9, 0)),
        "wins7": F.sum("win").over(w.rowsBetween(-6, 0)), "games7": F.count("win").over(w.rowsBetween(-6, 0)),
    }).running_log({
        "home_run": ("last", at(1, "run")), "away_run": ("last", at(0, "run")),
        "home_wins": ("sum", at(1, "win")), "home_games": ("count", at(1, "win")),
        "away_wins": ("sum", at(0, "win")), "away_games": ("count", at(0, "win")),
    }, include_current=True)
    states = ["wins10", "games10", "wins7", "games7", "home_run", "away_run", "home_wins", "home_games", "away_wins", "away_games"]
    before = state_before(season.result, ["team", "season"], "game_date", ["game"], states).drop("last_day")
    days = log.select("team", "game_date").distinct()
    played = entity_log(days, ["team"], ["game_date"], slice_rows).lagged(1, lambda w: {
        "rest": F.date_diff(F.col("game_date"), F.lag("game_date").over(w))})
    joined = schedule
    for side in ("home", "away"):
        mine = lambda df: df.withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c not in ("team", "season", "game_date")})
        joined = joined.join(mine(before).withColumnRenamed("team", side), [side, "season", "game_date"], "left")
        joined = joined.join(mine(played).withColumnRenamed("team", side), [side, "game_date"], "left")
    c = F.col
    record = lambda won, games: as_text(c(won), c(games) - c(won))
    view = lambda s: {
        "b2b": c(f"{s}_rest") == 1, "rest": c(f"{s}_rest"), "wins7": F.coalesce(c(f"{s}_wins7"), F.lit(0)),
        "star_out": c(f"{s}_star_out") == 1,
    }
    flagged = joined.withColumns({
        "home_last10": record("home_wins10", "home_games10"), "away_last10": record("away_wins10", "away_games10"),
        "home_last7": record("home_wins7", "home_games7"), "away_last7": record("away_wins7", "away_games7"),
        "home_streak": F.coalesce("home_home_run", F.lit(0)), "away_streak": F.coalesce("away_away_run", F.lit(0)),
        "home_home_record": record("home_home_wins", "home_home_games"), "away_away_record": record("away_away_wins", "away_away_games"),
        "flags": measures.situation_flags(view("home"), view("away")),
    })
    name = lambda s: F.concat(F.lit("T"), c(s))

    def rested(s: str) -> Column:
        return F.when(c(f"{s}_rest") == 1, F.concat(name(s), F.lit(" on back-to-back"))).otherwise(
            F.concat(name(s), F.lit(" rested ("), c(f"{s}_rest").cast("string"), F.lit("d)")))

    def form(s: str) -> Column:
        n = c(f"{s}_games10")
        return F.when(n > 0, F.concat(name(s), F.lit(" "), c(f"{s}_last10"), F.lit(" in last "), n.cast("string")))

    out = lambda s, flag: F.when(F.array_contains("flags", flag), F.concat(F.lit("key "), name(s), F.lit(" player(s) out")))
    parts = F.array_compact(F.array(
        rested("home"), rested("away"), form("home"), form("away"), out("home", "INJ_IMPACT_HOME"), out("away", "INJ_IMPACT_AWAY")))
    summary = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ". "), F.lit("."))).otherwise("No notable situational factors.")
    return flagged.withColumn("summary", summary).select(
        "game", "game_date", "season", "home", "away", "home_rest", "away_rest", "home_streak", "away_streak",
        "home_last10", "away_last10", "home_last7", "away_last7", "home_home_record", "away_away_record", "flags", "summary",
    )


def injury_report(absent: DataFrame, averages: DataFrame, player: str, team: str, day: str, days: int = 3) -> DataFrame:
    """Per team: absent players of the latest days, each once, largest average first, with a note."""
    recent = latest_dates(absent, day, days)
    once = first_row(recent, [player, team], [F.col(day).desc()]).join(averages, player, "left")
    value = F.coalesce("average", F.lit(0.0))
    impact = measures.bucket(value, [8.0, 15.0], ["low", "medium", "high"])
    listed = once.select(team, player, value.alias("average"), impact.alias("impact"), (-value).alias("__order"))
    pages = paged_array(listed.withColumnRenamed(player, "player"), [team], ["__order", "player"], ["player", "average", "impact"], "players")
    counts = listed.groupBy(team).agg(
        F.count_if(F.col("impact") == "high").alias("high"), F.ceil(F.count(F.lit(1)) / PAGE_ROWS).alias("pages")
    )
    return pages.join(counts, team)


def projected_totals(schedule: DataFrame, log: DataFrame, pace: str = "pace", league_pace: float = 99.5, threshold: float = 3.0, slice_rows: int | None = None) -> DataFrame:
    """Projected total of each scheduled pairing: home scored plus away allowed, scaled by pace, against the book's total.

    The averages are those before a team's latest game, over ten games, at least five.
    """
    rolled = wn.lag_mean(entity_log(log, ["team", "season"], ["game_date", "game"], slice_rows), ["pts", "opp_pts", pace], [10], min_rows=5).result
    latest = latest_row(rolled, ["team", "season"], ["game_date", "game"])
    side = lambda s: latest.select(
        "season", F.col("team").alias(s), F.col("pts_roll10").alias(f"{s}_scored"), F.col("opp_pts_roll10").alias(f"{s}_allowed"),
        F.col(f"{pace}_roll10").alias(f"{s}_pace"))
    rows = schedule.join(side("home"), ["season", "home"]).join(side("away"), ["season", "away"])
    factor = F.coalesce((F.col("home_pace") + F.col("away_pace")) / 2 / league_pace, F.lit(1.0))
    projected = rows.withColumn("model_total", (F.col("home_scored") + F.col("away_allowed")) * factor).filter("model_total IS NOT NULL")
    edge = F.col("model_total") - F.col("book_total")
    return projected.withColumn("edge", edge).withColumn(
        "call", F.when(edge > threshold, "OVER").when(edge < -threshold, "UNDER"))


PROP_STATS = {"pts": "PTS", "reb": "REB", "ast": "AST"}


def player_props(log: DataFrame, lines: DataFrame, top: int = 5, slice_rows: int | None = None) -> DataFrame:
    """Per team the players with most minutes: projection per statistic, book line, edge, call, last five.

    ``lines`` has ``name stat line``. The projection is the mean of the ten games
    before the latest, at least five.
    """
    stats = list(PROP_STATS)
    chosen = top_by_mean(log, ["team"], "player", "minutes", top).select("team", "player", "rank")
    kept = log.join(chosen, ["team", "player"])
    order = ["game_date", "game"]
    rolled = wn.lag_mean(entity_log(kept, ["team", "player"], order, slice_rows), stats, [10], min_rows=5).result
    latest = latest_row(rolled, ["team", "player"], order).select("team", "player", "rank", *[F.col(f"{c}_roll10").alias(c) for c in stats])
    recent = latest_array(kept, ["team", "player"], order, stats, 5)
    wide = latest.join(recent, ["team", "player"])
    values = lambda c: F.transform(F.reverse("latest"), lambda r: r[c])
    long = wide.select("team", "player", "rank", F.explode(F.array(*[
        F.struct(F.lit(label).alias("stat"), F.col(c).alias("projection"), values(c).alias("last5"))
        for c, label in PROP_STATS.items()
    ])).alias("p")).select("team", "player", "rank", "p.*").filter("projection IS NOT NULL")
    named = long.withColumn("key", F.concat(F.lit("player "), F.col("player").cast("string")))
    quoted = lines.select(F.lower(F.trim("name")).alias("key"), "stat", "line")
    edge = F.col("projection") - F.col("line")
    return named.join(quoted, ["key", "stat"], "left").drop("key").withColumns({
        "edge": edge, "value": (F.coalesce(F.abs(edge), F.lit(0.0)) >= 2.0).cast("int"),
        "call": F.when(edge.isNotNull(), F.when(edge > 0, "OVER").otherwise("UNDER")),
    })


def projections(rolled: DataFrame, modelled: DataFrame, stats: dict[str, str]) -> DataFrame:
    """Latest player row to one row per statistic: the model's projection, else the rolling mean.

    ``modelled`` has ``player stat projection``.
    """
    latest = latest_nonnull(rolled, ["player"], ["game_date", "game"], [f"{c}_roll10" for c in stats])
    wide = latest.withColumnsRenamed({f"{c}_roll10": label for c, label in stats.items()})
    long = wide.unpivot(["player"], list(stats.values()), "stat", "fallback")
    joined = long.join(modelled, ["player", "stat"], "left")
    return joined.withColumn("projection", F.coalesce("projection", "fallback")).withColumn(
        "source", F.when(F.col("fallback").isNull() & F.col("projection").isNull(), F.lit(None))
        .when(F.col("projection") == F.col("fallback"), "rolling").otherwise("model"))


def picks(predictions: DataFrame, odds: DataFrame) -> DataFrame:
    """Pick rows: predicted winner, side against the market, edge, stake, tier."""
    rows = predictions.join(odds, ["game_date", "home", "away"], "left")
    market_home, _ = market.no_vig(F.col("home_ml"), F.col("away_ml"))
    p = F.col("p_home")
    winner = F.when(p >= 0.5, F.col("home")).otherwise(F.col("away"))
    edge = p - F.col("market_home")
    agree = F.coalesce(market.models_agree(p, F.col("margin")), F.lit(True))
    size = F.round(F.abs(edge), 3)
    staked = market.kelly(p, F.col("market_home"), edge >= 0, cap=None)
    return rows.withColumn("market_home", market_home).withColumns({
        "predicted_winner": winner,
        "pick": F.when(edge.isNotNull(), F.when(edge >= 0, F.col("home")).otherwise(F.col("away"))).otherwise(winner),
        "edge_pct": size,
        "value_bet": F.coalesce((F.abs(edge) >= 0.05).cast("int"), F.lit(0)),
        "stake": F.when(edge.isNotNull(), staked),
        "tier": F.when(size > 0, market.tier(size, agree)).otherwise(market.tier_without_odds(p, agree)),
        "confidence": F.bround(F.greatest(p, 1 - p) * 100),
    })


# Flags that favour a side.
HOME_FLAGS = ("HOME_HOT", "AWAY_COLD", "REST_ADV_HOME")
AWAY_FLAGS = ("AWAY_HOT", "HOME_COLD", "REST_ADV_AWAY")


def sharp_scores(picked: DataFrame, context: DataFrame) -> DataFrame:
    """Score 0 to 100 from edge, confidence and situation, with its side, rating and a fade alert."""
    joined = picked.join(context.select("game", "flags"), "game", "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    net = F.size(F.array_intersect(flags, listed(HOME_FLAGS))) - F.size(F.array_intersect(flags, listed(AWAY_FLAGS)))
    p = F.col("p_home")
    edge = F.when(F.col("value_bet") == 1, F.least(F.col("edge_pct") / 0.25, F.lit(1.0))).otherwise(0.0)
    score = 0.40 * edge + 0.30 * F.abs(p - 0.5) / 0.5 + 0.30 * F.least(F.abs(net) / 3.0, F.lit(1.0))
    side = F.when(F.col("value_bet") == 1, F.col("pick")).otherwise(F.col("predicted_winner"))
    known = F.filter(flags, lambda f: f.isin(*HOME_FLAGS, *AWAY_FLAGS))
    return joined.withColumns({
        "sharp_score": F.bround(score * 100).cast("int"),
        "sharp_side": side,
        "situation": F.coalesce(F.try_element_at(known, F.lit(1)), F.try_element_at(flags, F.lit(1))),
    }).withColumns({
        "rating": measures.bucket(F.col("sharp_score"), [50, 70], ["LEAN", "MODERATE", "STRONG"]),
        "fade": (((F.col("sharp_side") == F.col("home")) & (p < 0.40)) | ((F.col("sharp_side") == F.col("away")) & (p > 0.60))).cast("int"),
    })


def explainers(picked: DataFrame, features: DataFrame) -> DataFrame:
    """Reasons, one-liner, confidence text and recommended side per pick.

    ``features`` is by game: ``home_form away_form home_rest away_rest away_b2b
    net_gap expected_gap home_expected away_expected``.
    """
    rows = picked.join(features, "game", "left")
    c = F.col
    on_home = F.col("pick") == F.col("home")
    inputs = {
        "home": F.concat(F.lit("T"), c("home")), "away": F.concat(F.lit("T"), c("away")), "p_home": c("p_home"),
        "market": c("market_home"), "away_b2b": c("away_b2b") == 1, "edge": c("edge_pct"), "margin": c("margin"),
        "spread": c("spread"), "tier": c("tier"),
        **{n: c(n) for n in ("home_form", "away_form", "home_rest", "away_rest", "net_gap", "expected_gap", "home_expected", "away_expected")},
    }
    recommended = F.when(on_home, c("market_home")).otherwise(1 - c("market_home"))
    return rows.withColumns({
        "recommended": c("pick"),
        "bullets": explain.bullets(inputs),
        "one_liner": explain.one_liner(inputs | {"market": recommended}, on_home),
        "confidence_text": explain.confidence_text(inputs, on_home),
    })


def game_documents(picked: DataFrame, table: DataFrame, context: DataFrame, history: DataFrame, out: DataFrame) -> DataFrame:
    """One nested document per game: sides, prediction, context, meetings, absences, factors.

    ``table`` is by (season, team): ``wins losses pct``; ``history`` by pair with
    ``meetings wins_a wins_b history``; ``out`` by team with ``players``.
    """
    side = lambda s: table.select(
        "season", F.col("team").alias(s), F.struct("wins", "losses", "pct").alias(f"{s}_record"))
    # A game with more absent players than fit on a page has further documents, which go on with them.
    pages = lambda s: out.select(F.col("team").alias(s), F.col("pages").alias(f"{s}_pages")).distinct()
    absent = lambda s: out.select(F.col("team").alias(s), "page", F.col("players").alias(f"{s}_absent"))
    last = F.greatest(F.coalesce("home_pages", F.lit(1)), F.coalesce("away_pages", F.lit(1))) - 1
    keyed = picked.withColumns(joins.canonical_pair("home", "away"))
    rows = (
        keyed.join(side("home"), ["season", "home"], "left").join(side("away"), ["season", "away"], "left")
        .join(context.drop("game_date", "season", "home", "away"), "game", "left")
        .join(history.select("side_a", "side_b", F.struct("meetings", "wins_a", "wins_b", "history").alias("series")), ["side_a", "side_b"], "left")
        .join(pages("home"), "home", "left").join(pages("away"), "away", "left")
        .withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .join(absent("home"), ["home", "page"], "left").join(absent("away"), ["away", "page"], "left")
    )
    c = F.col
    name = lambda x: F.concat(F.lit("T"), x)
    factors = explain.factors({
        "home": name(c("home")), "away": name(c("away")), "winner": name(c("predicted_winner")), "confidence": c("confidence"),
        "flags": c("flags"), "home_streak": c("home_streak"), "away_streak": c("away_streak"), "home_rate": c("home_record.pct"),
        "away_rate": c("away_record.pct"), "margin": c("margin"), "edge": F.when(c("value_bet") == 1, c("edge_pct")),
    })
    return rows.select(
        "id", "game", "game_date", "home", "away", "page",
        F.struct("home_record", "away_record").alias("sides"),
        F.struct("p_home", "margin", "predicted_winner", "tier", "edge_pct").alias("prediction"),
        F.struct("home_rest", "away_rest", "home_last10", "away_last10", "flags", "summary").alias("context"),
        "series", F.struct("home_absent", "away_absent").alias("absences"), factors.alias("factors"),
    )


def trends(log: DataFrame, rated: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Per team and season: last ten, splits, streak, and short-minus-long rating trends before the latest game.

    ``rated`` is the log with ``off_rtg def_rtg pace``.
    """
    keys, order = ["season", "team"], ["game_date", "game"]
    ten = last_n(log, keys, order, 10, [
        F.sum("win").alias("wins10"), F.sum(1 - F.col("win")).alias("losses10"), F.avg("pts").alias("scored10"), F.avg("opp_pts").alias("allowed10")])
    record = ag.conditional_record(log, keys, "win", "is_home")
    run = wn.run_at_end(entity_log(log, keys, order, slice_rows), "win")
    rolled = wn.lag_mean(entity_log(rated, ["team"], order, slice_rows, sized_by=log), ["off_rtg", "def_rtg", "pace"], [10, 20]).result
    latest = latest_row(rolled, keys, order).select(
        *keys, (F.col("off_rtg_roll10") - F.col("off_rtg_roll20")).alias("offence"),
        (F.col("def_rtg_roll10") - F.col("def_rtg_roll20")).alias("defence"), F.col("pace_roll10").alias("pace10"))
    return ten.join(record, keys).join(run, keys).join(latest, keys, "left")


def hot_players(log: DataFrame, at_least: float = 5.0, least_mean: float = 8.0, n: int = 4) -> DataFrame:
    """Scorers whose last five are well above their mean, with at least three real games among them."""
    order = ["game_date", "game"]
    return _streaky(log, order, "pts", least_mean).filter(F.col("gap") >= at_least).orderBy(F.col("gap").desc(), "player").limit(n)


def cold_players(log: DataFrame, at_least: float = 0.05, least_mean: float = 8.0, n: int = 4) -> DataFrame:
    """Scorers whose shooting rate over the last five is well below their mean."""
    order = ["game_date", "game"]
    shooting = log.withColumn("rate", F.when(F.col("fga") > 0, F.col("fgm") / F.col("fga")))
    return _streaky(shooting, order, "rate", least_mean).filter(F.col("gap") <= -at_least).orderBy("gap", "player").limit(n)


def _streaky(log: DataFrame, order: list[str], value: str, least_mean: float, recent: int = 5, minimum: int = 10) -> DataFrame:
    overall = log.groupBy("player").agg(
        F.count(F.lit(1)).alias("games"), F.avg("pts").alias("mean_pts"), F.avg(value).alias("overall"))
    lately = last_n(log, ["player"], order, recent, [
        F.avg(value).alias("recent"), F.count_if(F.col("fga") > 0).alias("real"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "pts"))), lambda r: r["pts"].cast("string")), ", ").alias("last5")])
    kept = overall.filter((F.col("games") >= minimum) & (F.col("mean_pts") >= least_mean))
    return kept.join(lately.filter("real >= 3"), "player").withColumn("gap", F.col("recent") - F.col("overall"))


def streak_document(hot: DataFrame, cold: DataFrame, teams: DataFrame, splits: DataFrame) -> DataFrame:
    """Hot and cold players, team streaks and the best home/away splits, one row per entry.

    All four inputs are small: they have one row per team or a handful of players.
    """
    entry = lambda df, kind, name, value, detail: df.select(
        F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value"), detail.alias("detail"))
    best = splits.orderBy(F.col("pct").desc(), "team").limit(10)
    rounded = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)) * 100).cast("int").cast("string")
    return union_by_name([
        entry(hot, "hot", "player", "gap", F.col("last5")),
        entry(cold, "cold", "player", "gap", F.col("last5")),
        entry(teams, "streak", "team", "streak", F.lit("")),
        entry(best, "split", "team", "pct", F.concat_ws("/", rounded("home_pct"), rounded("away_pct"))),
    ])


RADAR = ("off_rtg", "def_rtg", "pace", "ts", "win")


def radar(schedule: DataFrame, rated: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """Five dimensions of both sides of a pairing as scores relative to each other."""
    order = ["game_date", "game"]
    rolled = wn.lag_mean(entity_log(rated, ["team"], order, slice_rows), list(RADAR), [10]).result
    latest = latest_row(rolled, ["team"], order).select("team", *[F.col(f"{c}_roll10").alias(c) for c in RADAR])
    side = lambda s: latest.withColumnsRenamed({c: f"{s}_{c}" for c in RADAR}).withColumnRenamed("team", s)
    rows = schedule.join(side("home"), "home").join(side("away"), "away")
    scores = {c: measures.pair_scores(F.col(f"home_{c}"), F.col(f"away_{c}"), c != "def_rtg") for c in RADAR}
    return rows.withColumns({
        "home_scores": F.array(*[s[0] for s in scores.values()]),
        "away_scores": F.array(*[s[1] for s in scores.values()]),
        "net_gap": (F.col("home_off_rtg") - F.col("home_def_rtg")) - (F.col("away_off_rtg") - F.col("away_def_rtg")),
        "pace_gap": F.col("home_pace") - F.col("away_pace"),
    })


def player_detail(seasons: DataFrame, log: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]], min_games: int = 5) -> DataFrame:
    """Per player: the season with most games, side tables of that season as structs, last five games.

    Each of ``tables`` is by (player, season) with a ``gp`` weight; the row with
    most games counts.
    """
    main = heaviest(seasons, ["player"], "gp", [F.col("season").desc()], min_games)
    for name, (table, columns) in tables.items():
        once = heaviest(table, ["player", "season"], "gp", list(columns))
        main = main.join(once.select("player", "season", F.struct(*columns).alias(name)), ["player", "season"], "left")
    recent = latest_array(log, ["player"], ["game_date", "game"], ["game", "pts", "reb", "ast"], 5, "last5")
    return main.join(recent, "player", "left")


def performance(predictions: DataFrame, p_home: str, correct: Column, clv: str, slice_rows: int | None = None) -> DataFrame:
    """Accuracy, streaks of good days, returns, line value and calibration as one long document."""
    graded = predictions.withColumn("__right", correct.cast("int"))
    daily = ag.running_accuracy(graded, "game_date", correct)
    days = entity_log(daily.select(F.lit(0).alias("all"), "game_date", (F.col("accuracy") >= 0.5).cast("int").alias("good")), ["all"], ["game_date"], slice_rows)
    run = wn.best_run(days, "good", "game_date")
    last = daily.agg(F.max_by("running_accuracy", "game_date").alias("accuracy"), F.max_by("last7_accuracy", "game_date").alias("last7"))
    roi = ag.flat_roi(graded, "__right", min_sample=1)
    line = ag.clv_summary(predictions, clv)
    bands = confidence_bins(predictions, p_home, correct)
    entry = lambda df, section, **values: [
        df.select(F.lit(section).alias("section"), F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in values.items()
    ]
    parts = [
        *entry(last, "accuracy", season="accuracy", last7="last7"),
        *entry(run, "streak", current="current_streak", best="best_streak"),
        *entry(roi, "roi", bets="n_bets", wins="wins", roi="roi"),
        *entry(line, "clv", mean="mean_clv", positive="positive_rate"),
        bands.select(F.lit("calibration").alias("section"), F.col("bucket").alias("name"), F.col("actual").alias("value")),
    ]
    return union_by_name(parts)


def backtest(bets: DataFrame, won: str, model: str, market_prob: str, season: str, hold_out: Column, threshold: float = 0.05, min_sample: int = 500) -> DataFrame:
    """Baseline, value-filtered and hold-out returns, overall and by season. All three come from one pass."""
    valued = F.abs(F.col(model) - F.col(market_prob)) >= threshold
    tagged = bets.withColumn("kind", F.explode(F.array_compact(F.array(
        F.lit("baseline"), F.when(valued, "value"), F.when(hold_out, "hold-out")))))
    overall = ag.flat_roi(tagged, won, ["kind"], min_sample).withColumn("season", F.lit(None).cast("int"))
    return overall.unionByName(ag.flat_roi(tagged, won, ["kind", season], 1))


def comparison(seasons: DataFrame, position: Column, top: int = 15) -> DataFrame:
    """Careers of players with enough seasons or games: weighted means, era-indexed scoring, best season, rank of the best."""
    averages = ag.period_averages(seasons, "season", ["pts"])
    indexed = seasons.join(averages, "season").withColumn(
        "indexed", measures.indexed(F.col("pts"), F.col("avg_pts"), F.col("all_pts")))
    careers = ag.career_rollup(indexed, "player", "season", "gp", ["pts", "indexed"], "pts").filter("eligible = 1")
    best = careers.orderBy(F.col("career_pts").desc(), "player").limit(top).select("player", "career_pts")
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("career_pts").desc(), "player"))).select("player", "rank")
    return careers.join(F.broadcast(ranked), "player", "left").withColumn("position", position)
