"""Scalar-expression queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions import explain, market, measures, text
from duelframe.functions.geo import great_circle_miles
from duelframe.plans.registry import SHARED_SQL, query
from duelframe.plans.shapes import Shapes

PRIOR_PICKS = "predictions JOIN odds USING (game_date, home, away)"


def priced(s: Shapes) -> DataFrame:
    """Predictions with the market's quotes."""
    return s.predictions().join(s.odds(), ["game_date", "home", "away"])


# Shared SQL: odds with both implied probabilities, raw and without the bookmaker's margin.
SHARED_SQL["priced"] = """SELECT *, hp / (hp + ap) AS market_home, ap / (hp + ap) AS market_away FROM
  (SELECT p.*, o.home_ml, o.away_ml, o.spread, o.close_spread, o.total,
    CASE WHEN home_ml >= 100 THEN 100.0 / (home_ml + 100) ELSE abs(home_ml) / (abs(home_ml) + 100.0) END AS hp,
    CASE WHEN away_ml >= 100 THEN 100.0 / (away_ml + 100) ELSE abs(away_ml) / (abs(away_ml) + 100.0) END AS ap
   FROM predictions p JOIN odds o USING (game_date, home, away))"""
TIER_SQL = "CASE WHEN {e} >= 0.08 THEN 'Best Bet' WHEN {e} >= 0.04 THEN 'Solid Pick' WHEN {e} >= 0.02 THEN 'Lean' ELSE 'Skip' END"


@query(
    "sc_parse_matchup",
    "game:l team:i home_flag:i opponent:s",
    """SELECT game, team, CAST(matchup LIKE '% vs. %' AS INT) AS home_flag,
    CASE WHEN matchup LIKE '% vs. %' THEN split_part(matchup, ' vs. ', 2) ELSE split_part(matchup, ' @ ', 2) END AS opponent
    FROM contest_log""",
)
def parse_matchup(s: Shapes) -> DataFrame:
    m = F.col("matchup")
    return s.contest_log().withColumns({"home_flag": text.is_home(m), "opponent": text.opponent(m)})


@query(
    "sc_season_code",
    "game:l by_date:i label:s from_label:i from_end_year:i from_prefixed:i from_short:i from_full:i",
    """SELECT game, season AS by_date,
    concat(CAST(season // 100 AS VARCHAR), '-', lpad(CAST(season % 100 AS VARCHAR), 2, '0')) AS label,
    season AS from_label, CASE WHEN season // 100 >= 1999 THEN season END AS from_end_year,
    season AS from_prefixed, CASE WHEN season // 100 >= 2000 THEN season END AS from_short, season AS from_full FROM contest""",
)
def season_code(s: Shapes) -> DataFrame:
    start = F.floor(F.col("season") / 100)
    label = text.season_label(F.col("season"))
    modern = start >= 2000
    return s.contest().select(
        "game",
        text.season_of_date(F.col("game_date")).alias("by_date"),
        label.alias("label"),
        text.season_code(label).alias("from_label"),
        text.season_code(F.when(start >= 1999, (start + 1).cast("string"))).alias("from_end_year"),
        text.season_code(F.concat(F.lit("2"), start.cast("string"))).alias("from_prefixed"),
        text.season_code(F.when(modern, F.substring(F.col("season").cast("string"), 3, 4))).alias("from_short"),
        text.season_code(F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))).alias("from_full"),
    )


@query(
    "sc_parse_duration",
    "game:l minutes:f6 plain:f6 clock:s inches:i wins:i losses:i",
    """SELECT game, game % 48 + (game % 60) / 60.0 AS minutes, CAST(game % 50 AS DOUBLE) AS plain,
    CASE WHEN game % 10 <> 0 THEN concat(CAST(game % 12 AS VARCHAR), ':', lpad(CAST(game % 60 AS VARCHAR), 2, '0')) END AS clock,
    CASE WHEN game % 10 <> 0 THEN (5 + game % 3) * 12 + game % 12 END AS inches,
    CASE WHEN game % 10 <> 0 THEN game % 11 ELSE 0 END AS wins,
    CASE WHEN game % 10 <> 0 THEN game % 7 ELSE 0 END AS losses FROM contest""",
)
def parse_duration(s: Shapes) -> DataFrame:
    bad = "CASE WHEN game % 10 = 0 THEN 'n/a' ELSE {} END"
    raw = s.contest().selectExpr(
        "game",
        "concat(game % 48, ':', lpad(string(game % 60), 2, '0')) AS mmss",
        "string(game % 50) AS number",
        bad.format("concat('PT', lpad(string(game % 12), 2, '0'), 'M', lpad(string(game % 60), 2, '0'), '.00S')") + " AS iso",
        bad.format("concat(5 + game % 3, '-', game % 12)") + " AS height",
        bad.format("concat(game % 11, '-', game % 7)") + " AS record",
    )
    return raw.select(
        "game",
        text.clock_minutes(F.col("mmss")).alias("minutes"),
        text.clock_minutes(F.col("number")).alias("plain"),
        text.iso_clock(F.col("iso")).alias("clock"),
        text.feet_inches(F.col("height")).alias("inches"),
        text.record_wins(F.col("record")).alias("wins"),
        text.record_losses(F.col("record")).alias("losses"),
    )


@query(
    "sc_mixed_dates",
    "game:l day:d",
    "SELECT game, CASE WHEN game % 4 = 3 THEN NULL ELSE game_date END AS day FROM contest",
)
def mixed_dates(s: Shapes) -> DataFrame:
    mixed = s.contest().selectExpr(
        "game",
        "CASE game % 4 WHEN 0 THEN date_format(game_date, 'yyyy-MM-dd') WHEN 1 THEN date_format(game_date, 'yyyy-MM-dd 00:00:00')"
        " WHEN 2 THEN date_format(game_date, 'MM/dd/yyyy') ELSE 'not a date' END AS raw",
    )
    return mixed.select("game", F.to_date(text.mixed_date(F.col("raw"))).alias("day"))


@query(
    "sc_utc_to_local_date",
    "event:l fixed_day:d",
    "SELECT event, CAST(ts - INTERVAL 5 HOURS AS DATE) AS fixed_day FROM event_log",
)
def utc_to_local_date(s: Shapes) -> DataFrame:
    return s.log().select("event", text.local_date(F.col("ts")).alias("fixed_day"))


@query(
    "sc_utc_to_zone_date",
    "event:l zone_day:d",
    "SELECT event, CAST(ts - INTERVAL 5 HOURS AS DATE) AS zone_day FROM event_log",
)
def utc_to_zone_date(s: Shapes) -> DataFrame:
    # The events are from January, when New York is five hours behind.
    return s.log().select("event", text.local_date(F.col("ts"), "America/New_York").alias("zone_day"))


@query(
    "sc_odds_convert",
    "game_date:d home:i away:i decimal:f6 implied:f6",
    """SELECT *, CASE WHEN home_ml >= 100 THEN home_ml / 100.0 + 1 ELSE 100.0 / abs(home_ml) + 1 END AS decimal,
    CASE WHEN home_ml >= 100 THEN 100.0 / (home_ml + 100) ELSE abs(home_ml) / (abs(home_ml) + 100.0) END AS implied FROM odds""",
)
def odds_convert(s: Shapes) -> DataFrame:
    ml = F.col("home_ml")
    return s.odds().withColumns({"decimal": market.decimal_odds(ml), "implied": market.implied_probability(ml)})


@query(
    "sc_no_vig",
    "id:l market_home:f6 market_away:f6",
    "SELECT * FROM priced",
)
def no_vig(s: Shapes) -> DataFrame:
    home, away = market.no_vig(F.col("home_ml"), F.col("away_ml"))
    return priced(s).withColumns({"market_home": home, "market_away": away})


def with_market(s: Shapes) -> DataFrame:
    home, _ = market.no_vig(F.col("home_ml"), F.col("away_ml"))
    return priced(s).withColumn("market_home", home)


@query("sc_expected_value", "id:l ev:f6", "SELECT id, p_home / market_home - 1 AS ev FROM priced")
def expected_value(s: Shapes) -> DataFrame:
    return with_market(s).select("id", market.expected_value(F.col("p_home"), F.col("market_home")).alias("ev"))


_KELLY = "0.5 * (p * ((1 - q) / q) - (1 - p)) / ((1 - q) / q)"


@query(
    "sc_kelly",
    "id:l stake:f6 uncapped:f6",
    f"""SELECT id, least(greatest({_KELLY}, 0), 0.05) AS stake, greatest({_KELLY}, 0) AS uncapped FROM
    (SELECT id, CASE WHEN p_home > market_home THEN p_home ELSE 1 - p_home END AS p,
      CASE WHEN p_home > market_home THEN market_home ELSE 1 - market_home END AS q FROM priced)""",
)
def kelly(s: Shapes) -> DataFrame:
    p, q = F.col("p_home"), F.col("market_home")
    return with_market(s).select(
        "id", market.kelly(p, q, p > q).alias("stake"), market.kelly(p, q, p > q, cap=None).alias("uncapped")
    )


@query(
    "sc_value_flag",
    "id:l edge:f6 edge_magnitude:f6 is_value_bet:i bet_side:s ev:f6 confidence_tier:s",
    f"""SELECT *, abs(edge) AS edge_magnitude, CAST(abs(edge) > 0.03 AS INT) AS is_value_bet,
    CASE WHEN edge > 0 THEN 'home' ELSE 'away' END AS bet_side, {TIER_SQL.format(e="abs(edge)")} AS confidence_tier
    FROM (SELECT id, p_home - market_home AS edge, p_home / market_home - 1 AS ev FROM priced)""",
)
def value_flag(s: Shapes) -> DataFrame:
    return with_market(s).withColumns(market.value_flags(F.col("p_home"), F.col("market_home")))


AGREE_SQL = "(abs(margin) < 1.5 OR (p_home > 0.5) = (margin > 0))"


@query(
    "sc_confidence_tier",
    "id:l agree:i tier:s no_odds_tier:s",
    f"""SELECT id, CAST({AGREE_SQL} AS INT) AS agree,
    CASE WHEN NOT {AGREE_SQL} THEN 'Skip' ELSE {TIER_SQL.format(e="abs(p_home - market_home)")} END AS tier,
    CASE WHEN greatest(p_home, 1 - p_home) >= 0.72 AND {AGREE_SQL} THEN 'Solid Pick'
      WHEN greatest(p_home, 1 - p_home) >= 0.60 THEN 'Lean' ELSE 'Skip' END AS no_odds_tier FROM priced""",
)
def confidence_tier(s: Shapes) -> DataFrame:
    agree = market.models_agree(F.col("p_home"), F.col("margin"))
    return with_market(s).select(
        "id",
        agree.cast("int").alias("agree"),
        market.tier(F.abs(F.col("p_home") - F.col("market_home")), agree).alias("tier"),
        market.tier_without_odds(F.col("p_home"), agree).alias("no_odds_tier"),
    )


@query(
    "sc_moneyline_market",
    "id:l prob:f4 edge:f4 ev:f4 models_agree:i confidence_tier:s",
    f"""SELECT id, p_home AS prob, p_home - market_home AS edge, p_home / market_home - 1 AS ev,
    CAST({AGREE_SQL} AS INT) AS models_agree, CASE WHEN NOT {AGREE_SQL} THEN 'Skip'
      ELSE {TIER_SQL.format(e="abs(p_home - market_home)")} END AS confidence_tier FROM priced""",
)
def moneyline_market(s: Shapes) -> DataFrame:
    columns = [F.col(c) for c in ("p_home", "margin", "home_ml", "away_ml")]
    return priced(s).select("id", *[c.alias(n) for n, c in market.moneyline(*columns).items()])


# The polynomial of Abramowitz and Stegun 7.1.26.
PHI_SQL = """CASE WHEN {x} >= 0 THEN 0.5 * (1 + ({erf})) ELSE 0.5 * (1 - ({erf})) END"""
ERF_SQL = """1 - (0.254829592 * {t} - 0.284496736 * pow({t}, 2) + 1.421413741 * pow({t}, 3)
  - 1.453152027 * pow({t}, 4) + 1.061405429 * pow({t}, 5)) * exp(-pow({x}, 2) / 2)"""


def phi_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0)))"
    return PHI_SQL.format(x=x, erf=ERF_SQL.format(t=t, x=x))


@query(
    "sc_cover_probability",
    "id:l cover_prob:f6 edge:f6 tier:s",
    f"""SELECT id, cover_prob, cover_prob - 0.5 AS edge, CASE WHEN NOT {AGREE_SQL} THEN 'Skip'
      ELSE {TIER_SQL.format(e="abs(cover_prob - 0.5)")} END AS tier
    FROM (SELECT *, {phi_sql("((margin - spread) / 10.5)")} AS cover_prob FROM priced)""",
)
def cover_probability(s: Shapes) -> DataFrame:
    cover = market.cover_probability(F.col("margin"), F.col("spread"))
    agree = market.models_agree(F.col("p_home"), F.col("margin"))
    return priced(s).select(
        "id",
        cover.alias("cover_prob"),
        (cover - 0.5).alias("edge"),
        market.tier(F.abs(cover - 0.5), agree).alias("tier"),
    )


@query(
    "sc_over_probability",
    "player:l game:l over_prob:f6 tier:s",
    f"""SELECT *, {TIER_SQL.format(e="abs(over_prob - 0.5)")} AS tier FROM (SELECT *, least(0.95, greatest(0.05,
      0.5 + (pts - (10 + game % 17)) / greatest((pts + reb) - (pts - ast) * 1.0, 3))) AS over_prob FROM player_log)""",
)
def over_probability(s: Shapes) -> DataFrame:
    pts, line = F.col("pts"), 10 + F.col("game") % 17
    over = market.over_probability(pts - F.col("ast"), pts, pts + F.col("reb"), line)
    return s.player_log().select(
        "player", "game", over.alias("over_prob"), market.tier(F.abs(over - 0.5), F.lit(True)).alias("tier")
    )


@query(
    "sc_cover_label",
    "game:l covers:i",
    """SELECT game, CASE WHEN game % 3 = 2 THEN NULL WHEN game % 2 = 0 THEN CAST(game % 3 = 1 AS INT)
    ELSE CAST(game % 3 = 0 AS INT) END AS covers FROM contest""",
)
def cover_label(s: Shapes) -> DataFrame:
    favourite = F.when(F.col("game") % 2 == 0, "home").otherwise("away")
    return s.contest().select("game", market.home_covers(F.col("game") % 3, favourite).alias("covers"))


@query(
    "sc_clv_side",
    "id:l side:s clv:f6",
    """SELECT id, CASE WHEN p_home > 0.5 THEN 'home' ELSE 'away' END AS side,
    coalesce(CASE WHEN p_home > 0.5 THEN spread - close_spread ELSE close_spread - spread END, 0) AS clv FROM priced""",
)
def clv_side(s: Shapes) -> DataFrame:
    side = F.when(F.col("p_home") > 0.5, "home").otherwise("away")
    return priced(s).withColumn("side", side).withColumn(
        "clv", market.closing_line_value(F.col("spread"), F.col("close_spread"), F.col("side"))
    )


@query(
    "sc_haversine",
    "game:l miles:f4",
    """SELECT game, 2 * 3958.8 * asin(sqrt(pow(sin(radians(lb - la) / 2), 2)
      + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(ob - oa) / 2), 2))) AS miles FROM
    (SELECT game, home % 60 - 20.5 AS la, home * 7.0 - 90 AS oa, away % 60 + 10.5 AS lb, away * 5.0 - 60 AS ob FROM contest)""",
)
def haversine(s: Shapes) -> DataFrame:
    home, away = F.col("home"), F.col("away")
    miles = great_circle_miles(home % 60 - 20.5, home * 7.0 - 90, away % 60 + 10.5, away * 5.0 - 60)
    return s.contest().select("game", miles.alias("miles"))


@query(
    "sc_pythagorean",
    "game:l team:i expected:f6",
    """SELECT game, team, pow(greatest(pts, 1), 14.3) / (pow(greatest(pts, 1), 14.3) + pow(greatest(opp_pts, 1), 14.3))
    AS expected FROM contest_log""",
)
def pythagorean(s: Shapes) -> DataFrame:
    return s.contest_log().select(
        "game", "team", measures.pythagorean(F.col("pts"), F.col("opp_pts")).alias("expected")
    )


BOX = ["pts", "fga", "fgm", "fg3m", "fg3a", "fta", "oreb", "dreb", "tov"]


def both_boxes(s: Shapes) -> DataFrame:
    """The log with the opponent's box score from the other row of the game."""
    from duelframe.operators.joins import opponent_columns

    return opponent_columns(s.contest_log().drop("opp_pts"), ["game"], "team", "opp", BOX)


SHARED_SQL["boxed"] = (
    "SELECT a.*, " + ", ".join(f"b.{c} AS opp_{c}" for c in BOX if c != "pts")
    + " FROM contest_log a JOIN contest_log b ON a.game = b.game AND a.opp = b.team"
)
SHARED_SQL["rated"] = """SELECT *, off_rtg - def_rtg AS net_rtg FROM (SELECT *,
  pts / pace * 100 AS off_rtg, opp_pts / pace * 100 AS def_rtg, (fgm + 0.5 * fg3m) / fga AS efg,
  pts / (2 * (fga + 0.44 * fta)) AS ts, tov / poss AS tov_poss, tov / (fga + 0.44 * fta + tov) AS tov_pct,
  oreb / (oreb + opp_dreb) AS oreb_pct, fta / fga AS ft_rate FROM
  (SELECT *, (poss + opp_fga - opp_oreb + opp_tov + 0.44 * opp_fta) / 2 AS pace FROM
    (SELECT *, fga - oreb + tov + 0.44 * fta AS poss FROM boxed)))"""


@query(
    "sc_efficiency",
    "game:l team:i pace:f6 off_rtg:f6 def_rtg:f6 net_rtg:f6 efg:f6 ts:f6 tov_poss:f6 tov_pct:f6 oreb_pct:f6 ft_rate:f6",
    "SELECT * FROM rated",
)
def efficiency(s: Shapes) -> DataFrame:
    return both_boxes(s).select("game", "team", *[c.alias(n) for n, c in measures.efficiency().items()])


@query(
    "sc_weighted_composite",
    "game:l team:i four_factors:f9 power:f9 power_100:f9",
    """SELECT *, least(100, greatest(0, (power + 12) / 24 * 100)) AS power_100 FROM (SELECT game, team,
    0.40 * efg + 0.25 * (1 - tov_pct) + 0.20 * oreb_pct + 0.15 * ft_rate AS four_factors,
    0.20 * net_rtg + 0.15 * plus_minus + 0.20 * (efg - 0.5) * 24 + 0.45 * (win - 0.5) * 24 AS power FROM rated)""",
)
def weighted_composite(s: Shapes) -> DataFrame:
    rated = both_boxes(s).withColumns(measures.efficiency())
    c = F.col
    return rated.select(
        "game",
        "team",
        measures.four_factors(c("efg"), c("tov_pct"), c("oreb_pct"), c("ft_rate")).alias("four_factors"),
        measures.power_score(c("net_rtg"), c("plus_minus"), c("efg"), c("win")).alias("power"),
    ).withColumn("power_100", measures.scale_0_100(c("power"), -12.0, 12.0))


@query(
    "sc_rate_per_unit",
    "player:l game:l pts36:f6 ast_minute:f6",
    """SELECT *, CASE WHEN minutes > 0 THEN pts / minutes * 36 END AS pts36,
    CASE WHEN minutes > 0 THEN ast / minutes END AS ast_minute FROM player_log""",
)
def rate_per_unit(s: Shapes) -> DataFrame:
    c = F.col
    return s.player_log().withColumns({
        "pts36": measures.per_unit(c("pts"), c("minutes"), 36),
        "ast_minute": measures.per_unit(c("ast"), c("minutes")),
    })


SEASON_MEANS = ["minutes", "pts", "reb", "ast", "fg3m", "fga", "fta", "tov"]


def player_seasons(s: Shapes) -> DataFrame:
    """Per-game averages by player and season."""
    return s.player_log().groupBy("player", "team", "season").agg(
        F.count(F.lit(1)).alias("gp"), *[F.avg(c).alias(c) for c in SEASON_MEANS]
    )


SHARED_SQL["player_seasons"] = (
    "SELECT player, team, season, count(*) AS gp, " + ", ".join(f"avg({c}) AS {c}" for c in SEASON_MEANS)
    + " FROM player_log GROUP BY player, team, season"
)
SHARED_SQL["team_seasons"] = """SELECT team, season, 48.0 AS minutes, avg(fga) AS fga, avg(fta) AS fta, avg(tov) AS tov,
  avg(fgm) AS fgm, avg(oreb) AS oreb, avg(dreb) AS dreb, avg(fg3m) AS stl FROM contest_log GROUP BY team, season"""


@query(
    "sc_advanced_rates",
    "player:l season:i usg_pct:f4 ast_pct:f4 tov_pct:f4 efg_pct:f4 oreb_pct:f4 dreb_pct:f4 stl_pct:f4",
    """SELECT *, CASE WHEN m > 0 THEN 100 * chances * 48.0 / (m * (tfga + 0.44 * tfta + ttov)) END AS usg_pct,
    CASE WHEN m / 48.0 * tfgm - fgm > 0 THEN 100 * ast / (m / 48.0 * tfgm - fgm) END AS ast_pct,
    CASE WHEN m > 0 AND chances > 0 THEN 100 * tov / chances END AS tov_pct,
    CASE WHEN fga > 0 THEN (fgm + 0.5 * fg3m) / fga END AS efg_pct,
    CASE WHEN m > 0 THEN 100 * oreb * 48.0 / (m * (toreb + lg_dreb)) END AS oreb_pct,
    CASE WHEN m > 0 THEN 100 * dreb * 48.0 / (m * (tdreb + lg_oreb)) END AS dreb_pct,
    CASE WHEN m > 0 THEN 100 * stl * 48.0 / (m * (tfga - toreb + ttov + 0.44 * tfta)) END AS stl_pct FROM
    (SELECT p.player, p.season, p.minutes AS m, p.fga + 0.44 * p.fta + p.tov AS chances, p.fga, p.fga * 0.45 AS fgm, p.fg3m,
      p.ast, p.tov, p.reb * 0.3 AS oreb, p.reb * 0.7 AS dreb, p.ast * 0.2 AS stl, t.fga AS tfga, t.fta AS tfta, t.tov AS ttov,
      t.fgm AS tfgm, t.oreb AS toreb, t.dreb AS tdreb, l.oreb AS lg_oreb, l.dreb AS lg_dreb
     FROM player_seasons p JOIN team_seasons t USING (team, season)
     JOIN (SELECT season, avg(oreb) AS oreb, avg(dreb) AS dreb FROM team_seasons GROUP BY season) l USING (season))""",
)
def advanced_rates(s: Shapes) -> DataFrame:
    teams = s.contest_log().groupBy("team", "season").agg(
        *[F.avg(c).alias(f"t_{c}") for c in ("fga", "fta", "tov", "fgm", "oreb", "dreb", "fg3m")]
    )
    league = teams.groupBy("season").agg(F.avg("t_oreb").alias("l_oreb"), F.avg("t_dreb").alias("l_dreb"))
    joined = player_seasons(s).join(teams, ["team", "season"]).join(league, "season")
    c = F.col
    player = {
        "min": c("minutes"), "fga": c("fga"), "fta": c("fta"), "tov": c("tov"), "fgm": c("fga") * 0.45,
        "fg3m": c("fg3m"), "ast": c("ast"), "oreb": c("reb") * 0.3, "dreb": c("reb") * 0.7, "stl": c("ast") * 0.2,
    }
    team = {n: c(f"t_{n}") for n in ("fga", "fta", "tov", "fgm", "oreb", "dreb")} | {
        "min": F.lit(48.0), "stl": c("t_fg3m"),
    }
    rates = measures.usage_rates(player, team, {"oreb": c("l_oreb"), "dreb": c("l_dreb")})
    return joined.select("player", "season", *[r.alias(n) for n, r in rates.items()])


@query(
    "sc_index_to_baseline",
    "player:l season:i pts_indexed:f4 per36_pts:f4 pace_factor:f4 ts_pct:f4",
    """SELECT player, season, CASE WHEN a.pts <> 0 THEN p.pts / a.pts * b.pts ELSE p.pts END AS pts_indexed,
    CASE WHEN p.minutes * gp > 0 THEN p.pts * gp / (p.minutes * gp) * 36 END AS per36_pts, a.fga / b.fga AS pace_factor,
    CASE WHEN p.fga + p.fta > 0 THEN p.pts / (2 * (p.fga + 0.44 * p.fta)) END AS ts_pct FROM player_seasons p
    JOIN (SELECT season, avg(pts) AS pts, avg(fga) AS fga FROM player_seasons GROUP BY season) a USING (season)
    CROSS JOIN (SELECT avg(pts) AS pts, avg(fga) AS fga FROM
      (SELECT season, avg(pts) AS pts, avg(fga) AS fga FROM player_seasons GROUP BY season)) b""",
)
def index_to_baseline(s: Shapes) -> DataFrame:
    from duelframe.operators.aggregates import period_averages

    seasons = player_seasons(s)
    averages = period_averages(seasons, "season", ["pts", "fga"])
    c = F.col
    total_minutes = c("minutes") * c("gp")
    return seasons.join(averages, "season").select(
        "player",
        "season",
        measures.indexed(c("pts"), c("avg_pts"), c("all_pts")).alias("pts_indexed"),
        measures.per_unit(c("pts") * c("gp"), total_minutes, 36).alias("per36_pts"),
        measures.ratio(c("avg_fga"), c("all_fga")).alias("pace_factor"),
        measures.per_unit(c("pts"), 2 * (c("fga") + 0.44 * c("fta"))).alias("ts_pct"),
    )


@query(
    "sc_bucketize",
    "id:l spread_bucket:i impact:s movement:s confidence:s",
    """SELECT id, CASE WHEN abs(spread) <= 3 THEN 0 WHEN abs(spread) <= 7 THEN 1 WHEN abs(spread) <= 10 THEN 2 ELSE 3 END AS spread_bucket,
    CASE WHEN total - 205 >= 15 THEN 'High' WHEN total - 205 >= 8 THEN 'Medium' ELSE 'Low' END AS impact,
    CASE WHEN abs(close_spread - spread) >= 1.5 THEN 'sharp_action' WHEN abs(close_spread - spread) >= 0.5 THEN 'moderate_move'
      WHEN close_spread IS NOT NULL THEN 'stable' END AS movement,
    CASE WHEN c < 0.55 THEN '50-55%' WHEN c < 0.6 THEN '55-60%' WHEN c < 0.65 THEN '60-65%' WHEN c < 0.7 THEN '65-70%'
      WHEN c < 0.75 THEN '70-75%' WHEN c < 0.8 THEN '75-80%' ELSE '80%+' END AS confidence
    FROM (SELECT *, greatest(p_home, 1 - p_home) AS c FROM priced)""",
)
def bucketize(s: Shapes) -> DataFrame:
    c = F.col
    confidence = F.greatest(c("p_home"), 1 - c("p_home"))
    labels = ["50-55%", "55-60%", "60-65%", "65-70%", "70-75%", "75-80%", "80%+"]
    move = F.abs(c("close_spread") - c("spread"))
    return priced(s).select(
        "id",
        measures.bucket(F.abs(c("spread")), [3.0, 7.0, 10.0], [0, 1, 2, 3], closed_right=True).alias("spread_bucket"),
        measures.bucket(c("total") - 205, [8, 15], ["Low", "Medium", "High"]).alias("impact"),
        measures.bucket(move, [0.5, 1.5], ["stable", "moderate_move", "sharp_action"]).alias("movement"),
        measures.bucket(confidence, [0.55, 0.6, 0.65, 0.7, 0.75, 0.8], labels).alias("confidence"),
    )


# Buckets of roster labels.
POSITION_BUCKETS = {
    "PG": "G", "SG": "G", "G": "G", "GUARD": "G",
    "SF": "F", "PF": "F", "F": "F", "FORWARD": "F",
    "C": "C", "CENTER": "C",
}


@query(
    "sc_category_map",
    "p_partkey:l bucket:s positions:s",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'G' WHEN 2 THEN 'F' WHEN 3 THEN 'C' WHEN 4 THEN 'G'
      WHEN 5 THEN 'C' ELSE 'F' END AS bucket,
    CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN
        CASE WHEN h <= 76 THEN 'PG' WHEN h <= 78 THEN CASE WHEN a >= 5 THEN 'PG, SG' ELSE 'SG' END ELSE 'SG' END
      WHEN 2 THEN CASE WHEN a >= 5 THEN 'PG, SG' ELSE 'SG, SF' END WHEN 3 THEN 'C' WHEN 4 THEN 'SG, SF'
      WHEN 5 THEN 'C, PF' ELSE CASE WHEN h <= 79 THEN 'SF' WHEN h <= 81 THEN 'SF, PF' ELSE 'PF' END END AS positions
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 78 ELSE 72 + p_size % 14 END AS h, p_size % 10 AS a FROM part)""",
)
def category_map(s: Shapes) -> DataFrame:
    raw = s.part.selectExpr(
        "p_partkey",
        "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' g ' WHEN 2 THEN 'F-G' WHEN 3 THEN 'C' WHEN 4 THEN 'G-F'"
        " WHEN 5 THEN 'C-F' ELSE 'f' END AS label",
        "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 72 + p_size % 14 END AS height",
        "p_size % 10 AS assists",
    )
    return raw.select(
        "p_partkey",
        text.category(F.col("label"), POSITION_BUCKETS, "F").alias("bucket"),
        text.granular_positions(F.col("label"), F.col("height"), F.col("assists")).alias("positions"),
    )


def _centroid_sql() -> str:
    ranges = measures.centroid_ranges()
    branches = []
    for position, centre in measures.CENTROIDS.items():
        terms = " + ".join(
            f"{w} * pow((f.{n} - {centre[n]}) / {ranges[n]!r}, 2)" for n, w in measures.CENTROID_WEIGHTS.items()
        )
        branches.append(f"SELECT f.player, '{position}' AS position, {terms} AS distance FROM feats f")
    return " UNION ALL ".join(branches)


@query(
    "sc_nearest_centroid",
    "player:l position:s",
    f"""WITH feats AS (SELECT player, coalesce(avg(ast), 0) * 3 AS ast_pct, coalesce(avg(reb), 0) * 0.5 AS oreb_pct, coalesce(avg(reb), 0) * 2 AS dreb_pct,
      coalesce(avg(tov), 0) * 0.3 AS blk, coalesce(avg(ast), 0) * 0.5 AS ast, coalesce(avg(reb), 0) * 0.8 AS reb FROM player_log GROUP BY player),
    scored AS ({_centroid_sql()}),
    placed AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY distance, position) AS n FROM scored),
    allowed AS (SELECT player, CASE player % 4 WHEN 0 THEN ['PG', 'SG'] WHEN 1 THEN ['SF', 'PF'] WHEN 2 THEN ['PF', 'C'] END AS ps FROM feats),
    counted AS (SELECT player, ast / greatest(reb, 0.1) AS spread, CASE WHEN reb >= 8 AND blk >= 1 THEN 'C' WHEN reb >= 7.5 THEN 'PF' WHEN ast >= 6 THEN 'PG'
      WHEN reb >= 4.5 THEN 'SF' WHEN ast / greatest(reb, 0.1) >= 1 THEN 'PG' WHEN ast >= 2.5 AND reb < 3.5 THEN 'SG' WHEN reb >= 3.5 THEN 'SF' ELSE 'SG' END AS named FROM feats)
    SELECT f.player, CASE WHEN NOT (f.ast_pct > 0 AND f.oreb_pct > 0) THEN CASE WHEN ps IS NULL OR list_contains(ps, named) THEN named
        WHEN list_contains(ps, 'PG') AND spread > 0.8 THEN 'PG' WHEN list_contains(ps, 'SG') THEN 'SG' ELSE list_min(ps) END
      WHEN ps IS NOT NULL THEN (SELECT arg_min(position, n) FROM placed q WHERE q.player = f.player AND list_contains(a.ps, q.position))
      WHEN (SELECT list_sort(list(position)) FROM placed q WHERE q.player = f.player AND n <= 2) = ['PG', 'SG']
        THEN CASE WHEN f.ast / greatest(f.reb, 0.1) >= 0.95 THEN 'PG' ELSE 'SG' END
      ELSE (SELECT position FROM placed q WHERE q.player = f.player AND n = 1) END AS position
    FROM feats f JOIN allowed a ON f.player = a.player JOIN counted c ON f.player = c.player""",
)
def nearest_centroid(s: Shapes) -> DataFrame:
    careers = s.player_log().groupBy("player").agg(F.avg("ast").alias("a"), F.avg("reb").alias("r"), F.avg("tov").alias("t"))
    a, r, t = F.col("a"), F.col("r"), F.col("t")
    features = {"ast_pct": a * 3, "oreb_pct": r * 0.5, "dreb_pct": r * 2, "blk": t * 0.3, "ast": a * 0.5, "reb": r * 0.8}
    generic = F.element_at(F.array(F.lit("G"), F.lit("F"), F.lit("F-C"), F.lit("")), (F.col("player") % 4 + 1).cast("int"))
    return careers.select("player", measures.infer_position(features, generic).alias("position"))


@query(
    "sc_pair_normalize",
    "game:l home_score:i away_score:i low_home:i low_away:i",
    """SELECT game, CASE WHEN h IS NULL THEN 40 WHEN home_pts = away_pts THEN 50 WHEN home_pts > away_pts THEN 80 ELSE 20 END AS home_score,
    CASE WHEN h IS NULL THEN 60 WHEN home_pts = away_pts THEN 50 WHEN home_pts > away_pts THEN 20 ELSE 80 END AS away_score,
    CASE WHEN h IS NULL THEN 60 WHEN home_pts = away_pts THEN 50 WHEN home_pts < away_pts THEN 80 ELSE 20 END AS low_home,
    CASE WHEN h IS NULL THEN 40 WHEN home_pts = away_pts THEN 50 WHEN home_pts < away_pts THEN 20 ELSE 80 END AS low_away
    FROM (SELECT *, CASE WHEN game % 10 = 0 THEN NULL ELSE home_pts END AS h FROM contest)""",
)
def pair_normalize(s: Shapes) -> DataFrame:
    home = F.when(F.col("game") % 10 != 0, F.col("home_pts"))
    high, low = measures.pair_scores(home, F.col("away_pts")), measures.pair_scores(home, F.col("away_pts"), False)
    return s.contest().select(
        "game", high[0].alias("home_score"), high[1].alias("away_score"), low[0].alias("low_home"), low[1].alias("low_away")
    )


SHARED_SQL["blended"] = """SELECT *, score - 0.5 AS edge FROM (SELECT *,
  CASE regime WHEN 'high_confidence' THEN 0.75 * p_home + 0.25 * signal WHEN 'uncertain' THEN 0.55 * p_home + 0.45 * signal
    ELSE 0.65 * p_home + 0.35 * signal END AS score FROM
  (SELECT *, 1 / (1 + exp(-margin / 15)) AS signal, CASE WHEN p_home > 0.65 OR p_home < 0.35 THEN 'high_confidence'
    WHEN p_home BETWEEN 0.45 AND 0.55 THEN 'uncertain' ELSE 'default' END AS regime FROM predictions))"""


@query(
    "sc_blend_regime",
    "id:l margin_signal:f6 ensemble_score:f6 ensemble_edge:f6 confidence:s weight_regime:s",
    """SELECT id, signal AS margin_signal, score AS ensemble_score, edge AS ensemble_edge, regime AS weight_regime,
    CASE WHEN abs(edge) > 0.15 THEN 'high' WHEN abs(edge) > 0.08 THEN 'medium' ELSE 'low' END AS confidence FROM blended""",
)
def blend_regime(s: Shapes) -> DataFrame:
    return s.predictions().withColumns(market.blend(F.col("p_home"), F.lit(0.5), F.col("margin")))


@query(
    "sc_logistic_adjust",
    "player:l game:l adjusted:f6",
    """SELECT player, game, minutes * (1 - 0.25 / (1 + exp(-0.3 * (abs(game % 41 - 20) - 10)))) AS adjusted FROM player_log""",
)
def logistic_adjust(s: Shapes) -> DataFrame:
    return s.player_log().select(
        "player", "game", market.lopsided_minutes(F.col("minutes"), F.col("game") % 41 - 20).alias("adjusted")
    )


@query(
    "sc_prob_spread",
    "id:l from_prob:f4 from_spread:f6 proxy:f6",
    """SELECT id, (0.5 - p_home) * 33.3 AS from_prob, 1 / (1 + exp(-spread / 10)) AS from_spread,
    1 / (1 + exp(-((p_home - 0.5) * 2.5 + coalesce(close_spread, 0) * 0.03))) AS proxy FROM priced""",
)
def prob_spread(s: Shapes) -> DataFrame:
    c = F.col
    return priced(s).select(
        "id",
        market.spread_from_probability(c("p_home")).alias("from_prob"),
        market.probability_from_spread(c("spread")).alias("from_spread"),
        market.proxy_win_probability(c("p_home") - 0.5, c("close_spread")).alias("proxy"),
    )


@query(
    "sc_bradley_terry",
    "game:l p:f9",
    """SELECT game, 0.85 * (h / (1 - h) * 1.5) / (h / (1 - h) * 1.5 + a / (1 - a)) + 0.075 AS p FROM
    (SELECT game, least(greatest((game % 83) / 82.0, 0.01), 0.99) AS h, least(greatest((game % 79) / 78.0, 0.01), 0.99) AS a FROM contest)""",
)
def bradley_terry(s: Shapes) -> DataFrame:
    p = market.paired_strength(F.col("game") % 83 / 82.0, F.col("game") % 79 / 78.0)
    return s.contest().select("game", p.alias("p"))


@query(
    "sc_flag_array",
    "game:l flags:s",
    """SELECT game, concat_ws(',', CASE WHEN game % 5 = 0 THEN 'HOME_B2B' END, CASE WHEN game % 7 = 0 THEN 'AWAY_B2B' END,
    CASE WHEN hr - ar >= 2 THEN 'REST_ADV_HOME' WHEN hr - ar <= -2 THEN 'REST_ADV_AWAY'
      WHEN ar IS NULL AND hr >= 3 THEN 'REST_ADV_HOME' WHEN hr IS NULL AND ar >= 3 THEN 'REST_ADV_AWAY' END,
    CASE WHEN game % 8 >= 5 THEN 'HOME_HOT' WHEN game % 8 <= 2 THEN 'HOME_COLD' END,
    CASE WHEN (game + 3) % 8 >= 5 THEN 'AWAY_HOT' WHEN (game + 3) % 8 <= 2 THEN 'AWAY_COLD' END,
    CASE WHEN game % 11 = 0 THEN 'INJ_IMPACT_HOME' END, CASE WHEN game % 17 = 0 THEN 'INJ_IMPACT_AWAY' END) AS flags
    FROM (SELECT game, CASE WHEN game % 9 = 0 THEN NULL ELSE game % 6 END AS hr, CASE WHEN game % 10 = 0 THEN NULL ELSE game % 4 END AS ar FROM contest)""",
)
def flag_array(s: Shapes) -> DataFrame:
    g = F.col("game")
    home = {"b2b": g % 5 == 0, "rest": F.when(g % 9 != 0, g % 6), "wins7": g % 8, "star_out": g % 11 == 0}
    away = {"b2b": g % 7 == 0, "rest": F.when(g % 10 != 0, g % 4), "wins7": (g + 3) % 8, "star_out": g % 17 == 0}
    return s.contest().select("game", F.array_join(measures.situation_flags(home, away), ",").alias("flags"))


@query(
    "sc_explain_text",
    "id:l bullets:s one_liner:s confidence:s factors:s",
    """SELECT id, CASE WHEN len(found) = 0 THEN concat('Model projects ', h, ' as ', printf('%.1f%%', p_home * 100),
          ' favorites -- market implies ', printf('%.1f%%', market_home * 100), '|', form)
        WHEN len(found) = 1 THEN concat(found[1], '|', form) ELSE array_to_string(found[1:4], '|') END AS bullets,
      concat(rec, ' is undervalued -- books give them ', printf('%.1f%%', rec_market * 100), ' but our model says ',
        printf('%.1f%%', rec_p * 100), ' (model projects home win by ', printf('%.1f', abs(margin)), ')') AS one_liner,
      concat('Model favors ', rec, ' with ', printf('%.0f%%', rec_p * 100), ' confidence based on ', CASE WHEN abs(margin) >= 2
        THEN concat('net rating ', CASE WHEN margin > 0 THEN 'advantage' ELSE 'disadvantage' END, ' of ', printf('%+.1f', margin),
          ' pts/100; ') ELSE '' END, 'recent form ', hw, '-', 10 - hw, ' vs ', aw, '-', 10 - aw, ' (L10)') AS confidence,
      concat_ws('|', CASE WHEN conf >= 80 THEN concat('Strong model confidence (', conf, '%) favoring ', rec)
        WHEN conf >= 65 THEN concat('Moderate model confidence (', conf, '%) favoring ', rec)
        WHEN conf > 50 THEN concat('Slight edge (', conf, '%) favoring ', rec) END,
        CASE WHEN b2b THEN concat(a, ' on back-to-back (fatigue risk)') END,
        CASE WHEN streak >= 4 THEN concat(h, ' on ', streak, '-game home win streak')
          WHEN streak <= -4 THEN concat(h, ' on ', -streak, '-game home losing streak') END,
        CASE WHEN abs(margin) >= 8 THEN concat('Model projects decisive margin (', printf('%+.1f', margin), ' pts)')
          WHEN abs(margin) <= 3 THEN concat('Model projects a tight game (', printf('%+.1f', margin), ' pts)') END,
        CASE WHEN edge > 0.05 THEN concat('Value bet detected (edge: ', printf('%.1f%%', edge * 100), ')') END) AS factors
    FROM (SELECT *, list_filter([CASE WHEN b2b THEN concat(a, ' playing 2nd game in 2 nights -- fatigue factor') END,
        CASE WHEN p_home > 0.65 THEN concat('Model shows strong home advantage -- ', printf('%.1f%%', p_home * 100),
          ' win probability vs ', printf('%.1f%%', market_home * 100), ' implied by the line') END,
        CASE WHEN hw >= 7 THEN concat(h, ' is ', hw, '-', 10 - hw, ' in their last 10 games') END,
        CASE WHEN aw <= 3 THEN concat(a, ' has struggled recently -- only ', aw, ' wins in their last 10 games') END,
        CASE WHEN game % 6 > game % 4 + 1 THEN concat(h, ' has ', game % 6, ' days rest vs ', a, '''s ', game % 4, ' -- significant rest advantage') END,
        CASE WHEN edge > 0.1 THEN concat('Model edge of ', printf('%.1f%%', edge * 100), ' -- significantly above our threshold for value bets') END,
        CASE WHEN margin > 5 THEN concat(h, ' outperforms ', a, ' by ', printf('%.1f', margin), ' points per 100 possessions in net rating') END],
        lambda x: x IS NOT NULL) AS found,
        concat('Recent form: ', h, ' ', hw, '-', 10 - hw, ' L10 vs ', a, ' ', aw, '-', 10 - aw, ' L10') AS form
      FROM (SELECT *, concat('T', home) AS h, concat('T', away) AS a, game % 6 = 0 AS b2b, game % 11 AS hw, (game * 3) % 11 AS aw,
          p_home - market_home AS edge, game % 15 - 7 AS streak, CAST(round(rec_p * 100) AS INT) AS conf FROM
        (SELECT *, CASE WHEN p_home >= 0.5 THEN concat('T', home) ELSE concat('T', away) END AS rec,
          greatest(p_home, 1 - p_home) AS rec_p, CASE WHEN p_home >= 0.5 THEN market_home ELSE market_away END AS rec_market FROM priced)))""",
)
def explain_text(s: Shapes) -> DataFrame:
    c = F.col
    market_home, market_away = market.no_vig(c("home_ml"), c("away_ml"))
    g = c("game")
    rows = priced(s).withColumns({
        "h": F.concat(F.lit("T"), c("home")),
        "a": F.concat(F.lit("T"), c("away")),
        "market_home": market_home,
        "edge": c("p_home") - market_home,
        "market_away": market_away,
    })
    on_home = c("p_home") >= 0.5
    inputs = {
        "home": c("h"), "away": c("a"), "p_home": c("p_home"), "market": c("market_home"), "away_b2b": g % 6 == 0,
        "home_form": g % 11 / 10, "away_form": g * 3 % 11 / 10, "home_rest": g % 6, "away_rest": g % 4,
        "edge": c("edge"), "net_gap": c("margin"), "expected_gap": F.lit(None).cast("double"),
        "home_expected": F.lit(None).cast("double"), "away_expected": F.lit(None).cast("double"),
        "margin": c("margin"), "spread": c("spread"), "tier": F.lit("Lean"),
    }
    sure = F.greatest(c("p_home"), 1 - c("p_home"))
    factor_inputs = inputs | {
        "winner": F.when(on_home, c("h")).otherwise(c("a")), "confidence": F.round(sure * 100).cast("int"),
        "flags": F.when(g % 6 == 0, F.array(F.lit("AWAY_B2B"))).otherwise(F.array().cast("array<string>")),
        "home_streak": g % 15 - 7, "away_streak": F.lit(0), "home_rate": F.lit(0.5), "away_rate": F.lit(0.5),
        "edge": F.when(c("edge") > 0.05, c("edge")),
    }
    recommended = F.when(on_home, c("market_home")).otherwise(c("market_away"))
    return rows.select(
        "id",
        F.array_join(explain.bullets(inputs), "|").alias("bullets"),
        explain.one_liner(inputs | {"market": recommended}, on_home).alias("one_liner"),
        explain.confidence_text(inputs, on_home).alias("confidence"),
        F.array_join(explain.factors(factor_inputs), "|").alias("factors"),
    )


@query(
    "sc_null_policy",
    "player:l game:l minutes:f4 pts:f4 reb:f4",
    "SELECT player, game, coalesce(minutes, 0.5) AS minutes, pts, CASE WHEN game % 3 = 0 THEN NULL ELSE reb END AS reb FROM player_log",
)
def null_policy(s: Shapes) -> DataFrame:
    rows = s.player_log().withColumn("reb", F.when(F.col("game") % 3 != 0, F.col("reb")))
    return measures.fill_columns(rows, {"minutes": 0.5, "pts": 0.0, "reb": 0.0}, never=["reb"])


@query(
    "sc_diff_block",
    "game:l diff_pts:i diff_key:i",
    "SELECT game, home_pts - away_pts AS diff_pts, home - away AS diff_key FROM contest",
)
def diff_block(s: Shapes) -> DataFrame:
    sides = s.contest().withColumns({"home_key": F.col("home"), "away_key": F.col("away")})
    return measures.difference_block(sides, ["pts", "key", "absent"])


@query(
    "sc_feature_select",
    "feature:s filled:l mean:f6",
    """SELECT feature, count(v) AS filled, avg(v) AS mean FROM (SELECT unnest(['home_key', 'away_key', 'home_pts', 'away_pts',
      'diff_pts', 'diff_key']) AS feature, unnest([home, away, home_pts, away_pts, home_pts - away_pts, home - away]) AS v FROM contest)
    GROUP BY feature""",
)
def feature_select(s: Shapes) -> DataFrame:
    sides = s.contest().withColumns({"home_key": F.col("home"), "away_key": F.col("away")})
    df = measures.difference_block(sides, ["pts", "key"])
    names = measures.feature_columns(df, prefixes=["home_", "away_", "diff_"], contains=["_roll"])
    summary = df.agg(*[F.count(n).alias(f"n_{n}") for n in names], *[F.avg(n).alias(f"m_{n}") for n in names])
    rows = [F.struct(F.lit(n).alias("feature"), F.col(f"n_{n}").alias("filled"), F.col(f"m_{n}").alias("mean")) for n in names]
    return summary.select(F.inline(F.array(*rows)))
