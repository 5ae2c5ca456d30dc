"""Aggregate and top-k queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions.market import no_vig
from duelframe.operators import aggregates as ag, sketches as sk, topk, windows as wn
from duelframe.operators.joins import era_of
from duelframe.operators.ordered import entity_log
from duelframe.plans.queries_joins import _ERA_CASE, player_days, player_status, expected_players
from duelframe.plans.queries_scalars import phi_sql, player_seasons, priced, with_market
from duelframe.plans.queries_windows import KEY, W, rows, team_log
from duelframe.plans.registry import SHARED_SQL, query
from duelframe.plans.shapes import Shapes
from duelframe.storage import materialise

RIGHT_SQL = "((p_home >= 0.5) = (home_win = 1))"


def right():
    return (F.col("p_home") >= 0.5) == (F.col("home_win") == 1)


@query(
    "ag_conditional_split",
    "team:i season:i wins:l losses:l pct:f6 home_wins:l home_losses:l home_pct:f6 away_wins:l away_losses:l away_pct:f6 record:s",
    """SELECT team, season, sum(win) AS wins, sum(1 - win) AS losses, avg(win) AS pct, coalesce(sum(win) FILTER (WHERE is_home = 1), 0) AS home_wins,
    coalesce(sum(1 - win) FILTER (WHERE is_home = 1), 0) AS home_losses, avg(win) FILTER (WHERE is_home = 1) AS home_pct,
    coalesce(sum(win) FILTER (WHERE is_home = 0), 0) AS away_wins, coalesce(sum(1 - win) FILTER (WHERE is_home = 0), 0) AS away_losses,
    avg(win) FILTER (WHERE is_home = 0) AS away_pct, concat(CAST(sum(win) AS VARCHAR), '-', CAST(sum(1 - win) AS VARCHAR)) AS record
    FROM contest_log GROUP BY team, season""",
)
def conditional_split(s: Shapes) -> DataFrame:
    split = ag.conditional_record(s.contest_log(), ["team", "season"], "win", "is_home")
    return split.withColumn("record", F.concat_ws("-", "wins", "losses"))


@query(
    "ag_value_counts_pivot",
    "season:i team:i F:l O:l P:l",
    """SELECT season, home AS team, count(*) FILTER (WHERE status = 'F') AS F, count(*) FILTER (WHERE status = 'O') AS O,
    count(*) FILTER (WHERE status = 'P') AS P FROM contest GROUP BY season, home""",
)
def value_counts_pivot(s: Shapes) -> DataFrame:
    games = s.contest().withColumnRenamed("home", "team")
    return ag.counts_pivot(games, ["season", "team"], "status", ["F", "O", "P"])


SHARED_SQL["game_means"] = """SELECT game, game_date, avg(fta) AS mean_fta, avg(fga - oreb + tov + 0.44 * fta) AS mean_poss
  FROM contest_log GROUP BY game, game_date"""


def game_means(s: Shapes) -> DataFrame:
    poss = F.col("fga") - F.col("oreb") + F.col("tov") + 0.44 * F.col("fta")
    return s.contest_log().groupBy("game", "game_date").agg(F.avg("fta").alias("mean_fta"), F.avg(poss).alias("mean_poss"))


@query("ag_game_mean", "game:l game_date:d mean_fta:f6 mean_poss:f6", "SELECT * FROM game_means")
def game_mean(s: Shapes) -> DataFrame:
    return game_means(s)


SHARED_SQL["officials"] = """SELECT game, game_date, home, slot, trim(v) AS referee FROM
  (SELECT game, game_date, home, unnest(['slot_1', 'slot_2', 'slot_3']) AS slot, unnest([slot_1, slot_2, slot_3]) AS v FROM crew)
  WHERE v IS NOT NULL AND trim(v) <> ''"""


def officials(s: Shapes) -> DataFrame:
    return ag.unpivot_slots(s.crew(), ["game", "game_date", "home"], ["slot_1", "slot_2", "slot_3"], "referee")


@query("ag_unpivot_long", "game:l slot:s referee:s", "SELECT * FROM officials")
def unpivot_long(s: Shapes) -> DataFrame:
    return officials(s)


_REF = "OVER (PARTITION BY referee ORDER BY game_date, game, slot"
SHARED_SQL["official_form"] = f"""SELECT o.*, avg(mean_fta) {_REF} {rows(10)}) AS fta10, avg(mean_fta) {_REF} {rows(20)}) AS fta20,
  avg(mean_poss) {_REF} {rows(10)}) AS poss10 FROM officials o JOIN game_means m USING (game, game_date)"""
SHARED_SQL["league_pace"] = f"""SELECT game_date, avg(pace) OVER (ORDER BY game_date {rows(10)}) AS league10 FROM
  (SELECT game_date, avg(fga - oreb + tov + 0.44 * fta) AS pace FROM contest_log GROUP BY game_date)"""


def official_form(s: Shapes) -> DataFrame:
    joined = officials(s).join(game_means(s), ["game", "game_date"])
    log = entity_log(joined, ["referee"], ["game_date", "game", "slot"])
    return wn.lag_mean(log, ["mean_fta", "mean_poss"], [10, 20]).result.withColumnsRenamed({
        "mean_fta_roll10": "fta10", "mean_fta_roll20": "fta20", "mean_poss_roll10": "poss10",
    })


def league_pace(s: Shapes) -> DataFrame:
    poss = F.col("fga") - F.col("oreb") + F.col("tov") + 0.44 * F.col("fta")
    daily = s.contest_log().groupBy("game_date").agg(F.avg(poss).alias("pace"))
    # One row per day: the whole league is one ordered log.
    log = entity_log(daily.withColumn("league", F.lit(0)), ["league"], ["game_date"])
    return wn.lag_mean(log, ["pace"], [10]).result.select("game_date", F.col("pace_roll10").alias("league10"))


@query(
    "wn_member_rolling",
    "game:l referee:s slot:s fta10:f6 fta20:f6 poss10:f6 league10:f6",
    "SELECT * FROM official_form LEFT JOIN league_pace USING (game_date)",
)
def member_rolling(s: Shapes) -> DataFrame:
    return official_form(s).join(league_pace(s), "game_date", "left")


@query(
    "ag_crew_mean",
    "game:l crew_fta10:f6 crew_fta20:f6 pace_impact:f6",
    """SELECT game, avg(fta10) AS crew_fta10, avg(fta20) AS crew_fta20, avg(poss10) - any_value(league10) AS pace_impact
    FROM official_form LEFT JOIN league_pace USING (game_date) GROUP BY game, game_date""",
)
def crew_mean(s: Shapes) -> DataFrame:
    crews = official_form(s).groupBy("game", "game_date").agg(
        F.avg("fta10").alias("crew_fta10"), F.avg("fta20").alias("crew_fta20"), F.avg("poss10").alias("crew_poss10")
    )
    joined = crews.join(league_pace(s), "game_date", "left")
    return joined.withColumn("pace_impact", F.col("crew_poss10") - F.col("league10"))


@query(
    "ag_weighted_group",
    "season:i team:l top1_net:f6 top3_net:f6 avg_net:f6 net_std:f6 best_off:f6 best_def:f6 n:l",
    """SELECT season, team, max(net) AS top1_net, avg(net) FILTER (WHERE r <= 3) AS top3_net, sum(net * minutes) / sum(minutes) AS avg_net,
    coalesce(stddev_samp(net), 0) AS net_std, max(off_rating) AS best_off, min(def_rating) AS best_def, count(*) AS n
    FROM (SELECT *, off_rating - def_rating AS net, row_number() OVER (PARTITION BY season, team ORDER BY gp DESC, minutes DESC,
      order_key, line, member) AS r FROM lineups WHERE gp >= 5) GROUP BY season, team""",
)
def weighted_group(s: Shapes) -> DataFrame:
    order = [F.col("gp").desc(), F.col("minutes").desc(), F.col("order_key"), F.col("line"), F.col("member")]
    return ag.lineup_summary(s.lineups(), ["season", "team"], order)


_EFFORT = {
    "contested_shots": "dreb", "deflections": "tov", "loose_balls_recovered": "oreb",
    "charges_drawn": "fta", "screen_assists": "fgm", "box_outs": "fga",
}


@query(
    "ag_zscore_index",
    "game:l team:i effort:f6",
    "SELECT *, " + " + ".join(
        f"{ag.EFFORT_WEIGHTS[n]} * ({c} - avg({c}) OVER s) / stddev_samp({c}) OVER s" for n, c in _EFFORT.items()
    ) + " AS effort FROM contest_log WINDOW s AS (PARTITION BY season)",
)
def zscore_index(s: Shapes) -> DataFrame:
    log = s.contest_log().select("game", "team", "season", *[F.col(c).alias(n) for n, c in _EFFORT.items()])
    return ag.zscore_index(log, ["season"], ag.EFFORT_WEIGHTS, "effort")


SHARED_SQL["absence_rows"] = """SELECT e.player, e.team, e.day, e.min_roll5, e.usage, 1 AS was_absent
  FROM expected e ANTI JOIN player_days p ON e.player = p.player AND e.day = p.day
  UNION ALL SELECT player, team, day, min_roll5, usage, 0 FROM player_status WHERE in_rotation"""


def absence_rows(s: Shapes) -> DataFrame:
    from duelframe.plans.reports import absences

    days = player_days(s)
    return absences(player_status(days), days)


@query(
    "ag_absence_rollup",
    "team:l day:d expected_minutes:f8 missing_minutes:f8 missing_usage:f8 n_missing:l star_out:i availability:f8",
    """SELECT team, day, sum(min_roll5) AS expected_minutes, coalesce(sum(min_roll5) FILTER (WHERE was_absent = 1), 0) AS missing_minutes,
    coalesce(sum(usage) FILTER (WHERE was_absent = 1), 0) AS missing_usage, count(*) FILTER (WHERE was_absent = 1) AS n_missing,
    CAST(count(*) FILTER (WHERE was_absent = 1 AND usage >= 0.25) > 0 AS INT) AS star_out,
    1 - coalesce(sum(min_roll5) FILTER (WHERE was_absent = 1), 0) / sum(min_roll5) AS availability
    FROM absence_rows GROUP BY team, day""",
)
def absence_rollup(s: Shapes) -> DataFrame:
    return ag.absence_rollup(absence_rows(s), ["team", "day"])


@query(
    "ag_period_average",
    "season:i avg_pts:f6 avg_reb:f6 avg_ast:f6 pace:f6 all_pts:f6",
    """SELECT p.*, t.pace, avg(avg_pts) OVER () AS all_pts FROM (SELECT season, avg(pts) AS avg_pts, avg(reb) AS avg_reb, avg(ast) AS avg_ast
      FROM player_seasons WHERE minutes >= 5 GROUP BY season) p
    LEFT JOIN (SELECT season, avg(fga) AS pace FROM contest_log GROUP BY season) t USING (season)""",
)
def period_average(s: Shapes) -> DataFrame:
    averages = ag.period_averages(player_seasons(s), "season", ["pts", "reb", "ast"], F.col("minutes") >= 5)
    return averages.join(s.contest_log().groupBy("season").agg(F.avg("fga").alias("pace")), "season", "left")


@query(
    "ag_career_rollup",
    "player:l games:l seasons:l first_season:i last_season:i best_season:i best_pts:f6 career_pts:f6 career_reb:f6 eligible:i",
    """SELECT player, sum(gp) AS games, count(*) AS seasons, min(season) AS first_season, max(season) AS last_season,
    (SELECT season FROM player_seasons q WHERE q.player = p.player ORDER BY pts DESC, season LIMIT 1) AS best_season,
    max(pts) AS best_pts, sum(pts * gp) / sum(gp) AS career_pts, sum(reb * gp) / sum(gp) AS career_reb,
    CAST(count(*) >= 5 OR sum(gp) >= 500 AS INT) AS eligible FROM player_seasons p GROUP BY player""",
)
def career_rollup(s: Shapes) -> DataFrame:
    return ag.career_rollup(player_seasons(s), "player", "season", "gp", ["pts", "reb"], "pts")


SHARED_SQL["covers"] = """SELECT *, CASE WHEN margin_home = spread THEN NULL
  ELSE CAST((margin > spread) = (margin_home > spread) AS INT) END AS bet_won,
  CASE WHEN p_home > 0.5 THEN spread - close_spread ELSE close_spread - spread END AS clv
  FROM (SELECT p.*, c.home_pts - c.away_pts AS margin_home FROM priced p JOIN contest c USING (game))"""


def covers(s: Shapes) -> DataFrame:
    """Bets on the side the margin model prefers; NULL for a push."""
    margins = s.contest().select("game", (F.col("home_pts") - F.col("away_pts")).alias("margin_home"))
    line, actual = F.col("spread"), F.col("margin_home")
    won = F.when(actual != line, ((F.col("margin") > line) == (actual > line)).cast("int"))
    clv = F.when(F.col("p_home") > 0.5, line - F.col("close_spread")).otherwise(F.col("close_spread") - line)
    return priced(s).join(margins, "game").withColumns({"bet_won": won, "clv": clv})


_ROI = """count(bet_won) AS n_bets, count(*) FILTER (WHERE bet_won = 1) AS wins, count(*) FILTER (WHERE bet_won = 0) AS losses,
  avg(bet_won) AS hit_rate, sum(CASE WHEN bet_won = 1 THEN 100.0 / 110.0 WHEN bet_won = 0 THEN -1 END) AS net_units,
  avg(CASE WHEN bet_won = 1 THEN 100.0 / 110.0 WHEN bet_won = 0 THEN -1 END) AS roi"""
_ROI_OUT = "n_bets:l wins:l losses:l hit_rate:f6 net_units:f4 roi:f6"


@query("ag_flat_roi", _ROI_OUT, f"SELECT {_ROI} FROM covers HAVING count(bet_won) >= 500")
def flat_roi(s: Shapes) -> DataFrame:
    return ag.flat_roi(covers(s), "bet_won")


@query(
    "ag_season_breakdown",
    f"season:i {_ROI_OUT} mean_clv:f6 mean_edge:f6",
    f"SELECT season, {_ROI}, avg(clv) AS mean_clv, avg(abs(p_home - 0.5)) AS mean_edge FROM covers GROUP BY season HAVING count(bet_won) >= 1",
)
def season_breakdown(s: Shapes) -> DataFrame:
    extra = {"mean_clv": F.avg("clv"), "mean_edge": F.avg(F.abs(F.col("p_home") - 0.5))}
    return ag.flat_roi(covers(s), "bet_won", ["season"], min_sample=1, extra=extra)


@query(
    "ag_market_roi",
    "model:s n_bets:l wins:l hit_rate:f4 roi_pct:f4",
    f"""SELECT model, count(*) AS n_bets, sum(CAST({RIGHT_SQL} AS INT)) AS wins, avg(CAST({RIGHT_SQL} AS INT)) AS hit_rate,
    100 * avg(CASE WHEN {RIGHT_SQL} THEN 100.0 / 110.0 ELSE -1 END) AS roi_pct FROM predictions GROUP BY model""",
)
def market_roi(s: Shapes) -> DataFrame:
    graded = s.predictions().withColumn("won", right().cast("int"))
    return ag.flat_roi(graded, "won", ["model"], min_sample=1).withColumn("roi_pct", F.col("roi") * 100)


@query(
    "ag_clv_summary",
    "rule:s games:l closed:l mean_clv:f6 positive_rate:f6 has_edge:i",
    """SELECT rule, games, closed, mean_clv, positive_rate, CAST(CASE rule WHEN 'tracker' THEN closed >= 50 AND mean_clv > 0 AND positive_rate > 0.5
      WHEN 'mean' THEN mean_clv > 0 ELSE closed >= 50 AND positive_rate > 0.5 END AS INT) AS has_edge
    FROM (SELECT count(*) AS games, count(clv) AS closed, avg(clv) AS mean_clv, avg(CAST(clv > 0 AS INT)) AS positive_rate FROM covers)
    CROSS JOIN (SELECT unnest(['tracker', 'mean', 'rate']) AS rule)""",
)
def clv_summary(s: Shapes) -> DataFrame:
    from duelframe.operators.sets import union_by_name

    bets = covers(s)
    return union_by_name([ag.clv_summary(bets, "clv", rule).withColumn("rule", F.lit(rule)) for rule in ag.CLV_RULES])


@query(
    "ag_calibration_bins",
    "model:s bin:i bin_low:f4 bin_high:f4 n:l mean_pred:f6 actual_rate:f6 gap:f6",
    """SELECT model, bin, bin / 10.0 AS bin_low, (bin + 1) / 10.0 AS bin_high, count(*) AS n, avg(p_home) AS mean_pred, avg(home_win) AS actual_rate,
    avg(p_home) - avg(home_win) AS gap FROM (SELECT *, floor(p_home * 10) AS bin FROM predictions) GROUP BY model, bin""",
)
def calibration_bins(s: Shapes) -> DataFrame:
    return ag.calibration_bins(s.predictions(), "p_home", "home_win", keys=["model"])


@query(
    "ag_confidence_bins",
    "bucket:s n:l predicted:f6 actual:f6",
    f"""SELECT CASE WHEN c < 0.55 THEN '50-55%' WHEN c < 0.6 THEN '55-60%' WHEN c < 0.65 THEN '60-65%' WHEN c < 0.7 THEN '65-70%'
      WHEN c < 0.75 THEN '70-75%' WHEN c < 0.8 THEN '75-80%' ELSE '80%+' END AS bucket, count(*) AS n, avg(c) AS predicted,
    avg(CAST({RIGHT_SQL} AS INT)) AS actual FROM (SELECT *, greatest(p_home, 1 - p_home) AS c FROM predictions) GROUP BY 1""",
)
def confidence_bins(s: Shapes) -> DataFrame:
    from duelframe.plans.reports import confidence_bins as report

    return report(s.predictions(), "p_home", right())


@query(
    "ag_ece_brier",
    "era:s season:i n:l ece:f6 brier:f6",
    f"""SELECT era, season, sum(n) AS n, sum(abs(p - y)) / sum(n) AS ece, sum(sq) / sum(n) AS brier FROM
    (SELECT CASE {_ERA_CASE} ELSE 'Unknown' END AS era, season, floor(p_home * 10) AS b, count(*) AS n, sum(p_home) AS p, sum(home_win) AS y,
      sum(pow(p_home - home_win, 2)) AS sq FROM predictions GROUP BY ALL) GROUP BY era, season""",
)
def ece_brier(s: Shapes) -> DataFrame:
    labelled = s.predictions().withColumn("era", era_of(F.col("season")))
    return ag.calibration_error(labelled, "p_home", "home_win", ["era", "season"])


@query(
    "ag_season_summary",
    "team:i season:i games:l wins:l losses:l win_pct:f3 mean_pts:f4",
    """SELECT team, season, count(*) AS games, sum(win) AS wins, sum(1 - win) AS losses, CAST(avg(win) AS DECIMAL(5, 3)) AS win_pct,
    avg(pts) AS mean_pts FROM contest_log GROUP BY team, season""",
)
def season_summary(s: Shapes) -> DataFrame:
    return s.contest_log().groupBy("team", "season").agg(
        F.count(F.lit(1)).alias("games"),
        F.sum("win").alias("wins"),
        F.sum(1 - F.col("win")).alias("losses"),
        F.avg("win").cast("decimal(5,3)").alias("win_pct"),
        F.avg("pts").alias("mean_pts"),
    )


@query(
    "ag_model_accuracy",
    "model:s game_date:d predictions:l graded:l correct:l accuracy:f6",
    f"""SELECT model, game_date, count(*) AS predictions, count(*) FILTER (WHERE game % 10 <> 0) AS graded,
    count(*) FILTER (WHERE game % 10 <> 0 AND {RIGHT_SQL}) AS correct,
    count(*) FILTER (WHERE game % 10 <> 0 AND {RIGHT_SQL}) / nullif(count(*) FILTER (WHERE game % 10 <> 0), 0) AS accuracy
    FROM predictions GROUP BY model, game_date""",
)
def model_accuracy(s: Shapes) -> DataFrame:
    # Games that are not over yet have no outcome.
    stored = s.predictions().withColumn("home_win", F.when(F.col("game") % 10 != 0, F.col("home_win")))
    return stored.groupBy("model", "game_date").agg(
        F.count(F.lit(1)).alias("predictions"), F.count("home_win").alias("graded"), F.count_if(right()).alias("correct")
    ).withColumn("accuracy", F.try_divide("correct", "graded"))


@query(
    "ag_recent_view",
    "id:l game_date:d p_home:f6 opening:f2 closing:f2",
    """SELECT p.id, p.game_date, p.p_home, o.spread AS opening, o.close_spread AS closing FROM predictions p
    LEFT JOIN odds o USING (game_date, home, away) WHERE p.game_date >= DATE '2001-08-01' - 30""",
)
def recent_view(s: Shapes) -> DataFrame:
    recent = s.predictions().filter(F.col("game_date") >= F.date_sub(F.lit("2001-08-01").cast("date"), 30))
    quotes = s.odds().withColumnsRenamed({"spread": "opening", "close_spread": "closing"})
    return recent.join(quotes, ["game_date", "home", "away"], "left")


_WF = """WITH tested AS (SELECT season FROM (SELECT season, row_number() OVER (ORDER BY season) AS n FROM (SELECT DISTINCT season FROM priced)) WHERE n > 3),
  bets AS (SELECT *, abs(p_home - market_home) AS e, CAST((p_home > market_home) = (home_win = 1) AS INT) AS won FROM priced
    WHERE season IN (SELECT season FROM tested) AND abs(p_home - market_home) >= 0.03),
  staked AS (SELECT *, CASE WHEN won = 1 THEN stake * 0.9545 ELSE -stake END AS pnl FROM (SELECT *, {stake} AS stake FROM bets)),
  cum AS (SELECT *, sum(pnl) OVER (PARTITION BY season ORDER BY game_date, id) AS c FROM staked),
  dd AS (SELECT *, c - max(c) OVER (PARTITION BY season ORDER BY game_date, id) AS d FROM cum)
  SELECT season, count(*) AS n_bets, sum(stake) AS total_wagered, sum(pnl) AS profit, sum(pnl) / sum(stake) AS roi, avg(won) AS win_rate,
    avg(e) AS avg_edge, min(d) AS max_drawdown FROM dd GROUP BY season"""
_WF_OUT = "season:i n_bets:l total_wagered:f4 profit:f4 roi:f6 win_rate:f6 avg_edge:f6 max_drawdown:f4"


@query("ag_walk_forward_roi", _WF_OUT, _WF.format(stake="1.0"))
def walk_forward_roi(s: Shapes) -> DataFrame:
    return ag.walk_forward(with_market(s), "season", ["game_date", "id"], "p_home", "market_home", "home_win")


@query(
    "ag_walk_forward_kelly",
    _WF_OUT,
    _WF.format(stake="0.25 * greatest((0.9545 * greatest_p - (1 - greatest_p)) / 0.9545, 0)").replace(
        "SELECT *, abs(p_home - market_home) AS e,",
        "SELECT *, CASE WHEN p_home > market_home THEN p_home ELSE 1 - p_home END AS greatest_p, abs(p_home - market_home) AS e,",
    ),
)
def walk_forward_kelly(s: Shapes) -> DataFrame:
    return ag.walk_forward(
        with_market(s), "season", ["game_date", "id"], "p_home", "market_home", "home_win", kelly_fraction=0.25
    )


@query(
    "ag_walk_forward_total",
    "n_bets:l total_wagered:f4 profit:f4 roi:f6 win_rate:f6",
    f"""SELECT sum(n_bets) AS n_bets, sum(total_wagered) AS total_wagered, sum(profit) AS profit, sum(profit) / sum(total_wagered) AS roi,
    sum(win_rate * n_bets) / sum(n_bets) AS win_rate FROM ({_WF.format(stake="1.0")})""",
)
def walk_forward_total(s: Shapes) -> DataFrame:
    return ag.walk_forward_total(walk_forward_roi(s))


@query(
    "ag_conformal_quantile",
    "season:i n:l quantile:f6",
    """SELECT season, any_value(n) AS n, quantile_cont(r, 1.0) FILTER (WHERE false) AS ignored,
      min(r) FILTER (WHERE k - 1 >= floor(pos)) + (min(r) FILTER (WHERE k - 1 >= ceil(pos)) - min(r) FILTER (WHERE k - 1 >= floor(pos)))
        * (any_value(pos) - floor(any_value(pos))) AS quantile
    FROM (SELECT *, least(ceil((n + 1) * 0.9) / n, 1.0) * (n - 1) AS pos FROM
      (SELECT season, abs(margin - (home_win * 8 - 4)) AS r, count(*) OVER (PARTITION BY season) AS n,
        row_number() OVER (PARTITION BY season ORDER BY abs(margin - (home_win * 8 - 4))) AS k FROM predictions))
    GROUP BY season""",
)
def conformal_quantile(s: Shapes) -> DataFrame:
    residual = F.col("margin") - (F.col("home_win") * 8 - 4)
    return ag.conformal_quantile(s.predictions(), residual, 0.9, ["season"])


_CDF = phi_sql("((wins - 0.5 - n * 0.5) / sqrt(n * 0.25))")


@query(
    "ag_binomial_test",
    "model:s n:l wins:l accuracy:f6 ci_lower:f6 ci_upper:f6 p_value:f6 significant:i",
    f"""SELECT *, CAST(p_value < 0.05 AS INT) AS significant FROM (SELECT *, wins / n AS accuracy, (wins / n + z * z / (2 * n) - z * sqrt((wins / n * (1 - wins / n) + z * z / (4 * n)) / n)) / (1 + z * z / n) AS ci_lower,
    (wins / n + z * z / (2 * n) + z * sqrt((wins / n * (1 - wins / n) + z * z / (4 * n)) / n)) / (1 + z * z / n) AS ci_upper, 
    (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5))) FROM range(CAST(wins AS BIGINT), CAST(n AS BIGINT) + 1) t(k)) AS p_value
    FROM (SELECT model, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST({RIGHT_SQL} AS INT)) AS DOUBLE) AS wins, 1.959963984540054 AS z FROM predictions GROUP BY model))""",
)
def binomial_test(s: Shapes) -> DataFrame:
    return ag.accuracy_test(s.predictions(), right(), ["model"])


_TAIL = phi_sql("sqrt(statistic)")


@query(
    "ag_mcnemar",
    "accuracy_a:f6 accuracy_b:f6 only_a:l only_b:l statistic:f6 p_value:f6",
    f"""SELECT *, 2 * (1 - {_TAIL}) AS p_value FROM (SELECT *, pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b) AS statistic FROM
    (SELECT avg(CAST(a AS INT)) AS accuracy_a, avg(CAST(b AS INT)) AS accuracy_b, count(*) FILTER (WHERE a AND NOT b) AS only_a,
      count(*) FILTER (WHERE b AND NOT a) AS only_b FROM (SELECT {RIGHT_SQL} AS a, (margin > 0) = (home_win = 1) AS b FROM predictions)))""",
)
def mcnemar(s: Shapes) -> DataFrame:
    return ag.paired_models_test(s.predictions(), right(), (F.col("margin") > 0) == (F.col("home_win") == 1))


@query("ag_bootstrap_interval", "mean_roi:f6 ci_lower:f6 ci_upper:f6 p_value:f6 n_bets:l replicates:l significant:i")
def bootstrap_interval(s: Shapes) -> DataFrame:
    bets = covers(s).filter("bet_won IS NOT NULL")
    return ag.bootstrap_roi(bets.withColumn("profit", F.when(F.col("bet_won") == 1, ag.WIN_PAYOUT).otherwise(-1.0)), "profit")


@query(
    "ag_bootstrap_ci",
    "mean_roi:f6 n_bets:l replicates:l brackets:i",
    f"""SELECT sum(CASE WHEN bet_won = 1 THEN {ag.WIN_PAYOUT!r}::DOUBLE ELSE -1 END) / sum(CASE WHEN bet_won = 1 THEN {ag.WIN_PAYOUT!r}::DOUBLE ELSE 1 END) AS mean_roi,
    count(*) AS n_bets, 10000 AS replicates, 1 AS brackets FROM covers WHERE bet_won IS NOT NULL""",
)
def bootstrap_ci(s: Shapes) -> DataFrame:
    # The drawn interval itself cannot be matched; that it brackets the mean can.
    return bootstrap_interval(s).withColumn("brackets", F.col("mean_roi").between(F.col("ci_lower"), F.col("ci_upper")).cast("int"))


@query(
    "ag_weight_grid",
    "scale:f2 weight:f2 brier:f9",
    """SELECT scale, k / 20.0 AS weight, avg(pow(k / 20.0 * p_home + (1 - k / 20.0) / (1 + exp(-margin / scale)) - home_win, 2)) AS brier
    FROM predictions CROSS JOIN (SELECT unnest([5.0, 10.0, 15.0, 20.0, 25.0, 30.0]) AS scale) CROSS JOIN range(0, 21) t(k) GROUP BY scale, k""",
)
def weight_grid(s: Shapes) -> DataFrame:
    return ag.weight_grid(s.predictions(), "p_home", "margin", "home_win")


@query(
    "ag_threshold_search",
    "threshold:f2 accuracy:f6 best:i",
    """SELECT *, CAST(row_number() OVER (ORDER BY accuracy DESC, threshold) = 1 AS INT) AS best FROM
    (SELECT t / 100.0 AS threshold, avg(CAST((p_home >= t / 100.0) = (home_win = 1) AS INT)) AS accuracy FROM predictions CROSS JOIN range(35, 67) r(t) GROUP BY t)""",
)
def threshold_search(s: Shapes) -> DataFrame:
    return ag.best_threshold(ag.threshold_accuracy(s.predictions(), "p_home", "home_win"))


@query(
    "ag_mean_threshold_filter",
    "segment:s n:l mae:f6",
    """SELECT CASE WHEN abs(margin) < 3 THEN 'close' WHEN abs(margin) < 7 THEN 'medium' ELSE 'clear' END AS segment, count(*) AS n,
    avg(abs(margin - margin_home)) AS mae FROM covers GROUP BY 1""",
)
def mean_threshold_filter(s: Shapes) -> DataFrame:
    return ag.segmented_error(covers(s), "margin", "margin_home")


_NEWEST = "OVER (PARTITION BY team ORDER BY game_date DESC, game DESC)"


@query(
    "tk_last_n_agg",
    "team:i wins7:l losses7:l wins10:l pts10:f6",
    f"""SELECT team, sum(win) FILTER (WHERE n <= 7) AS wins7, sum(1 - win) FILTER (WHERE n <= 7) AS losses7, sum(win) AS wins10, avg(pts) AS pts10
    FROM (SELECT *, row_number() {_NEWEST} AS n FROM contest_log) WHERE n <= 10 GROUP BY team""",
)
def last_n_agg(s: Shapes) -> DataFrame:
    log, order = s.contest_log(), ["game_date", "game"]
    ten = topk.last_n(log, ["team"], order, 10, [F.sum("win").alias("wins10"), F.avg("pts").alias("pts10")])
    seven = topk.last_n(log, ["team"], order, 7, [F.sum("win").alias("wins7"), F.sum(1 - F.col("win")).alias("losses7")])
    return ten.join(seven, "team")


@query(
    "tk_latest_row",
    f"{KEY} pts:i matchup:s",
    f"SELECT * FROM (SELECT *, row_number() {_NEWEST} AS n FROM contest_log) WHERE n = 1",
)
def latest_row(s: Shapes) -> DataFrame:
    return topk.latest_row(s.contest_log(), ["team"], ["game_date", "game"])


@query(
    "tk_latest_nonnull",
    "player:l minutes:f4 pts:i",
    """SELECT player, arg_max(minutes, [epoch(game_date), game]) FILTER (WHERE minutes IS NOT NULL) AS minutes,
    arg_max(pts, [epoch(game_date), game]) AS pts FROM player_log GROUP BY player""",
)
def latest_nonnull(s: Shapes) -> DataFrame:
    return topk.latest_nonnull(s.player_log(), ["player"], ["game_date", "game"], ["minutes", "pts"])


@query(
    "tk_latest_array",
    "player:l last5:s",
    """SELECT player, string_agg(concat(CAST(game AS VARCHAR), ':', CAST(pts AS VARCHAR)), ',' ORDER BY n) AS last5 FROM
    (SELECT *, row_number() OVER (PARTITION BY player ORDER BY game_date DESC, game DESC) AS n FROM player_log) WHERE n <= 5 GROUP BY player""",
)
def latest_array(s: Shapes) -> DataFrame:
    arrays = topk.latest_array(s.player_log(), ["player"], ["game_date", "game"], ["game", "pts"], 5)
    text = F.transform("latest", lambda x: F.concat_ws(":", x["game"].cast("string"), x["pts"].cast("string")))
    return arrays.select("player", F.array_join(text, ",").alias("last5"))


@query(
    "tk_dedupe_by_weight",
    "season:i team:l member:l gp:i minutes:f4",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, team, member ORDER BY gp DESC, minutes DESC, order_key, line) AS n FROM lineups)
    WHERE n = 1 AND gp >= 10""",
)
def dedupe_by_weight(s: Shapes) -> DataFrame:
    ties = [F.col("minutes").desc(), "order_key", "line"]
    return topk.heaviest(s.lineups(), ["season", "team", "member"], "gp", ties, minimum=10)


SHARED_SQL["meetings"] = """SELECT *, row_number() OVER (PARTITION BY side_a, side_b ORDER BY game_date DESC, game DESC) AS n FROM
  (SELECT game, game_date, least(home, away) AS side_a, greatest(home, away) AS side_b,
    CASE WHEN home < away THEN home_pts ELSE away_pts END AS pts_a, CASE WHEN home < away THEN away_pts ELSE home_pts END AS pts_b,
    CAST((home_pts >= away_pts) = (home < away) AS INT) AS a_won FROM contest)"""


@query(
    "tk_pair_history",
    "side_a:i side_b:i meetings:l wins_a:l wins_b:l mean_total:f6 history:s",
    """SELECT side_a, side_b, count(*) AS meetings, sum(a_won) AS wins_a, count(*) - sum(a_won) AS wins_b, avg(pts_a + pts_b) AS mean_total,
    string_agg(concat(CAST(game AS VARCHAR), ':', CAST(pts_a AS VARCHAR), '-', CAST(pts_b AS VARCHAR)), ',' ORDER BY n) AS history
    FROM meetings WHERE n <= 10 GROUP BY side_a, side_b""",
)
def pair_history(s: Shapes) -> DataFrame:
    pairs = topk.pair_history(s.contest(), "home", "away", ["game_date", "game"], "home_pts", "away_pts")
    line = F.transform("history", lambda h: F.concat(
        h["game"].cast("string"), F.lit(":"), h["pts_a"].cast("string"), F.lit("-"), h["pts_b"].cast("string")
    ))
    return pairs.withColumn("history", F.array_join(line, ","))


_GAP = """SELECT player, games, overall, recent, recent - overall AS gap FROM
  (SELECT player, count(pts) AS games, avg(pts) AS overall, avg(pts) FILTER (WHERE n <= 5) AS recent FROM
    (SELECT *, row_number() OVER (PARTITION BY player ORDER BY game_date DESC, game DESC) AS n FROM player_log) GROUP BY player) WHERE games >= 10"""


@query(
    "tk_hot_cold",
    "kind:s player:l games:l overall:f6 recent:f6 gap:f6",
    f"""(SELECT 'hot' AS kind, * FROM ({_GAP}) WHERE gap >= 5 ORDER BY gap DESC, player LIMIT 4)
    UNION ALL (SELECT 'cold', * FROM ({_GAP}) WHERE gap <= -5 ORDER BY gap, player LIMIT 4)""",
)
def hot_cold(s: Shapes) -> DataFrame:
    log, order = s.player_log(), ["game_date", "game"]
    hot = topk.hot(log, ["player"], order, "pts").withColumn("kind", F.lit("hot"))
    cold = topk.cold(log, ["player"], order, "pts", at_least=5.0).withColumn("kind", F.lit("cold"))
    return hot.unionByName(cold)


@query(
    "tk_group_topn",
    "team:i player:l mean:f6 rank:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY mean DESC NULLS LAST, player) AS rank FROM
    (SELECT team, player, avg(minutes) AS mean FROM player_log GROUP BY team, player)) WHERE rank <= 5""",
)
def group_topn(s: Shapes) -> DataFrame:
    return topk.top_by_mean(s.player_log(), ["team"], "player", "minutes")


_MEASURE = """SELECT '{m}' AS measure, player, {m} AS value, game, row_number() OVER (ORDER BY {m} DESC, player, game) AS rank
  FROM (SELECT player, {m}, min(game) AS game FROM player_log GROUP BY player, {m})"""


@query(
    "tk_records",
    "measure:s rank:i player:l value:i game:l",
    " UNION ALL ".join(f"SELECT * FROM ({_MEASURE.format(m=m)}) WHERE rank <= 15" for m in ("pts", "reb", "ast")),
)
def records(s: Shapes) -> DataFrame:
    return topk.records(s.player_log(), "player", ["pts", "reb", "ast"], ["game"])


SHARED_SQL["value_list"] = """SELECT *, abs(edge) * (0.5 + ats) AS score FROM (SELECT id, game, game_date, p_home - market_home AS edge,
  abs(margin - spread) / 20 AS ats FROM priced) WHERE abs(edge) >= 0.05 AND ats >= 0.25"""


@query(
    "tk_sorted_value_list",
    "id:l edge:f6 score:f6",
    "SELECT * FROM value_list ORDER BY score DESC, id",
)
def sorted_value_list(s: Shapes) -> DataFrame:
    edge = F.col("p_home") - F.col("market_home")
    support = F.abs(F.col("margin") - F.col("spread")) / 20
    bets = with_market(s).withColumns({"edge": edge, "ats": support}).filter((F.abs("edge") >= 0.05) & (F.col("ats") >= 0.25))
    return bets.withColumn("score", F.abs("edge") * (0.5 + F.col("ats"))).orderBy(F.col("score").desc(), "id")


@query(
    "tk_recent_dates",
    "player:l day:d minutes:f4",
    "SELECT player, day, minutes FROM player_days WHERE day IN (SELECT DISTINCT day FROM player_days ORDER BY day DESC LIMIT 3)",
)
def recent_dates(s: Shapes) -> DataFrame:
    return topk.latest_dates(player_days(s), "day")


@query(
    "tk_date_fallback",
    "asked:s game:l game_date:d",
    """SELECT 'present' AS asked, game, game_date FROM contest WHERE game_date = DATE '1999-03-03'
    UNION ALL SELECT 'absent', game, game_date FROM contest WHERE game_date = (SELECT max(game_date) FROM contest)""",
)
def date_fallback(s: Shapes) -> DataFrame:
    games = s.contest().select("game", "game_date")
    day = lambda d: F.lit(d).cast("date")
    present = topk.on_date_or_latest(games, "game_date", day("1999-03-03")).withColumn("asked", F.lit("present"))
    absent = topk.on_date_or_latest(games, "game_date", day("2050-01-01")).withColumn("asked", F.lit("absent"))
    return present.unionByName(absent)


@query(
    "ag_conformal_sketch",
    "first:i last:i n:l near:i",
    """SELECT lo AS first, season AS last, CAST(sum(n) OVER (ORDER BY season) AS BIGINT) AS n, 1 AS near
    FROM (SELECT season, count(*) AS n, min(min(season)) OVER () AS lo FROM predictions GROUP BY season)""",
)
def conformal_sketch(s: Shapes) -> DataFrame:
    """Half-widths of every run of seasons from the first, from stored sketches; ``near``: the share of residuals within is as asked, up to twice the stated rank error."""
    residual = F.abs(F.col("margin") - (F.col("home_win") * 8 - 4))
    rows = s.predictions().select("season", residual.cast("double").alias("residual"))
    stored = materialise(sk.sketch(rows, F.col("residual"), ["season"]), "sketches")
    spans = materialise(sk.conformal(sk.ranges(stored, "season")), "sketch-ranges")
    begin = spans.agg(F.min("first")).first()[0]
    spans = spans.where(F.col("first") == begin)
    seasons = F.array(*[F.lit(r[0]) for r in stored.select("season").distinct().collect()])
    member = F.explode(F.filter(seasons, lambda p: (p >= F.col("first")) & (p <= F.col("last")))).alias("season")
    # a row per season and run of seasons
    members = F.broadcast(spans.select("first", "last", "n", "quantile", member))
    level = F.least(F.ceil((F.col("n") + 1) * 0.9) / F.col("n"), F.lit(1.0))
    share = rows.join(members, "season").groupBy("first", "last", "n").agg(F.avg((F.col("residual") <= F.col("quantile")).cast("int")).alias("within"))
    off = F.abs(F.col("within") - level)
    return share.withColumn("near", (off <= 2 * sk.rank_error() + 2 / F.col("n")).cast("int"))
