"""Report queries with their checking SQL. Nested documents are flattened for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions import measures
from duelframe.operators import aggregates as ag, topk, windows as wn
from duelframe.operators.ordered import entity_log
from duelframe.plans import reports as rp
from duelframe.plans.queries_aggregates import RIGHT_SQL, absence_rows, covers, right
from duelframe.plans.queries_joins import player_days
from duelframe.plans.queries_scalars import AGREE_SQL, TIER_SQL, both_boxes, player_seasons
from duelframe.plans.queries_windows import PRIOR, SEASON_W, W, rows
from duelframe.plans.registry import SHARED_SQL, query
from duelframe.plans.shapes import Shapes

_LAST = "OVER (PARTITION BY team, season ORDER BY game_date DESC, game DESC)"
SHARED_SQL["records"] = f"""SELECT l.team, l.season, sum(win) AS wins, sum(1 - win) AS losses, avg(win) AS pct,
  coalesce(sum(win) FILTER (WHERE is_home = 1), 0) AS home_wins, coalesce(sum(1 - win) FILTER (WHERE is_home = 1), 0) AS home_losses,
  coalesce(sum(win) FILTER (WHERE is_home = 0), 0) AS away_wins, coalesce(sum(1 - win) FILTER (WHERE is_home = 0), 0) AS away_losses,
  avg(win) FILTER (WHERE is_home = 1) AS home_pct, avg(win) FILTER (WHERE is_home = 0) AS away_pct,
  sum(win) FILTER (WHERE r <= 10) AS wins10, sum(1 - win) FILTER (WHERE r <= 10) AS losses10, avg(pts) FILTER (WHERE r <= 10) AS scored10,
  avg(opp_pts) FILTER (WHERE r <= 10) AS allowed10, any_value(streak) AS streak
  FROM (SELECT *, row_number() {_LAST} AS r FROM contest_log) l JOIN streaks_all s ON l.team = s.team AND l.season = s.season GROUP BY l.team, l.season"""


def conferences(s: Shapes) -> DataFrame:
    return s.nation.select(F.col("n_nationkey").alias("team"), F.col("n_regionkey").alias("conference"))


SHARED_SQL["placed"] = """SELECT *, ((first_value(wins) OVER p - wins) + (losses - first_value(losses) OVER p)) / 2.0 AS games_behind, wins + remaining AS best,
  row_number() OVER p AS position, count(*) OVER (PARTITION BY season, conference) AS size FROM
  (SELECT r.*, n_regionkey AS conference, 200 * round(wins + losses, -2) + 200 - wins - losses AS remaining FROM records r JOIN nation ON team = n_nationkey)
  WINDOW p AS (PARTITION BY season, conference ORDER BY wins DESC, losses, team)"""
SHARED_SQL["clinched"] = """SELECT *, CASE WHEN position = 1 AND wins > chasers THEN 'z' WHEN position <= 2 AND wins > next2 THEN 'x' WHEN position <= 4 AND wins > next4 THEN 'pi'
    WHEN position > 4 AND best < last4 THEN 'e' WHEN position > 2 AND position <= 4 AND best < last2 THEN 'o' END AS clinch
  FROM (SELECT *, max(best) OVER (PARTITION BY season, conference ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS chasers,
    max(CASE WHEN position = 3 THEN best END) OVER g AS next2, max(CASE WHEN position = 5 THEN best END) OVER g AS next4,
    max(CASE WHEN position = 2 THEN wins END) OVER g AS last2, max(CASE WHEN position = 4 THEN wins END) OVER g AS last4
    FROM (SELECT * REPLACE (left_games AS remaining, wins + left_games AS best) FROM (SELECT *, max(wins + losses) OVER (PARTITION BY season) + 5 - wins - losses AS left_games FROM placed))
    WINDOW g AS (PARTITION BY season, conference))"""


def season_games():
    """Games of a full season: five more than any team has played so far."""
    from pyspark.sql import Window

    return F.max(F.col("wins") + F.col("losses")).over(Window.partitionBy("season")) + 5


def standings(s: Shapes) -> DataFrame:
    # Five teams per conference here: two direct seats and four with the play-in.
    return rp.standings(s.contest_log(), conferences(s), season_games(), direct=2, play_in=4)


@query(
    "wn_games_behind",
    "season:i conference:i team:i position:l games_behind:f2 remaining:l clinch:s",
    "SELECT * FROM clinched",
)
def games_behind(s: Shapes) -> DataFrame:
    record = s.contest_log().groupBy("season", "team").agg(F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"))
    return wn.games_behind(
        record.join(conferences(s), "team"), ["season", "conference"], "team", "wins", "losses", season_games(), 2, 4
    )


@query(
    "rp_standings",
    "season:i conference:i team:i position:l wins:l losses:l pct:f6 home_record:s away_record:s last10:s streak_text:s games_behind:f2 clinch:s",
    """SELECT *, concat(home_wins, '-', home_losses) AS home_record, concat(away_wins, '-', away_losses) AS away_record, concat(wins10, '-', losses10) AS last10,
    CASE WHEN streak > 0 THEN concat('+', streak) ELSE CAST(streak AS VARCHAR) END AS streak_text FROM clinched""",
)
def rp_standings(s: Shapes) -> DataFrame:
    return standings(s)


@query(
    "rp_season_history",
    "season:i label:s games:l first:d last:d table:s",
    """SELECT season, concat(season // 100, '-', lpad(CAST(season % 100 AS VARCHAR), 2, '0')) AS label, g.games, g.first, g.last, t.table_text AS "table" FROM
    (SELECT season, count(*) AS games, min(game_date) AS first, max(game_date) AS last FROM contest GROUP BY season) g
    JOIN (SELECT season, string_agg(concat(team, ':', wins, '-', losses, ':', pts), ',' ORDER BY wins DESC, team) AS table_text FROM
      (SELECT season, team, sum(win) AS wins, sum(1 - win) AS losses, sum(pts) AS pts FROM contest_log GROUP BY season, team) GROUP BY season) t USING (season)""",
)
def rp_season_history(s: Shapes) -> DataFrame:
    line = F.transform("standings", lambda t: F.concat_ws(
        ":", t["team"].cast("string"), F.concat_ws("-", t["wins"].cast("string"), t["losses"].cast("string")), t["pts"].cast("string")))
    return rp.season_history(s.contest(), s.contest_log()).withColumn("table", F.array_join(line, ","))


@query(
    "rp_playoff_heuristic",
    "season:i conference:i team:i position:l gap:f2 playoff_pct:f4 title_pct:f4",
    """SELECT *, CASE WHEN position <= 6 THEN 100 WHEN position <= 8 THEN CASE WHEN gap > 10 THEN 15 WHEN gap > 5 THEN 50 ELSE 75 END
      WHEN position <= 10 THEN greatest(0, 50 - gap * 8) ELSE 0 END AS playoff_pct, share * least(1, 25 / max(share) OVER (PARTITION BY season)) AS title_pct
    FROM (SELECT *, score / sum(score) OVER (PARTITION BY season) * 100 AS share FROM
      (SELECT *, 1 / (1 + greatest(0, ((first_value(wins) OVER o - wins) + (losses - first_value(losses) OVER o)) / 2.0)) AS score,
        ((first_value(wins) OVER c - wins) + (losses - first_value(losses) OVER c)) / 2.0 AS gap, row_number() OVER c AS position FROM
        (SELECT season, team % 2 AS conference, team, wins, losses, pct FROM records)
       WINDOW c AS (PARTITION BY season, conference ORDER BY pct DESC, wins DESC, losses, team), o AS (PARTITION BY season ORDER BY pct DESC, wins DESC, team)))""",
)
def rp_playoff_heuristic(s: Shapes) -> DataFrame:
    # Two conferences of twelve and thirteen teams, so that every rule applies.
    record = s.contest_log().groupBy("season", "team").agg(F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"))
    return rp.playoff_chances(record.withColumn("conference", F.col("team") % 2))


def schedule(s: Shapes) -> DataFrame:
    star = lambda n: (F.col("game") % n == 0).cast("int")
    return s.contest().select(
        "game", "game_date", "season", "home", "away", star(11).alias("home_star_out"), star(17).alias("away_star_out"))


def context(s: Shapes) -> DataFrame:
    return rp.game_context(schedule(s), s.contest_log())


_TEAM_DAY = "PARTITION BY team, season ORDER BY game_date, game"
SHARED_SQL["venue_runs"] = """SELECT *, CASE WHEN win = 1 THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY team, season, is_home, win, island ORDER BY game_date, game) AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY team, season, is_home ORDER BY game_date, game)
    - row_number() OVER (PARTITION BY team, season, is_home, win ORDER BY game_date, game) AS island FROM contest_log)"""
SHARED_SQL["after_game"] = f"""SELECT team, season, game_date, game, sum(win) OVER w10 AS wins10, count(*) OVER w10 AS games10, sum(win) OVER w7 AS wins7, count(*) OVER w7 AS games7,
  last_value(CASE WHEN is_home = 1 THEN run END IGNORE NULLS) OVER u AS home_run, last_value(CASE WHEN is_home = 0 THEN run END IGNORE NULLS) OVER u AS away_run,
  coalesce(sum(win) FILTER (WHERE is_home = 1) OVER u, 0) AS home_wins, count(*) FILTER (WHERE is_home = 1) OVER u AS home_games,
  coalesce(sum(win) FILTER (WHERE is_home = 0) OVER u, 0) AS away_wins, count(*) FILTER (WHERE is_home = 0) OVER u AS away_games
  FROM venue_runs WINDOW w10 AS ({_TEAM_DAY} ROWS 9 PRECEDING), w7 AS ({_TEAM_DAY} ROWS 6 PRECEDING), u AS ({_TEAM_DAY} ROWS UNBOUNDED PRECEDING)"""
SHARED_SQL["day_state"] = """SELECT team, season, game_date, lag(s) OVER (PARTITION BY team, season ORDER BY game_date) AS s FROM
  (SELECT team, season, game_date, arg_max(a, a.game) AS s FROM after_game a GROUP BY team, season, game_date)"""
SHARED_SQL["day_rest"] = """SELECT team, game_date, date_diff('day', lag(game_date) OVER (PARTITION BY team ORDER BY game_date), game_date) AS rest
  FROM (SELECT DISTINCT team, game_date FROM contest_log)"""


def _rec(won: str, games: str) -> str:
    return f"concat(coalesce({won}, 0), '-', coalesce({games} - {won}, 0))"


SHARED_SQL["situations"] = f"""SELECT *, concat_ws(',', CASE WHEN home_rest = 1 THEN 'HOME_B2B' END, CASE WHEN away_rest = 1 THEN 'AWAY_B2B' END,
    CASE WHEN home_rest - away_rest >= 2 THEN 'REST_ADV_HOME' WHEN home_rest - away_rest <= -2 THEN 'REST_ADV_AWAY'
      WHEN away_rest IS NULL AND home_rest >= 3 THEN 'REST_ADV_HOME' WHEN home_rest IS NULL AND away_rest >= 3 THEN 'REST_ADV_AWAY' END,
    CASE WHEN hw7 >= 5 THEN 'HOME_HOT' WHEN hw7 <= 2 THEN 'HOME_COLD' END, CASE WHEN aw7 >= 5 THEN 'AWAY_HOT' WHEN aw7 <= 2 THEN 'AWAY_COLD' END,
    CASE WHEN game % 11 = 0 THEN 'INJ_IMPACT_HOME' END, CASE WHEN game % 17 = 0 THEN 'INJ_IMPACT_AWAY' END) AS flags,
    concat(concat_ws('. ', CASE WHEN home_rest = 1 THEN concat('T', home, ' on back-to-back') WHEN home_rest IS NOT NULL THEN concat('T', home, ' rested (', home_rest, 'd)') END,
      CASE WHEN away_rest = 1 THEN concat('T', away, ' on back-to-back') WHEN away_rest IS NOT NULL THEN concat('T', away, ' rested (', away_rest, 'd)') END,
      CASE WHEN hg10 > 0 THEN concat('T', home, ' ', home_last10, ' in last ', hg10) END, CASE WHEN ag10 > 0 THEN concat('T', away, ' ', away_last10, ' in last ', ag10) END,
      CASE WHEN game % 11 = 0 THEN concat('key T', home, ' player(s) out') END, CASE WHEN game % 17 = 0 THEN concat('key T', away, ' player(s) out') END), '.') AS text
  FROM (SELECT c.game, c.game_date, c.season, c.home, c.away, hr.rest AS home_rest, ar.rest AS away_rest, coalesce(h.s.home_run, 0) AS home_streak, coalesce(a.s.away_run, 0) AS away_streak,
    {_rec("h.s.wins10", "h.s.games10")} AS home_last10, {_rec("a.s.wins10", "a.s.games10")} AS away_last10, {_rec("h.s.wins7", "h.s.games7")} AS home_last7,
    {_rec("a.s.wins7", "a.s.games7")} AS away_last7, {_rec("h.s.home_wins", "h.s.home_games")} AS home_home_record, {_rec("a.s.away_wins", "a.s.away_games")} AS away_away_record,
    coalesce(h.s.wins7, 0) AS hw7, coalesce(a.s.wins7, 0) AS aw7, h.s.games10 AS hg10, a.s.games10 AS ag10
   FROM contest c LEFT JOIN day_state h ON c.home = h.team AND c.season = h.season AND c.game_date = h.game_date
   LEFT JOIN day_state a ON c.away = a.team AND c.season = a.season AND c.game_date = a.game_date
   LEFT JOIN day_rest hr ON c.home = hr.team AND c.game_date = hr.game_date LEFT JOIN day_rest ar ON c.away = ar.team AND c.game_date = ar.game_date)"""


@query(
    "rp_game_context",
    "game:l home_rest:i away_rest:i home_streak:l away_streak:l home_last10:s away_last10:s home_last7:s away_last7:s home_home_record:s away_away_record:s flag_text:s summary:s",
    "SELECT *, flags AS flag_text, CASE WHEN text = '.' THEN 'No notable situational factors.' ELSE text END AS summary FROM situations",
)
def rp_game_context(s: Shapes) -> DataFrame:
    return context(s).withColumn("flag_text", F.array_join("flags", ","))


@query(
    "rp_injury_report",
    "team:l high:l players:s",
    """SELECT team, count(*) FILTER (WHERE average >= 15) AS high, string_agg(concat(player, ':', CASE WHEN average >= 15 THEN 'high' WHEN average >= 8 THEN 'medium' ELSE 'low' END),
      ',' ORDER BY average DESC, player) AS players
    FROM (SELECT DISTINCT a.team, a.player, v.average FROM absence_rows a JOIN (SELECT player, floor(avg(minutes)) AS average FROM player_days GROUP BY player) v ON a.player = v.player
      WHERE was_absent = 1 AND day IN (SELECT DISTINCT day FROM absence_rows WHERE was_absent = 1 ORDER BY day DESC LIMIT 3)) GROUP BY team""",
)
def rp_injury_report(s: Shapes) -> DataFrame:
    averages = player_days(s).groupBy("player").agg(F.floor(F.avg("minutes")).alias("average"))
    absent = absence_rows(s).filter("was_absent = 1")
    report = rp.injury_report(absent, averages, "player", "team", "day")
    line = F.transform("players", lambda p: F.concat_ws(":", p["player"].cast("string"), p["impact"]))
    return report.withColumn("players", F.array_join(line, ","))


def rated(s: Shapes) -> DataFrame:
    return both_boxes(s).withColumns(measures.efficiency())


def pairings(s: Shapes) -> DataFrame:
    """Distinct pairings of each season with the latest total quoted for them."""
    games = s.contest().join(s.odds().select("game_date", "home", "away", "total"), ["game_date", "home", "away"])
    return games.groupBy("season", "home", "away").agg(F.max_by("total", F.struct("game_date", "game")).alias("book_total"))


SHARED_SQL["season_form"] = f"""SELECT * FROM (SELECT season, team, row_number() {_LAST} AS r,
  CASE WHEN count(pts) {SEASON_W} {rows(10)}) >= 5 THEN avg(pts) {SEASON_W} {rows(10)}) END AS scored,
  CASE WHEN count(pts) {SEASON_W} {rows(10)}) >= 5 THEN avg(opp_pts) {SEASON_W} {rows(10)}) END AS allowed,
  CASE WHEN count(pts) {SEASON_W} {rows(10)}) >= 5 THEN avg(pace) {SEASON_W} {rows(10)}) END AS pace10 FROM rated) WHERE r = 1"""


@query(
    "rp_totals",
    "season:i home:i away:i model_total:f6 book_total:f2 edge:f6 call:s",
    """SELECT *, model_total - book_total AS edge, CASE WHEN model_total - book_total > 3 THEN 'OVER' WHEN model_total - book_total < -3 THEN 'UNDER' END AS call FROM
    (SELECT p.*, (h.scored + a.allowed) * coalesce((h.pace10 + a.pace10) / 2 / 99.5, 1) AS model_total FROM
      (SELECT season, home, away, arg_max(total, game_date * 1000000000 + game) AS book_total FROM (SELECT c.season, home, away, o.total, date_diff('day', DATE '1990-01-01', game_date) AS game_date, game
        FROM contest c JOIN odds o USING (game_date, home, away)) GROUP BY season, home, away) p
     JOIN season_form h ON p.season = h.season AND p.home = h.team JOIN season_form a ON p.season = a.season AND p.away = a.team) WHERE model_total IS NOT NULL""",
)
def rp_totals(s: Shapes) -> DataFrame:
    return rp.projected_totals(pairings(s), rated(s))


def lines(s: Shapes) -> DataFrame:
    """Book lines of some players, in other spellings of their names."""
    players = s.customer.select(F.col("c_custkey").alias("player")).filter("player % 3 <> 0")
    return players.select(
        F.concat(F.lit(" PLAYER "), F.col("player").cast("string"), F.lit(" ")).alias("name"), F.lit("PTS").alias("stat"),
        (10 + F.col("player") % 15).cast("double").alias("line"))


_P = "OVER (PARTITION BY team, player ORDER BY game_date, game"


def _prop_sql(column: str, label: str) -> str:
    return f"""SELECT team, player, rank, '{label}' AS stat, projection, last5, line, projection - line AS edge FROM
    (SELECT team, player, any_value(rank) AS rank, max(m) FILTER (WHERE r = 1) AS projection, string_agg(CAST({column} AS VARCHAR), ',' ORDER BY r DESC) FILTER (WHERE r <= 5) AS last5 FROM
      (SELECT l.*, t.rank, CASE WHEN count({column}) {_P} {rows(10)}) >= 5 THEN avg({column}) {_P} {rows(10)}) END AS m,
        row_number() OVER (PARTITION BY team, player ORDER BY game_date DESC, game DESC) AS r FROM player_log l JOIN top_players t USING (team, player)) GROUP BY team, player)
    LEFT JOIN (SELECT c_custkey AS player, 'PTS' AS quoted, 10 + c_custkey % 15 AS line FROM customer WHERE c_custkey % 3 <> 0) q USING (player)
    WHERE projection IS NOT NULL""" if label == "PTS" else f"""SELECT team, player, rank, '{label}' AS stat, projection, last5, NULL AS line, NULL AS edge FROM
    (SELECT team, player, any_value(rank) AS rank, max(m) FILTER (WHERE r = 1) AS projection, string_agg(CAST({column} AS VARCHAR), ',' ORDER BY r DESC) FILTER (WHERE r <= 5) AS last5 FROM
      (SELECT l.*, t.rank, CASE WHEN count({column}) {_P} {rows(10)}) >= 5 THEN avg({column}) {_P} {rows(10)}) END AS m,
        row_number() OVER (PARTITION BY team, player ORDER BY game_date DESC, game DESC) AS r FROM player_log l JOIN top_players t USING (team, player)) GROUP BY team, player)
    WHERE projection IS NOT NULL"""


SHARED_SQL["top_players"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY mean DESC NULLS LAST, player) AS rank FROM
  (SELECT team, player, avg(minutes) AS mean FROM player_log GROUP BY team, player)) WHERE rank <= 5"""


@query(
    "rp_props",
    "team:i player:l rank:i stat:s projection:f6 line:f2 edge:f6 value:i call:s last5:s",
    f"""SELECT *, CAST(coalesce(abs(edge), 0) >= 2 AS INT) AS value, CASE WHEN edge > 0 THEN 'OVER' WHEN edge <= 0 THEN 'UNDER' END AS call FROM
    ({" UNION ALL ".join(f"({_prop_sql(c, label)})" for c, label in rp.PROP_STATS.items())})""",
)
def rp_props(s: Shapes) -> DataFrame:
    props = rp.player_props(s.player_log(), lines(s))
    return props.withColumn("last5", F.array_join(F.transform("last5", lambda v: v.cast("string")), ","))


_PL = "OVER (PARTITION BY player ORDER BY game_date, game"


@query(
    "rp_projections",
    "player:l stat:s projection:f6 source:s",
    " UNION ALL ".join(
        f"""SELECT player, '{label}' AS stat, coalesce(p, m) AS projection, CASE WHEN p IS NULL AND m IS NULL THEN NULL WHEN p IS NULL OR p = m THEN 'rolling' ELSE 'model' END AS source FROM
        (SELECT player, CASE WHEN player % 4 = 0 AND '{label}' = 'PTS' THEN player % 30 + 0.25 END AS p,
          arg_max(m, date_diff('day', DATE '1990-01-01', game_date) * 1000000000 + game) FILTER (WHERE m IS NOT NULL) AS m
         FROM (SELECT *, avg({c}) {_PL} {rows(10)}) AS m FROM player_log) GROUP BY player)"""
        for c, label in rp.PROP_STATS.items()
    ),
)
def rp_projections(s: Shapes) -> DataFrame:
    rolled = wn.lag_mean(entity_log(s.player_log(), ["player"], ["game_date", "game"]), list(rp.PROP_STATS), [10]).result
    modelled = s.customer.filter("c_custkey % 4 = 0").select(
        F.col("c_custkey").alias("player"), F.lit("PTS").alias("stat"), (F.col("c_custkey") % 30 + 0.25).alias("projection"))
    return rp.projections(rolled, modelled, rp.PROP_STATS)


_STAKE = "greatest(0, 0.5 * (p * ((1 - q) / q) - (1 - p)) / ((1 - q) / q))"
SHARED_SQL["picked"] = f"""SELECT *, {_STAKE} AS stake, CASE WHEN edge_pct > 0 THEN CASE WHEN NOT {AGREE_SQL} THEN 'Skip' ELSE {TIER_SQL.format(e="edge_pct")} END
    WHEN greatest(p_home, 1 - p_home) >= 0.72 AND {AGREE_SQL} THEN 'Solid Pick' WHEN greatest(p_home, 1 - p_home) >= 0.60 THEN 'Lean' ELSE 'Skip' END AS tier,
    round_even(greatest(p_home, 1 - p_home) * 100, 0) AS confidence
  FROM (SELECT *, CASE WHEN p_home >= 0.5 THEN home ELSE away END AS predicted_winner, CASE WHEN p_home >= market_home THEN home ELSE away END AS pick,
    round(abs(p_home - market_home), 3) AS edge_pct, CAST(abs(p_home - market_home) >= 0.05 AS INT) AS value_bet,
    CASE WHEN p_home >= market_home THEN p_home ELSE 1 - p_home END AS p, CASE WHEN p_home >= market_home THEN market_home ELSE 1 - market_home END AS q FROM priced)"""


def picked(s: Shapes) -> DataFrame:
    return rp.picks(s.predictions(), s.odds())


@query(
    "rp_picks",
    "id:l predicted_winner:i pick:i spread:f2 edge_pct:f3 value_bet:i stake:f6 tier:s confidence:i",
    "SELECT * FROM picked",
)
def rp_picks(s: Shapes) -> DataFrame:
    return picked(s)


_NET = """(CAST(list_contains(f, 'HOME_HOT') AS INT) + CAST(list_contains(f, 'AWAY_COLD') AS INT) + CAST(list_contains(f, 'REST_ADV_HOME') AS INT)
  - CAST(list_contains(f, 'AWAY_HOT') AS INT) - CAST(list_contains(f, 'HOME_COLD') AS INT) - CAST(list_contains(f, 'REST_ADV_AWAY') AS INT))"""


@query(
    "rp_sharp_score",
    "id:l sharp_score:i sharp_side:i rating:s situation:s fade:i",
    f"""SELECT *, CASE WHEN sharp_score < 50 THEN 'LEAN' WHEN sharp_score < 70 THEN 'MODERATE' ELSE 'STRONG' END AS rating,
    CAST((sharp_side = home AND p_home < 0.4) OR (sharp_side = away AND p_home > 0.6) AS INT) AS fade FROM
    (SELECT id, home, away, p_home, CASE WHEN value_bet = 1 THEN pick ELSE predicted_winner END AS sharp_side,
      CAST(round_even((0.40 * CASE WHEN value_bet = 1 THEN least(edge_pct / 0.25, 1) ELSE 0 END + 0.30 * abs(p_home - 0.5) / 0.5 + 0.30 * least(abs({_NET}) / 3.0, 1)) * 100, 0) AS INT) AS sharp_score,
      coalesce(list_filter(f, lambda x: x IN ('HOME_HOT', 'AWAY_COLD', 'REST_ADV_HOME', 'AWAY_HOT', 'HOME_COLD', 'REST_ADV_AWAY'))[1], f[1]) AS situation
     FROM (SELECT p.*, CASE WHEN c.flags = '' THEN [] ELSE string_split(c.flags, ',') END AS f FROM picked p JOIN situations c USING (game)))""",
)
def rp_sharp_score(s: Shapes) -> DataFrame:
    return rp.sharp_scores(picked(s), context(s))


def explainer_features(s: Shapes) -> DataFrame:
    """Form, rest and ratings before each game from the contest features."""
    from duelframe.plans.features import contest_features
    from duelframe.plans.queries_features import team_features

    c = F.col
    return contest_features(team_features(s)).select(
        "game", c("home_win_roll10").alias("home_form"), c("away_win_roll10").alias("away_form"), c("home_days_rest").alias("home_rest"),
        c("away_days_rest").alias("away_rest"), c("away_is_back_to_back").alias("away_b2b"), c("diff_net_rtg_roll10").alias("net_gap"),
        c("diff_expected_roll10").alias("expected_gap"), c("home_expected_roll10").alias("home_expected"), c("away_expected_roll10").alias("away_expected"))


@query(
    "rp_explainers",
    "id:l recommended:i n_bullets:l first_bullet:s form_named:i one_liner:s",
    """SELECT id, pick AS recommended, greatest(least(n, 4), 2) AS n_bullets,
      CASE WHEN b2b = 1 THEN concat('T', away, ' playing 2nd game in 2 nights -- fatigue factor')
        WHEN p_home > 0.65 THEN concat('Model shows strong home advantage -- ', printf('%.1f%%', p_home * 100), ' win probability vs ', printf('%.1f%%', market_home * 100), ' implied by the line')
        WHEN hw >= 7 THEN concat('T', home, ' is ', hw, '-', 10 - hw, ' in their last 10 games')
        WHEN aw <= 3 THEN concat('T', away, ' has struggled recently -- only ', aw, ' wins in their last 10 games')
        WHEN hr > ar + 1 THEN concat('T', home, ' has ', hr, ' days rest vs T', away, '''s ', ar, ' -- significant rest advantage')
        WHEN edge_pct > 0.1 THEN 'edge' WHEN net > 5 THEN 'net' WHEN ex > 0.1 THEN 'expected' ELSE 'none' END AS first_bullet,
      CAST(hw IS NOT NULL AND aw IS NOT NULL AS INT) AS form_named,
      concat('T', pick, ' is undervalued -- books give them ', printf('%.1f%%', 100 * CASE WHEN pick = home THEN market_home ELSE 1 - market_home END), ' but our model says ',
        printf('%.1f%%', 100 * CASE WHEN pick = home THEN p_home ELSE 1 - p_home END), ' (model projects home win by ', printf('%.1f', abs(margin)), ')') AS one_liner
    FROM (SELECT *, coalesce(CAST(b2b = 1 AS INT), 0) + CAST(p_home > 0.65 AS INT) + coalesce(CAST(hw >= 7 AS INT), 0) + coalesce(CAST(aw <= 3 AS INT), 0)
        + CAST(hr > ar + 1 AS INT) + CAST(edge_pct > 0.1 AS INT) + coalesce(CAST(net > 5 AS INT), 0) + coalesce(CAST(ex > 0.1 AS INT), 0) AS n
      FROM (SELECT p.*, CAST(round_even(h.win_roll10 * 10, 0) AS INT) AS hw, CAST(round_even(a.win_roll10 * 10, 0) AS INT) AS aw, h.days_rest AS hr, a.days_rest AS ar,
        a.is_back_to_back AS b2b, h.net_rtg_roll10 - a.net_rtg_roll10 AS net, h.expected_roll10 - a.expected_roll10 AS ex
        FROM picked p JOIN team_features h ON p.game = h.game AND h.is_home = 1 JOIN team_features a ON p.game = a.game AND a.is_home = 0))""",
)
def rp_explainers(s: Shapes) -> DataFrame:
    told = rp.explainers(picked(s), explainer_features(s))
    first = F.element_at("bullets", 1)
    kind = (
        F.when(F.startswith(first, F.lit("Model edge")), "edge")
        .when(F.contains(first, F.lit(" outperforms ")), "net")
        .when(F.startswith(first, F.lit("Pythagorean")), "expected")
        .when(F.startswith(first, F.lit("Model projects")), "none")
        .otherwise(first)
    )
    return told.withColumns({
        "n_bullets": F.size("bullets"), "first_bullet": kind,
        "form_named": (F.col("home_form").isNotNull() & F.col("away_form").isNotNull()).cast("int"),
    })


@query(
    "rp_game_detail",
    "id:l home_wins:l away_wins:l p_home:f6 home_last10:s meetings:l wins_a:l home_absent:l n_factors:l",
    """SELECT p.id, h.wins AS home_wins, a.wins AS away_wins, p.p_home, c.home_last10, m.meetings, m.wins_a, coalesce(i.n, 0) AS home_absent,
      CAST(p.confidence > 50 AS INT) + CASE WHEN c.flags = '' THEN 0 ELSE len(string_split(c.flags, ',')) END + CAST(abs(c.home_streak) >= 4 AS INT) + CAST(abs(c.away_streak) >= 4 AS INT)
      + CAST(abs(h.pct - a.pct) >= 0.2 AS INT) + CAST(abs(p.margin) >= 8 OR abs(p.margin) <= 3 AS INT) + p.value_bet AS n_factors
    FROM picked p JOIN situations c USING (game) JOIN records h ON p.season = h.season AND p.home = h.team JOIN records a ON p.season = a.season AND p.away = a.team
    JOIN (SELECT side_a, side_b, count(*) AS meetings, sum(a_won) AS wins_a FROM meetings WHERE n <= 5 GROUP BY side_a, side_b) m ON m.side_a = least(p.home, p.away) AND m.side_b = greatest(p.home, p.away)
    LEFT JOIN (SELECT team, count(*) AS n FROM (SELECT DISTINCT team, player FROM absence_rows WHERE was_absent = 1
      AND day IN (SELECT DISTINCT day FROM absence_rows WHERE was_absent = 1 ORDER BY day DESC LIMIT 3)) GROUP BY team) i ON i.team = p.home""",
)
def rp_game_detail(s: Shapes) -> DataFrame:
    table = ag.conditional_record(s.contest_log(), ["season", "team"], "win", "is_home")
    history = topk.pair_history(s.contest(), "home", "away", ["game_date", "game"], "home_pts", "away_pts", 5)
    averages = player_days(s).groupBy("player").agg(F.avg("minutes").alias("average"))
    out = rp.injury_report(absence_rows(s).filter("was_absent = 1"), averages, "player", "team", "day")
    documents = rp.game_documents(picked(s), table, context(s), history, out)
    c = F.col
    return documents.select(
        "id", c("sides.home_record.wins").alias("home_wins"), c("sides.away_record.wins").alias("away_wins"), c("prediction.p_home"),
        c("context.home_last10"), c("series.meetings"), c("series.wins_a"), F.coalesce(F.size("absences.home_absent"), F.lit(0)).alias("home_absent"),
        F.size("factors").alias("n_factors"))


@query(
    "rp_trends",
    "season:i team:i wins10:l losses10:l scored10:f6 allowed10:f6 home_wins:l away_wins:l streak:l offence:f6 defence:f6 pace10:f6",
    f"""SELECT r.*, f.offence, f.defence, f.pace10 FROM records r JOIN (SELECT * FROM (SELECT season, team, row_number() {_LAST} AS r,
      avg(off_rtg) {W} {rows(10)}) - avg(off_rtg) {W} {rows(20)}) AS offence, avg(def_rtg) {W} {rows(10)}) - avg(def_rtg) {W} {rows(20)}) AS defence,
      avg(pace) {W} {rows(10)}) AS pace10 FROM rated) WHERE r = 1) f ON r.season = f.season AND r.team = f.team""",
)
def rp_trends(s: Shapes) -> DataFrame:
    return rp.trends(s.contest_log(), rated(s))


SHARED_SQL["shooters"] = "SELECT *, CASE WHEN fga > 0 THEN (fga * 0.3 + game % 5) / fga END AS rate FROM player_log"
_STREAKY = """SELECT player, {v} AS gap, last5 FROM (SELECT player, count(*) AS games, avg(pts) AS mean_pts, avg({c}) FILTER (WHERE r <= 5) - avg({c}) AS {v},
  count(*) FILTER (WHERE r <= 5 AND fga > 0) AS real, string_agg(CAST(pts AS VARCHAR), ', ' ORDER BY r DESC) FILTER (WHERE r <= 5) AS last5
  FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY game_date DESC, game DESC) AS r FROM shooters) GROUP BY player)
  WHERE games >= 10 AND mean_pts >= 8 AND real >= 3"""


@query(
    "rp_streaks",
    "kind:s name:s value:f6 detail:s",
    f"""(SELECT 'hot' AS kind, CAST(player AS VARCHAR) AS name, gap AS value, last5 AS detail FROM ({_STREAKY.format(c="pts", v="g")}) WHERE gap >= 5 ORDER BY gap DESC, player LIMIT 4)
    UNION ALL (SELECT 'cold', CAST(player AS VARCHAR), gap, last5 FROM ({_STREAKY.format(c="rate", v="g")}) WHERE gap <= -0.05 ORDER BY gap, player LIMIT 4)
    UNION ALL SELECT 'streak', CAST(team AS VARCHAR), streak, '' FROM streaks_all WHERE season = (SELECT max(season) FROM contest_log)
    UNION ALL (SELECT 'split', CAST(team AS VARCHAR), pct, concat(CAST(round_even(home_pct * 100, 0) AS INT), '/', CAST(round_even(away_pct * 100, 0) AS INT)) FROM records
      WHERE season = (SELECT max(season) FROM contest_log) ORDER BY pct DESC, team LIMIT 10)""",
)
def rp_streaks(s: Shapes) -> DataFrame:
    players = s.player_log().withColumn("fgm", F.col("fga") * 0.3 + F.col("game") % 5)
    latest = s.contest_log().agg(F.max("season")).first()[0]
    log = s.contest_log().filter(F.col("season") == F.lit(latest))
    teams = wn.run_at_end(entity_log(log, ["team"], ["game_date", "game"]), "win")
    splits = ag.conditional_record(log, ["team"], "win", "is_home")
    return rp.streak_document(rp.hot_players(players), rp.cold_players(players), teams, splits)


def _score(c: str, better: str) -> str:
    return f"CASE WHEN abs(h.{c} - a.{c}) < 1e-9 THEN 50 WHEN h.{c} {better} a.{c} THEN 80 ELSE 20 END"


@query(
    "rp_radar",
    "season:i home:i away:i home_scores:s away_scores:s net_gap:f6 pace_gap:f6",
    f"""SELECT p.season, p.home, p.away, concat_ws(',', {", ".join(_score(c, "<" if c == "def_rtg" else ">") for c in rp.RADAR)}) AS home_scores,
    concat_ws(',', {", ".join("100 - " + _score(c, "<" if c == "def_rtg" else ">") for c in rp.RADAR)}) AS away_scores,
    (h.off_rtg - h.def_rtg) - (a.off_rtg - a.def_rtg) AS net_gap, h.pace - a.pace AS pace_gap
    FROM (SELECT DISTINCT season, home, away FROM contest) p JOIN latest_form h ON p.home = h.team JOIN latest_form a ON p.away = a.team""",
)
def rp_radar(s: Shapes) -> DataFrame:
    found = rp.radar(s.contest().select("season", "home", "away").distinct(), rated(s))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return found.withColumns({"home_scores": text("home_scores"), "away_scores": text("away_scores")})


SHARED_SQL["latest_form"] = f"""SELECT * FROM (SELECT team, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game DESC) AS r,
  {", ".join(f"avg({c}) {W} {rows(10)}) AS {c}" for c in rp.RADAR)} FROM rated) WHERE r = 1"""


@query(
    "rp_player_detail",
    "player:l season:i gp:l pts:f6 scoring_fga:f6 passing_ast:f6 last5:s",
    """SELECT m.player, m.season, m.gp, m.pts, m.fga AS scoring_fga, m.ast AS passing_ast, l.last5 FROM
    (SELECT *, row_number() OVER (PARTITION BY player ORDER BY gp DESC, season DESC) AS n FROM player_seasons) m
    LEFT JOIN (SELECT player, string_agg(concat(game, ':', pts), ',' ORDER BY r) AS last5 FROM
      (SELECT *, row_number() OVER (PARTITION BY player ORDER BY game_date DESC, game DESC) AS r FROM player_log) WHERE r <= 5 GROUP BY player) l USING (player)
    WHERE m.n = 1 AND m.gp >= 2""",
)
def rp_player_detail(s: Shapes) -> DataFrame:
    seasons = player_seasons(s)
    tables = {"scoring": (seasons, ["fga", "fta", "fg3m"]), "passing": (seasons, ["ast", "tov"])}
    detail = rp.player_detail(seasons.select("player", "season", "gp", "pts"), s.player_log(), tables, min_games=2)
    line = F.transform("last5", lambda r: F.concat_ws(":", r["game"].cast("string"), r["pts"].cast("string")))
    return detail.select(
        "player", "season", "gp", "pts", F.col("scoring.fga").alias("scoring_fga"), F.col("passing.ast").alias("passing_ast"), F.array_join(line, ",").alias("last5"))


@query(
    "rp_comparison",
    "player:l games:l seasons:l best_season:i career_pts:f6 career_indexed:f6 position:s rank:l",
    """SELECT player, sum(gp) AS games, count(*) AS seasons, CAST(max_by(season, pts * 10000000 - season) AS INT) AS best_season, sum(pts * gp) / sum(gp) AS career_pts,
    sum(indexed * gp) / sum(gp) AS career_indexed, any_value(position) AS position,
    CASE WHEN row_number() OVER (ORDER BY sum(pts * gp) / sum(gp) DESC, player) <= 15 THEN row_number() OVER (ORDER BY sum(pts * gp) / sum(gp) DESC, player) END AS rank
    FROM (SELECT p.*, p.pts / a.pts * b.pts AS indexed, CASE WHEN p.player % 2 = 0 THEN 'G' ELSE 'F' END AS position FROM player_seasons p
      JOIN (SELECT season, avg(pts) AS pts FROM player_seasons GROUP BY season) a USING (season)
      CROSS JOIN (SELECT avg(pts) AS pts FROM (SELECT avg(pts) AS pts FROM player_seasons GROUP BY season)) b)
    GROUP BY player HAVING count(*) >= 5 OR sum(gp) >= 500""",
)
def rp_comparison(s: Shapes) -> DataFrame:
    return rp.comparison(player_seasons(s), F.when(F.col("player") % 2 == 0, "G").otherwise("F"))


@query(
    "rp_performance",
    "section:s name:s value:f6",
    f"""WITH days AS (SELECT game_date, count(*) AS n, sum(CAST({RIGHT_SQL} AS INT)) AS k FROM covers GROUP BY game_date),
      runs AS (SELECT *, CASE WHEN good THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY good, island ORDER BY game_date) AS run FROM
        (SELECT *, row_number() OVER (ORDER BY game_date) - row_number() OVER (PARTITION BY good ORDER BY game_date) AS island FROM (SELECT game_date, k / n >= 0.5 AS good FROM days)))
    SELECT 'accuracy' AS section, 'season' AS name, sum(k) / sum(n) AS value FROM days
    UNION ALL SELECT 'accuracy', 'last7', sum(k) / sum(n) FROM (SELECT * FROM days ORDER BY game_date DESC LIMIT 7)
    UNION ALL SELECT 'streak', 'current', arg_max(run, game_date) FROM runs UNION ALL SELECT 'streak', 'best', max(run) FROM runs WHERE run > 0
    UNION ALL SELECT 'roi', 'bets', count(*) FROM covers UNION ALL SELECT 'roi', 'wins', sum(CAST({RIGHT_SQL} AS INT)) FROM covers
    UNION ALL SELECT 'roi', 'roi', avg(CASE WHEN {RIGHT_SQL} THEN 100.0 / 110.0 ELSE -1 END) FROM covers
    UNION ALL SELECT 'clv', 'mean', avg(clv) FROM covers UNION ALL SELECT 'clv', 'positive', avg(CAST(clv > 0 AS INT)) FROM covers
    UNION ALL SELECT 'calibration', CASE WHEN c < 0.55 THEN '50-55%' WHEN c < 0.6 THEN '55-60%' WHEN c < 0.65 THEN '60-65%' WHEN c < 0.7 THEN '65-70%'
      WHEN c < 0.75 THEN '70-75%' WHEN c < 0.8 THEN '75-80%' ELSE '80%+' END, avg(CAST({RIGHT_SQL} AS INT)) FROM (SELECT *, greatest(p_home, 1 - p_home) AS c FROM covers) GROUP BY 1, 2""",
)
def rp_performance(s: Shapes) -> DataFrame:
    return rp.performance(covers(s), "p_home", right(), "clv")


_ROI = """count(bet_won) AS n_bets, count(*) FILTER (WHERE bet_won = 1) AS wins, avg(bet_won) AS hit_rate, avg(CASE WHEN bet_won = 1 THEN 100.0 / 110.0 WHEN bet_won = 0 THEN -1 END) AS roi"""


@query(
    "rp_backtest",
    "kind:s season:i n_bets:l wins:l hit_rate:f6 roi:f6",
    f"""WITH tagged AS (SELECT 'baseline' AS kind, * FROM covers UNION ALL SELECT 'value', * FROM covers WHERE abs(p_home - market_home) >= 0.05
      UNION ALL SELECT 'hold-out', * FROM covers WHERE season >= 199900)
    SELECT kind, NULL AS season, {_ROI} FROM tagged GROUP BY kind HAVING count(bet_won) >= 500
    UNION ALL SELECT kind, season, {_ROI} FROM tagged GROUP BY kind, season HAVING count(bet_won) >= 1""",
)
def rp_backtest(s: Shapes) -> DataFrame:
    from duelframe.functions.market import no_vig

    market_home, _ = no_vig(F.col("home_ml"), F.col("away_ml"))
    bets = covers(s).withColumn("market_home", market_home)
    return rp.backtest(bets, "bet_won", "p_home", "market_home", "season", F.col("season") >= 199900)
