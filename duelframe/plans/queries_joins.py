"""Join and set-operation queries with their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions import measures
from duelframe.functions.market import home_covers
from duelframe.operators import joins, sets, windows as wn
from duelframe.operators.ordered import entity_log
from duelframe.operators.topk import first_row
from duelframe.plans.queries_windows import KEY, PRIOR, SEASON_W, W, rows, season_log
from duelframe.plans.registry import SHARED_SQL, query
from duelframe.plans.shapes import Shapes

# Players are the event users, ten to a team; a team plays on each day one of them has an event.
_TEAM = "CAST(floor(entity / 10) AS BIGINT)"
SHARED_SQL["player_days"] = f"""SELECT entity AS player, {_TEAM} AS team, day, sum(value) / 10 AS minutes,
  0.10 + (entity % 20) / 100.0 AS usage FROM event_log GROUP BY entity, day"""
SHARED_SQL["player_status"] = """SELECT *, CASE WHEN games >= 3 THEN roll END AS min_roll5,
  games >= 3 AND roll >= 6 AS in_rotation, lead(day) OVER (PARTITION BY player ORDER BY day) AS until
  FROM (SELECT *, avg(minutes) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS roll,
    count(minutes) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS games FROM player_days)"""
SHARED_SQL["team_days"] = "SELECT DISTINCT team, day FROM player_days"
# As-of in its plainest form: the last status before the day, no older than the limit.
SHARED_SQL["expected"] = """SELECT * EXCLUDE (n) FROM (SELECT d.team, d.day, s.player, s.min_roll5, s.usage, s.in_rotation, s.day AS since,
  row_number() OVER (PARTITION BY d.team, d.day, s.player ORDER BY s.day DESC) AS n
  FROM team_days d JOIN player_status s ON s.team = d.team AND s.day <= d.day)
  WHERE n = 1 AND in_rotation AND since < day AND day - since <= 25"""


def player_days(s: Shapes) -> DataFrame:
    """Minutes per player and day."""
    return s.log().groupBy(F.col("entity").alias("player"), "day").agg((F.sum("value") / 10).alias("minutes")).select(
        "player",
        F.floor(F.col("player") / 10).alias("team"),
        "day",
        "minutes",
        (0.10 + F.col("player") % 20 / 100).alias("usage"),
    )


def player_status(days: DataFrame) -> DataFrame:
    """Rotation status before each appearance: mean of the last five, at least three."""
    rolled = wn.lag_mean(entity_log(days, ["player"], ["day"]), ["minutes"], [5], min_rows=3).result
    return rolled.withColumnRenamed("minutes_roll5", "min_roll5").withColumn(
        "in_rotation", F.coalesce(F.col("min_roll5") >= 6, F.lit(False))
    )


def expected_players(status: DataFrame, days: DataFrame) -> DataFrame:
    """Players that are expected on each day their team plays."""
    dates = days.select("team", "day").distinct()
    since = status.withColumnRenamed("day", "since").select("player", "team", "since", "min_roll5", "usage", "in_rotation")
    return joins.valid_on(since, dates, ["player"], ["team"], "since", "day", 25, where=F.col("in_rotation"))


@query(
    "jn_opponent_lookup",
    f"{KEY} opp_pre_win_pct:f6 sos_roll10:f6",
    f"""SELECT *, avg(opp_pre_win_pct) {W} {rows(10)}) AS sos_roll10 FROM
    (SELECT a.team, a.game_date, a.game, b.cum AS opp_pre_win_pct FROM paced_log a LEFT JOIN paced_log b
     ON a.game = b.game AND a.opp = b.team)""",
)
def opponent_lookup(s: Shapes) -> DataFrame:
    paced = wn.cumulative_record(season_log(s), "win").result
    joined = joins.opponent_lookup(paced, ["game"], "team", "opp", {"cum_win_pct": "opp_pre_win_pct"})
    rolled = wn.lag_mean(entity_log(joined, ["team"], ["game_date", "game"]), ["opp_pre_win_pct"], [10]).result
    return rolled.withColumnRenamed("opp_pre_win_pct_roll10", "sos_roll10")


SHARED_SQL["paced_log"] = f"SELECT *, coalesce(avg(win) {SEASON_W} {PRIOR}), 0.5) AS cum FROM contest_log"


@query(
    "jn_opponent_box",
    "game:l team:i opp_fga:i opp_fgm:i opp_oreb:i opp_dreb:i opp_tov:i opp_fta:i opp_fg3m:i",
    "SELECT * FROM boxed",
)
def opponent_box(s: Shapes) -> DataFrame:
    from duelframe.plans.queries_scalars import both_boxes

    return both_boxes(s)


@query(
    "jn_two_sided_pivot",
    "game:l season:i home_team:i away_team:i home_pts:i away_pts:i home_tov:i away_tov:i",
    """SELECT h.game, h.season, h.team AS home_team, a.team AS away_team, h.pts AS home_pts, a.pts AS away_pts,
    h.tov AS home_tov, a.tov AS away_tov FROM contest_log h JOIN contest_log a ON h.game = a.game
    WHERE h.is_home = 1 AND a.is_home = 0""",
)
def two_sided_pivot(s: Shapes) -> DataFrame:
    return joins.two_sided(s.contest_log(), ["game", "season"], "is_home", ["team", "pts", "tov"])


@query(
    "jn_not_self",
    "game:l team:i opp_pts:i",
    "SELECT a.game, a.team, b.pts AS opp_pts FROM contest_log a JOIN contest_log b ON a.game = b.game AND a.team <> b.team",
)
def not_self(s: Shapes) -> DataFrame:
    log = s.contest_log().select("game", "team", "opp", "pts")
    return joins.opponent_columns(log, ["game"], "team", "opp", ["pts"])


@query(
    "jn_asof_backward",
    "event:l entity:l bought:f4 bought_event:l",
    """SELECT event, entity, v.value AS bought, v.event AS bought_event FROM
    (SELECT l.event, l.entity, arg_max({'value': r.value, 'event': r.event}, r.ts) AS v
     FROM (SELECT * FROM event_log WHERE kind = 'view') l LEFT JOIN (SELECT * FROM event_log WHERE kind = 'purchase') r
       ON l.entity = r.entity AND r.ts <= l.ts GROUP BY l.event, l.entity)""",
)
def asof_backward(s: Shapes) -> DataFrame:
    log = s.log()
    views = log.filter("kind = 'view'").select("entity", "event", "ts")
    bought = log.filter("kind = 'purchase'").select(
        "entity", "event", "ts", F.col("value").alias("bought"), F.col("event").alias("bought_event")
    )
    return joins.as_of_backward(views, bought, ["entity"], "ts", "ts", "event", ["bought", "bought_event"])


@query(
    "jn_interval_validity",
    "team:l day:d player:l since:d min_roll5:f8",
    "SELECT * FROM expected",
)
def interval_validity(s: Shapes) -> DataFrame:
    days = player_days(s)
    return expected_players(player_status(days), days)


@query(
    "jn_anti_missing",
    "team:l day:d player:l",
    "SELECT team, day, player FROM expected e ANTI JOIN player_days p ON e.player = p.player AND e.day = p.day",
)
def anti_missing(s: Shapes) -> DataFrame:
    days = player_days(s)
    return joins.missing_from(expected_players(player_status(days), days), days, ["player", "day"])


@query(
    "jn_dim_left",
    "player:l season:i usage:f6 gp:l",
    """SELECT p.player, p.season, coalesce(d.usage, 0.18) AS usage, coalesce(d.prior_gp, 0) AS gp FROM player_log p LEFT JOIN
    (SELECT player, season + 101 AS season, avg(fga) / 100 AS usage, count(*) AS prior_gp FROM player_log GROUP BY player, season) d
    ON p.player = d.player AND p.season = d.season""",
)
def dim_left(s: Shapes) -> DataFrame:
    log = s.player_log()
    prior = log.groupBy("player", (F.col("season") + 101).alias("season")).agg(
        (F.avg("fga") / 100).alias("usage"), F.count(F.lit(1)).alias("gp")
    )
    return joins.enrich(log.select("player", "season"), prior, ["player", "season"], {"usage": 0.18, "gp": 0})


@query(
    "jn_context_both_sides",
    "player:l game:l team_pts:i team_tov:i opp_pts:i opp_tov:i",
    """SELECT p.player, p.game, t.pts AS team_pts, t.tov AS team_tov, o.pts AS opp_pts, o.tov AS opp_tov FROM player_log p
    LEFT JOIN contest_log t ON p.game = t.game AND p.team = t.team LEFT JOIN contest_log o ON p.game = o.game AND p.opp = o.team""",
)
def context_both_sides(s: Shapes) -> DataFrame:
    players = s.player_log().select("player", "game", "team", "opp")
    context = s.contest_log().select("game", "team", "pts", "tov")
    return joins.both_sides_context(players, context, "game", "team", "opp", ["pts", "tov"])


@query(
    "jn_semi_filter",
    "game:l team:i pts:i",
    "SELECT game, team, pts FROM contest_log l SEMI JOIN contest c ON l.game = c.game AND l.team = c.home",
)
def semi_filter(s: Shapes) -> DataFrame:
    sides = s.contest().select("game", F.col("home").alias("team"))
    return s.contest_log().join(sides, ["game", "team"], "left_semi")


@query(
    "jn_odds_multi_key",
    "game:l season:i spread:f2 total:f2 home_ml:i",
    "SELECT c.game, c.season, o.spread, o.total, o.home_ml FROM contest c JOIN odds o USING (game_date, home, away) WHERE season NOT IN (199596, 199900)",
)
def odds_multi_key(s: Shapes) -> DataFrame:
    games = s.contest().filter(~F.col("season").isin(199596, 199900))
    return games.join(s.odds(), ["game_date", "home", "away"])


@query(
    "jn_leak_guard",
    "game:l season:i spread:f2",
    "SELECT c.game, c.season, o.spread FROM contest c JOIN odds o USING (game_date, home, away)",
)
def leak_guard(s: Shapes) -> DataFrame:
    features = s.contest().drop("home_pts", "away_pts", "price")
    safe = joins.forbid_columns(features, ["home_pts", "away_pts", "plus_minus", "home_win"])
    return safe.join(s.odds(), ["game_date", "home", "away"])


@query(
    "jn_cross_keys_text",
    "c_custkey:l s_suppkey:l",
    """SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier
    ON lower(trim(replace(c_name, 'Customer', ' KEY '))) = lower(trim(replace(s_name, 'Supplier', 'key ')))""",
)
def cross_keys_text(s: Shapes) -> DataFrame:
    left = s.customer.withColumn("name", F.regexp_replace("c_name", "Customer", " KEY ")).withColumn(
        "text_key", joins.text_key("name")
    )
    right = s.supplier.withColumn("name", F.regexp_replace("s_name", "Supplier", "key ")).select(
        joins.text_key("name").alias("text_key"), "s_suppkey"
    )
    return left.join(right, "text_key", "left")


@query(
    "jn_model_vs_market",
    "market:s game:l subject:s model:f4 line:f4 gap:f4 flagged:i",
    """SELECT 'game' AS market, p.game, concat('T', CAST(home AS VARCHAR)) AS subject, p.margin AS model, o.spread AS line,
      p.margin - o.spread AS gap, CAST(abs(p.margin - o.spread) >= 5 AS INT) AS flagged
    FROM (SELECT game, game_date, home, away, margin FROM predictions) p
    JOIN odds o USING (game_date, home, away)
    UNION ALL SELECT 'pts', l.game, concat('P', CAST(l.player AS VARCHAR)), m.mean, 10 + l.game % 17, m.mean - (10 + l.game % 17),
      CAST(abs(m.mean - (10 + l.game % 17)) >= 5 AS INT)
    FROM player_log l LEFT JOIN (SELECT player, avg(pts) AS mean FROM player_log WHERE game % 4 <> 0 GROUP BY player) m
      ON l.player = m.player""",
)
def model_vs_market(s: Shapes) -> DataFrame:
    first = s.predictions().select("game", "game_date", "home", "away", F.col("margin").alias("model"))
    games = first.join(s.odds(), ["game_date", "home", "away"]).select(
        F.lit("game").alias("market"), "game", F.concat(F.lit("T"), "home").alias("subject"), "model",
        F.col("spread").alias("line"),
    )
    players = s.player_log()
    means = players.filter("game % 4 <> 0").groupBy("player").agg(F.avg("pts").alias("model"))
    props = players.join(means, "player", "left").select(
        F.lit("pts").alias("market"), "game", F.concat(F.lit("P"), "player").alias("subject"), "model",
        (10 + F.col("game") % 17).cast("double").alias("line"),
    )
    gap = F.col("model") - F.col("line")
    return games.unionByName(props).withColumn("gap", gap).withColumn("flagged", (F.abs(gap) >= 5).cast("int"))


@query(
    "jn_lookup_last_wins",
    "game:l model:s p_home:f6",
    """SELECT c.game, p.model, p.p_home FROM contest c LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY game_date, home, away ORDER BY id DESC) AS n FROM predictions) p
    ON c.game_date = p.game_date AND c.home = p.home AND c.away = p.away AND p.n = 1""",
)
def lookup_last_wins(s: Shapes) -> DataFrame:
    keys = ["game_date", "home", "away"]
    index = joins.last_wins(s.predictions(), keys, ["id"]).select(*keys, "model", "p_home")
    return s.contest().select("game", *keys).join(index, keys, "left")


@query(
    "jn_map_fallback",
    "c_custkey:l code:s",
    """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN concat('unknown ', n_name) ELSE concat('N', CAST(n_nationkey AS VARCHAR)) END AS code
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def map_fallback(s: Shapes) -> DataFrame:
    spelled = _spelled(s)
    return joins.map_names(spelled, "name", _codes(s), "n_name", "code", "code")


def _codes(s: Shapes) -> DataFrame:
    return s.nation.select("n_name", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))


def _spelled(s: Shapes) -> DataFrame:
    """Customers with the name of their nation in several spellings."""
    kind = F.col("c_nationkey") % 5
    name = (
        F.when(kind == 0, F.col("n_name"))
        .when(kind == 4, F.concat(F.lit("unknown "), "n_name"))
        .otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
    )
    nation = s.nation.select("n_nationkey", "n_name")
    joined = s.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "c_nationkey", name.alias("name"))


@query(
    "jn_map_unmapped",
    "name:s n:l",
    """SELECT concat('unknown ', n_name) AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_nationkey % 5 = 4 GROUP BY n_name""",
)
def map_unmapped(s: Shapes) -> DataFrame:
    return joins.unmapped_names(_spelled(s), "name", _codes(s), "n_name")


@query(
    "jn_all_pairs",
    "a:i b:i p:f6",
    """SELECT a, b, 0.85 * (x.r / (1 - x.r) * 1.5) / (x.r / (1 - x.r) * 1.5 + y.r / (1 - y.r)) + 0.075 AS p FROM
    (SELECT DISTINCT home AS a, away AS b FROM contest UNION SELECT DISTINCT away, home FROM contest)
    JOIN (SELECT team, least(greatest(avg(win), 0.01), 0.99) AS r FROM contest_log GROUP BY team) x ON a = x.team
    JOIN (SELECT team, least(greatest(avg(win), 0.01), 0.99) AS r FROM contest_log GROUP BY team) y ON b = y.team""",
)
def all_pairs(s: Shapes) -> DataFrame:
    from duelframe.functions.market import paired_strength

    rates = s.contest_log().groupBy("team").agg(F.avg("win").alias("rate"))
    pairs = joins.met_pairs(s.contest(), "home", "away")
    return (
        pairs.join(rates.select(F.col("team").alias("a"), F.col("rate").alias("rate_a")), "a")
        .join(rates.select(F.col("team").alias("b"), F.col("rate").alias("rate_b")), "b")
        .withColumn("p", paired_strength(F.col("rate_a"), F.col("rate_b")))
    )


@query(
    "jn_either_side",
    "game:l meeting:l earlier_wins_a:l",
    """SELECT game, row_number() OVER (PARTITION BY least(home, away), greatest(home, away) ORDER BY game_date, game) AS meeting,
    coalesce(sum(CAST((home_pts >= away_pts) = (home < away) AS INT)) OVER (PARTITION BY least(home, away), greatest(home, away)
      ORDER BY game_date, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier_wins_a FROM contest""",
)
def either_side(s: Shapes) -> DataFrame:
    keyed = s.contest().withColumns(joins.canonical_pair("home", "away"))
    a_won = ((F.col("home_pts") >= F.col("away_pts")) == (F.col("home") < F.col("away"))).cast("int")
    log = entity_log(keyed, ["side_a", "side_b"], ["game_date", "game"]).numbered_log("meeting")
    return log.running({"earlier_wins_a": ("sum", a_won)})


_ERA_CASE = " ".join(f"WHEN season BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in joins.ERAS)


@query(
    "jn_range_era",
    "game:l era:s spell:s",
    f"""SELECT game, CASE {_ERA_CASE} ELSE 'Unknown' END AS era,
    CASE WHEN season BETWEEN 199495 AND 199697 THEN 'early' WHEN season BETWEEN 199900 AND 200001 THEN 'late' END AS spell FROM contest""",
)
def range_era(s: Shapes) -> DataFrame:
    # Intervals as data: the seasons of two spells found in the table itself.
    spells = s.contest().select("season").distinct().filter(
        F.col("season").between(199495, 199697) | F.col("season").between(199900, 200001)
    ).groupBy(F.when(F.col("season") < 199800, "early").otherwise("late").alias("spell")).agg(
        F.min("season").alias("first"), F.max("season").alias("last")
    )
    labelled = s.contest().select("game", "season").withColumn("era", joins.era_of(F.col("season")))
    return joins.in_interval(labelled, "season", spells, "first", "last")


@query(
    "jn_home_side_key",
    "game:l team:i officials:l",
    """SELECT l.game, l.team, r.officials FROM contest_log l LEFT JOIN (SELECT game_date, home, max(game) AS g,
      sum(CAST(slot_1 IS NOT NULL AS INT) + CAST(slot_2 IS NOT NULL AS INT) + CAST(trim(slot_3) <> '' AS INT)) AS officials
      FROM crew GROUP BY game_date, home) r
    ON l.game_date = r.game_date AND r.home = CASE WHEN l.is_home = 1 THEN l.team ELSE l.opp END""",
)
def home_side_key(s: Shapes) -> DataFrame:
    present = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "").cast("int")
    crews = s.crew().groupBy("game_date", F.col("home").alias("home_team")).agg(
        F.sum(present("slot_1") + present("slot_2") + present("slot_3")).alias("officials")
    )
    host = F.when(F.col("is_home") == 1, F.col("team")).otherwise(F.col("opp"))
    log = s.contest_log().select("game", "game_date", "team", host.alias("home_team"))
    return joins.enrich(log, crews, ["game_date", "home_team"])


@query(
    "sc_interactions",
    "game:l matchup_edge:f6 fatigue:f6 rating_x_rest:f6",
    f"""WITH f AS (SELECT *, avg(pts) {W} {rows(20)}) AS off, avg(opp_pts) {W} {rows(20)}) AS def,
      least(coalesce(date_diff('day', lag(game_date) {W}), game_date), 7), 14) AS rest,
      sum(plus_minus) {W} {PRIOR}) AS rating FROM contest_log)
    SELECT h.game, (h.off - a.def) - (a.off - h.def) AS matchup_edge,
      CAST(h.rest <= 1 AS INT) * 100.0 * h.team - CAST(a.rest <= 1 AS INT) * 100.0 * a.team AS fatigue,
      (coalesce(h.rating, 0) - coalesce(a.rating, 0)) * (h.rest - a.rest) AS rating_x_rest
    FROM f h JOIN f a ON h.game = a.game AND h.is_home = 1 AND a.is_home = 0""",
)
def interactions(s: Shapes) -> DataFrame:
    log = entity_log(s.contest_log(), ["team"], ["game_date", "game"])
    log = wn.days_since(wn.lag_mean(log, ["pts", "opp_pts"], [20]), "game_date")
    rated = log.running({"rating": ("sum", F.col("plus_minus"))}).withColumn("miles", 100.0 * F.col("team"))
    games = joins.two_sided(
        rated, ["game"], "is_home", ["pts_roll20", "opp_pts_roll20", "days_rest", "is_back_to_back", "miles", "rating"]
    )
    return games.select("game", *[c.alias(n) for n, c in sets.interactions().items()])


@query(
    "sc_synthesize_row",
    "home_team:i away_team:i diff_pts:f4 diff_tov:f4",
    """SELECT h.team AS home_team, a.team AS away_team, h.pts - a.pts AS diff_pts, h.tov - a.tov AS diff_tov FROM
    (SELECT DISTINCT home, away FROM contest WHERE season = (SELECT max(season) FROM contest)) p
    JOIN (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game DESC) AS n FROM contest_log WHERE is_home = 1) h
      ON p.home = h.team AND h.n = 1
    JOIN (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game DESC) AS n FROM contest_log WHERE is_home = 0) a
      ON p.away = a.team AND a.n = 1""",
)
def synthesize_row(s: Shapes) -> DataFrame:
    games = s.contest()
    last = games.agg(F.max("season").alias("season"))
    schedule = games.join(F.broadcast(last), "season", "left_semi").select("home", "away").distinct()
    return sets.synthesize(s.contest_log(), schedule, "team", "is_home", ["game_date", "game"], ["pts", "tov"])


@query(
    "sc_patch_row",
    "game:l home_missing:f4 home_availability:f6 home_star_out:i away_missing:f4 away_availability:f6 away_star_out:i",
    """SELECT c.game, coalesce(h.m, 0) AS home_missing, greatest(0, 1 - coalesce(h.m, 0) / 240) AS home_availability, coalesce(h.s, 0) AS home_star_out,
      coalesce(a.m, 0) AS away_missing, greatest(0, 1 - coalesce(a.m, 0) / 240) AS away_availability, coalesce(a.s, 0) AS away_star_out
    FROM contest c LEFT JOIN out_teams h ON c.home = h.team LEFT JOIN out_teams a ON c.away = a.team""",
)
def patch_row(s: Shapes) -> DataFrame:
    latest = first_row(s.player_log(), ["player"], [F.col("game_date").desc(), F.col("game").desc()])
    scratched = latest.filter("player % 40 = 0").select("team", "minutes", (F.col("fga") / 100).alias("usage"))
    games = s.contest().select("game", F.col("home").alias("home_team"), F.col("away").alias("away_team"))
    return sets.patch_availability(games, scratched, "team", star_usage=0.2)


SHARED_SQL["out_teams"] = """SELECT team, coalesce(sum(minutes), 0) AS m, CAST(max(fga) >= 20 AS INT) AS s FROM
  (SELECT *, row_number() OVER (PARTITION BY player ORDER BY game_date DESC, game DESC) AS n FROM player_log)
  WHERE n = 1 AND player % 40 = 0 GROUP BY team"""


@query(
    "so_union",
    "game:l source:s pts:i extra:i",
    """SELECT game, 'home' AS source, home_pts AS pts, home AS extra FROM contest
    UNION ALL SELECT game, 'away', away_pts, NULL FROM contest""",
)
def union(s: Shapes) -> DataFrame:
    c = s.contest()
    home = c.select("game", F.lit("home").alias("source"), F.col("home_pts").alias("pts"), F.col("home").alias("extra"))
    away = c.select("game", F.lit("away").alias("source"), F.col("away_pts").alias("pts"))
    return sets.union_by_name([home, away])


@query(
    "so_distinct",
    "team:l member:l gp:i minutes:f4",
    """SELECT team, member, gp, minutes FROM (SELECT *, row_number() OVER (PARTITION BY team, member
      ORDER BY gp DESC, minutes DESC, order_key, line) AS n FROM (SELECT DISTINCT * FROM lineups)) WHERE n = 1""",
)
def distinct(s: Shapes) -> DataFrame:
    order = [F.col("gp").desc(), F.col("minutes").desc(), "order_key", "line"]
    return first_row(s.lineups().distinct(), ["team", "member"], order)


@query(
    "so_prefer_dedupe",
    "player:l day:d flagged:i minutes:f4",
    """SELECT player, day, flagged, minutes FROM (SELECT *, row_number() OVER (PARTITION BY player, day ORDER BY flagged DESC) AS n FROM
    (SELECT player, day, 0 AS flagged, minutes FROM player_days
     UNION ALL SELECT player, day, 1, minutes * 2 FROM player_days WHERE player % 3 = 0)) WHERE n = 1""",
)
def prefer_dedupe(s: Shapes) -> DataFrame:
    days = player_days(s).select("player", "day", "minutes")
    flagged = days.filter("player % 3 = 0").withColumn("minutes", F.col("minutes") * 2)
    return sets.prefer(flagged, days, ["player", "day"], "flagged")


@query(
    "so_except_keys",
    "game:l season:i",
    "SELECT game, season FROM contest WHERE season NOT IN (SELECT season FROM contest WHERE game % 100 = 0 AND home = 3)",
)
def except_keys(s: Shapes) -> DataFrame:
    c = s.contest()
    rebuilt = c.filter("game % 100 = 0 AND home = 3").select("season").distinct()
    return sets.without_keys(c, rebuilt, ["season"])
