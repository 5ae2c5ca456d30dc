"""Source and sink queries with their checking SQL. Files and payloads are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions.text import clean_columns
from duelframe.plans.queries_windows import W
from duelframe.plans.registry import query
from duelframe.plans.shapes import Shapes
from duelframe.operators.resumable import Resumable, step
from duelframe.operators.sets import union_by_name
from duelframe.sources import files, nested, sinks, variants
from duelframe.storage import new_path

LOG_SCHEMA = (
    T.StructType().add("PLAYER_ID", T.StringType()).add("GAME ID", T.LongType()).add("PTS", T.IntegerType())
    .add("MINUTES", T.DoubleType())
)
TEAM_SCHEMA = T.StructType().add("TEAM_ID", T.LongType()).add("GAME_ID", T.LongType())
INDEX_SCHEMA = (
    T.StructType().add("layout", T.StringType()).add("player_id", T.LongType()).add("player_name", T.StringType())
    .add("position", T.StringType()).add("height", T.IntegerType())
)


def season_files(s: Shapes, name: str, rows: DataFrame) -> str:
    """Write rows as one folder of CSV files per season, named ``<name>_<season>.csv``."""
    root = new_path(s.spark, "raw")
    named = rows.withColumn("file", F.concat(F.lit(f"{name}_"), F.col("season").cast("string"), F.lit(".csv"))).drop("season")
    named.write.option("header", True).partitionBy("file").csv(f"{root}/{name}")
    return root


def raw_players(s: Shapes) -> DataFrame:
    key = F.when(F.col("game") % 50 == 0, F.lit("n/a")).otherwise(F.col("player").cast("string"))
    return s.player_log().select(
        key.alias("PLAYER_ID"), F.col("game").alias("GAME ID"), F.col("pts").alias("PTS"), F.col("minutes").alias("MINUTES"), "season"
    )


@query(
    "src_partitioned_csv",
    "season:i rows:l pts:l minutes:f4",
    "SELECT season, count(*) AS rows, sum(pts) AS pts, sum(minutes) AS minutes FROM player_log GROUP BY season",
)
def partitioned_csv(s: Shapes) -> DataFrame:
    root = season_files(s, "player_stats", raw_players(s))
    table = files.read_seasons(s.spark, f"{root}/player_stats", "player_stats", LOG_SCHEMA)
    return table.groupBy("season").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("PTS").alias("pts"), F.sum("MINUTES").alias("minutes")
    )


@query(
    "src_clean_columns",
    "player_id:s game_id:l home_away:s w_l:i",
    """SELECT CAST(player AS VARCHAR) AS player_id, game AS game_id, concat(CAST(team AS VARCHAR), '/', CAST(opp AS VARCHAR)) AS home_away,
    pts AS w_l FROM player_log""",
)
def clean(s: Shapes) -> DataFrame:
    return clean_columns(s.player_log().select(
        F.col("player").cast("string").alias(" Player-ID"), F.col("game").alias("GAME ID"),
        F.concat_ws("/", "team", "opp").alias("Home/Away"), F.col("pts").alias("W-L "),
    ))


@query(
    "src_coerce_reject",
    "player:l game:l",
    "SELECT player, game FROM player_log WHERE game % 50 <> 0",
)
def coerce_reject(s: Shapes) -> DataFrame:
    return files.with_integer_key(raw_players(s), "PLAYER_ID").select(F.col("PLAYER_ID").alias("player"), F.col("GAME ID").alias("game"))


@query(
    "src_reject_count",
    "kept:l rejected:l",
    "SELECT count(*) FILTER (WHERE game % 50 <> 0) AS kept, count(*) FILTER (WHERE game % 50 = 0) AS rejected FROM player_log",
)
def reject_count(s: Shapes) -> DataFrame:
    return files.rejected(raw_players(s), "PLAYER_ID")


@query(
    "src_table_registry",
    "table:s season:i rows:l keys:l",
    """SELECT 'player_stats' AS "table", season, count(*) AS rows, count(DISTINCT player) AS keys FROM player_log WHERE game % 50 <> 0 GROUP BY season
    UNION ALL SELECT 'team_logs', season, count(*), count(DISTINCT team) FROM contest_log GROUP BY season""",
)
def table_registry(s: Shapes) -> DataFrame:
    from duelframe.operators.sets import union_by_name

    teams = s.contest_log().select(F.col("team").alias("TEAM_ID"), F.col("game").alias("GAME_ID"), "season")
    root = season_files(s, "player_stats", raw_players(s))
    tables = {
        "player_stats": files.SeasonalTable("player_stats", LOG_SCHEMA, "player_id", ["player_id", "game_id"]),
        "hustle": files.SeasonalTable("hustle", LOG_SCHEMA, "player_id", ["player_id"], optional=True),
    }
    loaded = files.load_registered(s.spark, root, tables)
    team_root = season_files(s, "team_logs", teams)
    loaded |= files.load_registered(s.spark, team_root, {
        "team_logs": files.SeasonalTable("team_logs", TEAM_SCHEMA, "team_id", ["team_id", "game_id"])
    })
    return union_by_name([
        df.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(f"{name.split('_')[0]}_id").alias("keys"))
        .withColumn("table", F.lit(name))
        for name, df in loaded.items()
    ])


@query(
    "src_incremental_files",
    "part:s rows:l",
    "SELECT 'all' AS part, count(*) AS rows FROM player_log UNION ALL SELECT 'newer', 0",
)
def incremental_files(s: Shapes) -> DataFrame:
    root = season_files(s, "player_stats", raw_players(s))
    table = files.read_seasons(s.spark, f"{root}/player_stats", "player_stats", LOG_SCHEMA)
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(name))
    since = lambda text: files.changed_since(table, F.lit(text).cast("timestamp"))
    return count("all", since("2000-01-01")).unionByName(count("newer", since("2200-01-01")))


@query(
    "src_partition_replace",
    "season:i player:l game:l pts:i",
    """SELECT season, player, game, pts FROM player_log WHERE season NOT IN (199798, 199899)
    UNION ALL SELECT season, player, game, pts + 1 FROM player_log WHERE season IN (199798, 199899)""",
)
def partition_replace(s: Shapes) -> DataFrame:
    rows = s.player_log().select("season", "player", "game", "pts")
    rebuilt = rows.filter("season IN (199798, 199899)").withColumn("pts", F.col("pts") + 1)
    doubled = rebuilt.unionByName(rebuilt)
    return files.replace_seasons(rows, doubled, "season", ["player", "game"], ["pts"])


@query(
    "src_partition_overwrite",
    "season:i player:l game:l pts:i",
    """SELECT season, player, game, pts FROM player_log WHERE season NOT IN (199798, 199899)
    UNION ALL SELECT season, player, game, pts + 1 FROM player_log WHERE season IN (199798, 199899)""",
)
def partition_overwrite(s: Shapes) -> DataFrame:
    rows = s.player_log().select("season", "player", "game", "pts")
    path = new_path(s.spark, "seasons")
    files.write_seasons(rows, path)
    files.write_seasons(rows.filter("season IN (199798, 199899)").withColumn("pts", F.col("pts") + 1), path)
    return s.spark.read.schema(rows.schema).parquet(path)


@query(
    "src_dimension_load",
    "part:l brand:s size:i",
    "SELECT p_partkey AS part, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 10 <> 7",
)
def dimension_load(s: Shapes) -> DataFrame:
    key = F.when(F.col("p_partkey") % 10 != 7, F.col("p_partkey").cast("string")).otherwise(F.lit("?"))
    raw = s.part.select(key.alias("Part Key"), F.col("p_brand").alias("BRAND"), F.col("p_size").alias("Part-Size"))
    twice = raw.unionByName(raw)
    return files.dimension(twice, {"part_key": "part", "part_size": "size"}, "part")


@query(
    "src_tolerant_union",
    "source:s rows:l pts:l",
    """SELECT 'a' AS source, count(*) AS rows, sum(pts) AS pts FROM player_log WHERE season < 199798
    UNION ALL SELECT 'b', count(*), NULL FROM player_log WHERE season >= 199798""",
)
def tolerant_union(s: Shapes) -> DataFrame:
    root = new_path(s.spark, "mixed")
    rows = s.player_log().select(F.col("player").alias("PLAYER ID"), F.col("game").alias("GAME-ID"), "pts", "season")
    rows.filter("season < 199798").drop("season").write.option("header", True).csv(f"{root}/a")
    rows.filter("season >= 199798").drop("season", "pts").write.option("header", True).csv(f"{root}/b")
    rows.select("PLAYER ID").write.option("header", True).csv(f"{root}/incomplete")
    paths = {name: f"{root}/{name}" for name in ("a", "b", "incomplete", "absent")}
    table, skipped = files.tolerant_union(s.spark, paths, ["player_id", "game_id"])
    if list(skipped) != ["incomplete", "absent"]:
        raise AssertionError(skipped)
    return table.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("pts").try_cast("bigint")).alias("pts"))


@query(
    "src_flatten_quotes",
    "id:l game_date:d home_team:s away_team:s home_moneyline:i away_moneyline:i spread:f2 total:f2",
    """SELECT game AS id, game_date, concat('T', CAST(home AS VARCHAR)) AS home_team, concat('T', CAST(away AS VARCHAR)) AS away_team,
    CASE WHEN game % 6 <> 0 THEN CAST(100 + game % 90 AS INT) END AS home_moneyline, CASE WHEN game % 6 <> 0 THEN CAST(-110 - game % 70 AS INT) END AS away_moneyline,
    (game % 41 - 20) / 2.0 AS spread, 200 + game % 30 AS total FROM contest WHERE game % 8 <> 0 AND game % 9 <> 0""",
)
def flatten_quotes(s: Shapes) -> DataFrame:
    games = s.contest()
    side = lambda name, column: f"named_struct('alignment', '{name}', 'name', concat('T', {column}))"
    matchups = games.selectExpr(f"""to_json(named_struct('id', game, 'parentId', IF(game % 8 = 0, game + 1, NULL),
        'startTime', CAST(game_date AS TIMESTAMP) + INTERVAL 20 HOURS,
        'participants', IF(game % 9 = 0, array({side('neutral', 'home')}), array({side('home', 'home')}, {side('away', 'away')})))) AS payload""")
    price = lambda name, p, pts: f"named_struct('designation', '{name}', 'price', {p}, 'points', {pts})"
    market = lambda kind, period, position, *prices: (
        f"named_struct('matchupId', game, 'type', '{kind}', 'period', {period}, 'position', {position}, 'prices', array({', '.join(prices)}))"
    )
    none_d, line = "CAST(NULL AS DOUBLE)", "CAST((game % 41 - 20) / 2 AS DOUBLE)"
    money = "IF(game % 6 = 0, 'other', 'moneyline')"
    quotes = [
        market("moneyline", 0, 1, price("home", "CAST(100 + game % 90 AS INT)", none_d), price("away", "CAST(-110 - game % 70 AS INT)", none_d)).replace("'moneyline'", money),
        market("spread", 0, 2, price("home", "-110", line), price("away", "-110", f"-{line}")),
        market("spread", 0, 3, price("home", "-140", "99D"), price("away", "120", "-99D")),
        market("total", 0, 4, price("over", "-105", none_d), price("under", "-115", "CAST(200 + game % 30 AS DOUBLE)")),
        market("spread", 1, 0, price("home", "-110", "55D"), price("away", "-110", "-55D")),
    ]
    markets = games.selectExpr(f"explode(array({', '.join(f'to_json({q})' for q in quotes)})) AS payload")
    return nested.quotes(nested.parse(matchups, "payload", nested.MATCHUP), nested.parse(markets, "payload", nested.MARKET))


@query(
    "src_flatten_props",
    "player:s stat:s line:f2 over_price:i under_price:i game_date:d",
    """SELECT concat('Player ', CAST(player AS VARCHAR)) AS player, CASE game % 3 WHEN 0 THEN 'PTS' WHEN 1 THEN '3PM' ELSE 'Steals' END AS stat,
    pts + 0.5 AS line, CAST(-100 - game % 40 AS INT) AS over_price, CAST(-120 - game % 30 AS INT) AS under_price, game_date
    FROM player_log WHERE game % 5 <> 0 AND game % 7 <> 0 AND game % 11 <> 0""",
)
def flatten_props(s: Shapes) -> DataFrame:
    payload = s.player_log().selectExpr("""to_json(named_struct('id', game, 'startTime', CAST(game_date AS TIMESTAMP) + INTERVAL 20 HOURS,
        'special', named_struct('category', IF(game % 5 = 0, 'Team Props', 'Player Props'), 'description', IF(game % 7 = 0, 'unclear',
            concat('Player ', player, ' (', CASE game % 3 WHEN 0 THEN 'Points' WHEN 1 THEN '3 Point FG' ELSE 'Steals' END, ')'))),
        'participants', array(named_struct('id', game * 2, 'name', 'Over'), named_struct('id', game * 2 + 1, 'name', 'Under')),
        'prices', array(
            named_struct('participantId', game * 2, 'designation', NULL, 'price', CAST(-100 - game % 40 AS INT), 'points', IF(game % 11 = 0, NULL, pts + 0.5D)),
            named_struct('participantId', NULL, 'designation', 'Under', 'price', CAST(-120 - game % 30 AS INT), 'points', IF(game % 11 = 0, NULL, pts + 0.5D))))) AS payload""")
    return nested.props(nested.parse(payload, "payload", nested.PROP))


@query(
    "src_flatten_games",
    "game:l game_date:d season:i status:s home:i home_team:s away:i away_team:s home_pts:i away_pts:i",
    """SELECT game, game_date, season, status, home, concat('T', CAST(home AS VARCHAR)) AS home_team, away,
    concat('T', CAST(away AS VARCHAR)) AS away_team, home_pts, away_pts FROM contest""",
)
def flatten_games(s: Shapes) -> DataFrame:
    payload = s.contest().selectExpr("""to_json(named_struct('id', game, 'date', concat(game_date, 'T00:00:00.000Z'), 'season', season, 'status', status,
        'home_team', named_struct('id', home, 'abbreviation', concat('T', home)), 'visitor_team', named_struct('id', away, 'abbreviation', concat('T', away)),
        'home_team_score', home_pts, 'visitor_team_score', away_pts)) AS payload""")
    return nested.games(nested.parse(payload, "payload", nested.GAME))


_STATUS = "CASE c_custkey % 4 WHEN 0 THEN 'Out' WHEN 1 THEN 'Questionable' WHEN 2 THEN 'Available' ELSE ' Day-To-Day ' END"


@query(
    "src_normalize_status",
    "player_name:s player_id:s team_abbr:s status:s injury_type:s",
    f"""SELECT c_name AS player_name, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS player_id,
    CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE concat('N', CAST(n_nationkey AS VARCHAR)) END AS team_abbr,
    lower(trim({_STATUS})) AS status, c_mktsegment AS injury_type
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 OR trim({_STATUS}) <> 'Available'""",
)
def normalize_status(s: Shapes) -> DataFrame:
    reports = s.customer.join(s.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "raw", F.expr(_STATUS)
    ).withColumn("date", F.lit("2001-01-01").cast("date"))
    api = reports.filter("c_custkey % 2 = 0").select(
        "date", F.col("c_name").alias("player_name"), F.col("c_custkey").alias("player_id"),
        F.concat(F.lit(" "), "n_name").alias("team_name"), F.col("raw").alias("player_status"), F.col("c_mktsegment").alias("reason"),
    )
    document = reports.filter("c_custkey % 2 = 1").select(
        "date", F.col("c_name").alias("player_name"), F.col("n_name").alias("team"), F.col("raw").alias("current_status"),
        F.col("c_mktsegment").alias("reason"),
    )
    teams = s.nation.filter("n_nationkey % 5 <> 0").select(
        F.col("n_name").alias("team_name"), F.concat(F.lit("N"), "n_nationkey").alias("team_abbr")
    )
    return nested.statuses(api, document, teams)


@query(
    "src_coalesce_columns",
    "layout:s player_id:l player_name:s position:s height:i",
    """SELECT 'new' AS layout, p_partkey AS player_id, concat(p_brand, ' ', p_type) AS player_name, p_name AS position, NULL AS height FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'old', p_partkey, p_brand, '', p_size FROM part WHERE p_partkey % 2 = 1""",
)
def coalesce_columns(s: Shapes) -> DataFrame:
    new = s.part.filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("PERSON_ID"), F.concat(F.lit(" "), "p_brand").alias("PLAYER FIRST NAME"),
        F.col("p_type").alias("Player-Last-Name"), F.concat("p_name", F.lit(" ")).alias("POS"),
    )
    old = s.part.filter("p_partkey % 2 = 1").select(
        F.col("p_partkey").alias("player_id"), F.col("p_brand").alias("display_first_last"), F.col("p_size").alias("height")
    )
    first = files.conform(files.player_index(new).withColumn("layout", F.lit("new")), INDEX_SCHEMA)
    sizes = old.select("player_id", "height")
    second = files.player_index(old).join(sizes, "player_id").withColumn("layout", F.lit("old"))
    return first.unionByName(files.conform(second, INDEX_SCHEMA))


@query(
    "src_skip_existing",
    "season:i rows:l",
    """SELECT season, count(*) AS rows FROM player_log WHERE season NOT IN (SELECT season FROM player_log WHERE game % 1000 = 1 AND season < 199900) GROUP BY season""",
)
def skip_existing(s: Shapes) -> DataFrame:
    rows = s.player_log()
    existing = rows.filter("game % 1000 = 1 AND season < 199900")
    return files.missing_periods(rows, existing, "season").groupBy("season").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "snk_append_snapshot",
    "game_date:d home:i away:i spread:f2 hour:i",
    """SELECT game_date, home, away, spread, 9 AS hour FROM odds
    UNION ALL SELECT game_date, home, away, spread + 1, 15 FROM odds""",
)
def append_snapshot(s: Shapes) -> DataFrame:
    path = new_path(s.spark, "snapshots")
    quotes = s.odds().select(F.trunc("game_date", "year").alias("year"), "game_date", "home", "away", "spread")
    taken = lambda hour: F.lit(f"2001-08-01 {hour:02d}:00:00").cast("timestamp")
    sinks.append_snapshot(quotes, path, taken(9), "year")
    sinks.append_snapshot(quotes.withColumn("spread", F.col("spread") + 1), path, taken(15), "year")
    return s.spark.read.parquet(path).withColumn("hour", F.hour("snapshot_ts"))


@query(
    "snk_json_report",
    "game_date:d count:l ids:s",
    """SELECT game_date, count(*) AS count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM predictions
    WHERE game_date = (SELECT max(game_date) FROM predictions) GROUP BY game_date""",
)
def json_report(s: Shapes) -> DataFrame:
    path = new_path(s.spark, "report")
    day = F.lit("2050-01-01").cast("date")
    sinks.write_report(sinks.daily_document(s.predictions(), "game_date", day, ["id"], ["home", "away", "p_home"]), path)
    schema = "game_date DATE, count BIGINT, rows ARRAY<STRUCT<id: BIGINT, home: INT, away: INT, p_home: DOUBLE>>"
    ids = F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",")
    return s.spark.read.schema(schema).json(path).withColumn("ids", ids)


RESUMED = Resumable(
    entity=["team"], order=["game_date", "game"], means={"pts": [5, 20], "plus_minus": [10]}, decays={"plus_minus": [7], "win": [15]},
    streaks={"streak": "win"}, records={"win": ("cum_wins", "cum_losses", "cum_win_pct")}, within=["season"],
)


@query(
    "src_resumable_windows",
    "team:i game_date:d game:l " + " ".join(f"{c}:{'l' if c in ('streak', 'cum_wins', 'cum_losses') else 'f6'}" for c in RESUMED.features),
    f"""SELECT f.* REPLACE (r.streak AS streak) FROM team_features f JOIN (SELECT team, game, coalesce(lag(run) {W}), 0) AS streak FROM
      (SELECT *, CASE WHEN win = 1 THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY team, win, island ORDER BY game_date, game) AS run FROM
        (SELECT *, row_number() {W}) - row_number() OVER (PARTITION BY team, win ORDER BY game_date, game) AS island FROM contest_log))) r
    ON r.team = f.team AND r.game = f.game""",
)
def resumable_windows(s: Shapes) -> DataFrame:
    """The features of all seasons, made season by season at the end: the last two see the stored state and their own files only."""
    path = new_path(s.spark, "log-by-season")
    s.contest_log().select("team", "game_date", "game", "season", "win", "pts", "plus_minus").write.partitionBy("season").parquet(path)
    log = s.spark.read.parquet(path)
    seasons = sorted(r[0] for r in log.select("season").distinct().collect())
    parts, state = [], None
    for batch in (seasons[:-2], seasons[-2:-1], seasons[-1:]):
        features, state = step(RESUMED, log.where(F.col("season").isin(batch)), state)
        parts.append(features)
    return union_by_name(parts)


def changed_props(s: Shapes) -> DataFrame:
    """Prop payloads of a feed that has changed: some have a new field, some a price that is a word, some are cut off."""
    return s.player_log().selectExpr("*", """to_json(named_struct('id', game, 'startTime', CAST(game_date AS TIMESTAMP) + INTERVAL 20 HOURS,
        'special', named_struct('category', IF(game % 5 = 0, 'Team Props', 'Player Props'), 'description', concat('Player ', player, ' (Points)')),
        'participants', array(named_struct('id', game * 2, 'name', 'Over'), named_struct('id', game * 2 + 1, 'name', 'Under')),
        'prices', array(
            named_struct('participantId', game * 2, 'price', CAST(-100 - game % 40 AS INT), 'points', pts + 0.5D),
            named_struct('participantId', game * 2 + 1, 'price', CAST(-120 - game % 30 AS INT), 'points', pts + 0.5D)))) AS p0""").selectExpr(
        "*", "IF(game % 19 = 0, concat('{\"limit\":{\"max\":', game, '},', substring(p0, 2)), p0) AS p1",
    ).selectExpr(
        "*", """IF(game % 17 = 0, replace(p1, concat('"participantId":', game * 2, ',"price":', CAST(-100 - game % 40 AS INT)),
            concat('"participantId":', game * 2, ',"price":"even"')), p1) AS p2""",
    ).selectExpr("IF(game % 23 = 0, substring(p2, 1, 40), p2) AS payload")


@query(
    "src_variant_props",
    "player:s stat:s line:f2 over_price:i under_price:i game_date:d",
    """SELECT concat('Player ', CAST(player AS VARCHAR)) AS player, 'PTS' AS stat, pts + 0.5 AS line, CASE WHEN game % 17 <> 0 THEN CAST(-100 - game % 40 AS INT) END AS over_price,
    CAST(-120 - game % 30 AS INT) AS under_price, game_date FROM player_log WHERE game % 5 <> 0 AND game % 23 <> 0""",
)
def variant_props(s: Shapes) -> DataFrame:
    return variants.props(changed_props(s))[0]


@query(
    "src_variant_unread",
    "feed:s problems:s unknown:s payloads:l whole:l",
    """SELECT 'props' AS feed, CASE WHEN game % 23 = 0 THEN 'no JSON' WHEN game % 17 = 0 THEN 'prices.price: not int' ELSE '' END AS problems,
    CASE WHEN game % 19 = 0 AND game % 23 <> 0 THEN 'limit' ELSE '' END AS unknown, count(*) AS payloads,
    CAST(sum(CASE WHEN game % 19 = 0 AND game % 23 <> 0 THEN game ELSE 0 END) AS BIGINT) AS whole
    FROM player_log WHERE game % 23 = 0 OR game % 17 = 0 OR game % 19 = 0 GROUP BY ALL""",
)
def variant_unread(s: Shapes) -> DataFrame:
    """What the typed columns lack is still there: ``whole`` sums a number out of the unknown field."""
    found = variants.props(changed_props(s))[1]
    limit = F.get_json_object(F.try_element_at("unknown", F.lit("limit")), "$.max").cast("long")
    return found.groupBy("feed", F.array_join("problems", "; ").alias("problems"), F.array_join(F.array_sort(F.map_keys("unknown")), "; ").alias("unknown")).agg(
        F.count(F.lit(1)).alias("payloads"), F.coalesce(F.sum(limit), F.lit(0)).alias("whole"))
