"""Nested payloads to flat rows: market quotes, player props, games, status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.text import literal_map, local_date
from duelframe.operators.topk import first_row

MATCHUP = "id BIGINT, parentId BIGINT, startTime TIMESTAMP, participants ARRAY<STRUCT<alignment: STRING, name: STRING>>"
MARKET = (
    "matchupId BIGINT, type STRING, period INT, position BIGINT,"
    " prices ARRAY<STRUCT<designation: STRING, price: INT, points: DOUBLE>>"
)
PROP = (
    "id BIGINT, startTime TIMESTAMP, special STRUCT<category: STRING, description: STRING>,"
    " participants ARRAY<STRUCT<id: BIGINT, name: STRING>>,"
    " prices ARRAY<STRUCT<participantId: BIGINT, designation: STRING, price: INT, points: DOUBLE>>"
)
GAME = (
    "id BIGINT, date STRING, season INT, status STRING, home_team STRUCT<id: INT, abbreviation: STRING>,"
    " visitor_team STRUCT<id: INT, abbreviation: STRING>, home_team_score INT, visitor_team_score INT"
)

# Short names of prop statistics and of injury statuses.
STATS = {
    "Points": "PTS",
    "Rebounds": "REB",
    "Assists": "AST",
    "3 Point FG": "3PM",
    "Pts+Rebs+Asts": "PRA",
    "Double+Double": "DD2",
}
STATUSES = {
    "Out": "out",
    "Questionable": "questionable",
    "Probable": "probable",
    "Day-To-Day": "day-to-day",
}


def parse(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.select(F.from_json(column, schema).alias("p")).select("p.*")


def _value(items: str, key: str, wanted: str, field: str) -> Column:
    """``field`` of the last item whose ``key`` is ``wanted``."""
    return F.try_element_at(F.filter(items, lambda i: i[key] == wanted), F.lit(-1))[field]


def quotes(matchups: DataFrame, markets: DataFrame) -> DataFrame:
    """One row per contest: teams, local date, moneylines, first spread, first total.

    Kept are top-level matchups with a home and an away side, and period 0
    markets. ``position`` is the place of a market in its payload: the last
    moneyline and the first spread and total of a contest count.
    """
    sides = lambda a: F.filter("participants", lambda p: p["alignment"] == a)
    games = matchups.filter(
        F.col("parentId").isNull() & (F.size(sides("home")) > 0) & (F.size(sides("away")) > 0)
    ).select(
        "id",
        local_date(F.col("startTime")).alias("game_date"),
        _value("participants", "alignment", "home", "name").alias("home_team"),
        _value("participants", "alignment", "away", "name").alias("away_team"),
    )
    first_total = F.try_element_at(F.filter("prices", lambda p: p["points"].isNotNull()), F.lit(1))["points"]
    lines = markets.filter("period = 0").select(
        F.col("matchupId").alias("id"),
        "type",
        "position",
        _value("prices", "designation", "home", "price").alias("home_price"),
        _value("prices", "designation", "away", "price").alias("away_price"),
        _value("prices", "designation", "home", "points").alias("home_points"),
        first_total.alias("total_points"),
    )
    of = lambda kind, also=None: F.when(
        (F.col("type") == kind) if also is None else (F.col("type") == kind) & also, F.col("position")
    )
    per_game = lines.groupBy("id").agg(
        F.max_by("home_price", of("moneyline")).alias("home_moneyline"),
        F.max_by("away_price", of("moneyline")).alias("away_moneyline"),
        F.min_by("home_points", of("spread")).alias("spread"),
        F.min_by("total_points", of("total", F.col("total_points").isNotNull())).alias("total"),
    )
    return games.join(per_game, "id", "left")


def props(payload: DataFrame) -> DataFrame:
    """Player, statistic, line and both prices of each player prop; those without a line drop out."""
    # "Name (Statistic)": the statistic stands behind the last opening bracket, up to the end.
    text = F.trim("special.description")
    behind = F.substring_index(text, " (", -1)
    bracketed = F.contains(text, F.lit(" (")) & F.endswith(text, F.lit(")"))
    special = payload.filter("special.category = 'Player Props'").withColumns({
        "player": F.when(bracketed, F.trim(F.substring(text, F.lit(1), F.length(text) - F.length(behind) - 2))),
        "label": F.trim(F.substring(behind, F.lit(1), F.length(behind) - 1)),
    }).filter("player <> '' AND label <> ''")
    named = F.map_from_arrays(
        F.transform("participants", lambda p: p["id"]), F.transform("participants", lambda p: F.lower(p["name"]))
    )
    sided = special.withColumn("names", named).withColumn("sided", F.transform("prices", lambda p: F.struct(
        F.coalesce(F.try_element_at(F.col("names"), p["participantId"]), F.lower(p["designation"])).alias("side"),
        p["price"].alias("price"), p["points"].alias("points"),
    )))
    last = lambda word: F.try_element_at(F.filter("sided", lambda p: F.contains(p["side"], F.lit(word))), F.lit(-1))["price"]
    line = F.try_element_at(F.filter("sided", lambda p: p["points"].isNotNull()), F.lit(1))["points"]
    return sided.select(
        "player",
        F.coalesce(F.try_element_at(literal_map(STATS), F.col("label")), F.col("label")).alias("stat"),
        line.alias("line"),
        last("over").alias("over_price"),
        last("under").alias("under_price"),
        local_date(F.col("startTime")).alias("game_date"),
    ).filter("line IS NOT NULL")


def games(payload: DataFrame) -> DataFrame:
    """Nested game records to flat rows."""
    return payload.select(
        F.col("id").alias("game"),
        F.to_date(F.substring("date", 1, 10)).alias("game_date"),
        "season",
        "status",
        F.col("home_team.id").alias("home"),
        F.col("home_team.abbreviation").alias("home_team"),
        F.col("visitor_team.id").alias("away"),
        F.col("visitor_team.abbreviation").alias("away_team"),
        F.col("home_team_score").alias("home_pts"),
        F.col("visitor_team_score").alias("away_pts"),
    )


def statuses(api: DataFrame, document: DataFrame, teams: DataFrame) -> DataFrame:
    """Two layouts of status reports in one schema.

    An unknown status is lower-cased in the first and dropped in the second.
    ``teams`` maps ``team_name`` to ``team_abbr``; unknown teams keep their name.
    """
    known = literal_map(STATUSES)
    raw = F.trim("player_status")
    first = api.select(
        "date", F.trim("player_name").alias("player_name"), F.trim(F.col("player_id").cast("string")).alias("player_id"),
        F.trim("team_name").alias("team_name"),
        F.coalesce(F.try_element_at(known, raw), F.lower(raw)).alias("status"), F.trim("reason").alias("injury_type"),
    )
    second = document.select(
        "date", F.trim("player_name").alias("player_name"), F.lit("").alias("player_id"), F.trim("team").alias("team_name"),
        F.try_element_at(known, F.trim("current_status")).alias("status"), F.trim("reason").alias("injury_type"),
    )
    both = first.unionByName(second).filter(F.col("status").isNotNull() & (F.col("status") != ""))
    codes = first_row(teams, ["team_name"], ["team_abbr"])
    return both.join(codes, "team_name", "left").withColumn("team_abbr", F.coalesce("team_abbr", "team_name")).drop("team_name")
