"""Unions, keyed set operations and rows put together from several sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.measures import difference_block
from duelframe.operators.topk import first_row, latest_row


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; columns a part lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prefer(preferred: DataFrame, other: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Union of two sources with one row per key; the preferred source wins,
    within a source the row that comes first by all columns."""
    both = preferred.withColumn(flag, F.lit(1)).unionByName(other.withColumn(flag, F.lit(0)))
    return first_row(both, keys, [F.col(flag).desc(), *sorted(set(both.columns) - {flag})])


def without_keys(df: DataFrame, keys_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys_table``."""
    return df.join(keys_table, list(keys), "left_anti")


def interactions() -> dict[str, Column]:
    """Products and cross differences of a contest row with rolled features."""
    c = F.col
    home_edge = c("home_pts_roll20") - c("away_opp_pts_roll20")
    away_edge = c("away_pts_roll20") - c("home_opp_pts_roll20")
    tired = lambda side: c(f"{side}_is_back_to_back") * c(f"{side}_miles")
    return {
        "matchup_edge": home_edge - away_edge,
        "fatigue": tired("home") - tired("away"),
        "rating_x_rest": (c("home_rating") - c("away_rating")) * (c("home_days_rest") - c("away_days_rest")),
    }


def synthesize(log: DataFrame, schedule: DataFrame, entity: str, home_flag: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of future contests from each side's latest row in its role, with fresh differences."""
    latest = latest_row(log, [entity, home_flag], order)

    def side(flag: int, name: str) -> DataFrame:
        return latest.filter(F.col(home_flag) == flag).select(
            F.col(entity).alias(f"{name}_team"), *[F.col(c).alias(f"{name}_{c}") for c in columns]
        )

    planned = schedule.withColumnsRenamed({"home": "home_team", "away": "away_team"})
    rows = planned.join(side(1, "home"), "home_team").join(side(0, "away"), "away_team")
    return difference_block(rows, columns)


def patch_availability(games: DataFrame, scratched: DataFrame, team: str, star_usage: float = 0.25, team_minutes: float = 240.0) -> DataFrame:
    """Add known absences to contest rows: minutes lost, share available, star flag per side."""
    lost = scratched.groupBy(team).agg(
        F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("minutes"),
        F.max((F.col("usage") >= star_usage).cast("int")).alias("star"),
    )
    for side in ("home", "away"):
        mine = lost.select(
            F.col(team).alias(f"{side}_team"), F.col("minutes").alias(f"{side}_missing"), F.col("star").alias(f"{side}_star_out")
        )
        games = games.join(mine, f"{side}_team", "left").fillna({f"{side}_missing": 0.0, f"{side}_star_out": 0})
        games = games.withColumn(
            f"{side}_availability", F.greatest(F.lit(0.0), 1 - F.col(f"{side}_missing") / team_minutes)
        )
    return games
