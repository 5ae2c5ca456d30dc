"""Keyed stores kept as tables: write-once, latest-wins, opening and closing lines, outcomes.

A store is a DataFrame; each operator returns its next version, to be written
by partition. Nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.measures import bucket
from duelframe.functions.text import formatted, signed
from duelframe.operators.sets import union_by_name
from duelframe.operators.topk import first_row, latest_row

LINE_KEYS = ("game_date", "home", "away")


def write_once(store: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows to append: the first incoming row of each key the store does not hold yet."""
    fresh = incoming if store is None else incoming.join(store.select(*keys), list(keys), "left_anti")
    return first_row(fresh, keys, list(order))


def latest_wins(store: DataFrame, keys: Sequence[str], order: Sequence[str], date: str, as_of: Column, days: int = 60) -> DataFrame:
    """The latest row per key among those of the last ``days`` days."""
    return latest_row(store.filter(F.col(date) >= F.date_sub(as_of, days)), keys, order)


def bet_tracker(predictions: DataFrame, ledger: DataFrame, value_bets: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """Latest prediction per game with its line, its value edge and how it ended."""
    keys = list(LINE_KEYS)
    kept = latest_wins(predictions, keys, ["id"], "game_date", as_of, days)
    joined = kept.join(ledger.select(*keys, "opening_spread"), keys, "left").join(
        value_bets.select(*keys, "edge"), keys, "left"
    )
    home = F.col("p_home") >= 0.5
    winner = F.when(home, F.col("home")).otherwise(F.col("away"))
    actual = F.when(F.col("home_win") == 1, F.col("home")).when(F.col("home_win") == 0, F.col("away"))
    return joined.withColumns({
        "predicted_winner": winner,
        "pick": F.concat_ws(" ", winner.cast("string"), signed(F.col("opening_spread"))),
        "edge_pct": F.col("edge") * 100,
        "value_bet": F.col("edge").isNotNull().cast("int"),
        "actual_winner": actual,
        "result": F.when(actual.isNull(), "pending").when(winner == actual, "win").otherwise("loss"),
    })


def upsert_lines(ledger: DataFrame, quotes: DataFrame, as_of: Column, keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Next version of the line ledger.

    An opening line is logged once and never changed. A closing line is set once,
    for past games with an opening line; the closing-line value follows from both.
    """
    old = ledger.select(*keys, "opening_spread", "closing_spread")
    new = quotes.select(*keys, F.col("opening_spread").alias("__open"), F.col("closing_spread").alias("__close"))
    known = old.withColumn("__known", F.lit(True)).join(new, list(keys), "full")
    opening = F.when(F.col("__known"), F.col("opening_spread")).otherwise(F.col("__open"))
    past = F.col(keys[0]) < as_of
    closing = F.coalesce("closing_spread", F.when(past & opening.isNotNull(), F.col("__close")))
    return known.select(*keys, opening.alias("opening_spread"), closing.alias("closing_spread")).withColumn(
        "clv", F.round(F.col("opening_spread") - F.col("closing_spread"), 2)
    )


def fill_outcomes(predictions: DataFrame, results: DataFrame, today: Column, keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Pending predictions with their outcome: ``filled``, ``future`` or ``no match``; others are ``known``."""
    found = results.select(*keys, F.col("home_win").alias("__result"), F.col("margin").alias("actual_margin"))
    joined = predictions.join(found, list(keys), "left")
    pending = F.col("home_win").isNull()
    past = F.col(keys[0]) < today
    status = (
        F.when(~pending, "known")
        .when(~past, "future")
        .when(F.col("__result").isNull(), "no match")
        .otherwise("filled")
    )
    filled = F.when(pending & past, F.col("__result")).otherwise(F.col("home_win"))
    return joined.withColumn("status", status).withColumn("home_win", filled).drop("__result")


def outcome_summary(filled: DataFrame) -> DataFrame:
    return filled.filter(F.col("status") != "known").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


MOVES = ["stable", "moderate_move", "sharp_action"]


def line_report(sources: Sequence[DataFrame], keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Opening and current line per game with the move in words; earlier sources win.

    Sources have ``opening_spread closing_spread`` and ``needs_close`` (1 if a
    row without a closing line says nothing). A source claims a game even if its
    row says nothing.
    """
    ranked = [df.withColumn("__priority", F.lit(i)) for i, df in enumerate(sources)]
    claims = union_by_name(ranked)
    chosen = first_row(claims, keys, ["__priority", *sorted(set(claims.columns) - {"__priority"})])
    usable = F.col("opening_spread").isNotNull() & ((F.col("needs_close") == 0) | F.col("closing_spread").isNotNull())
    opening = F.col("opening_spread")
    pending = F.col("closing_spread").isNull()
    current = F.coalesce("closing_spread", "opening_spread")
    move = F.round(current - opening, 2)
    size = F.abs(F.col("movement"))
    home, away = F.col("home").cast("string"), F.col("away").cast("string")
    side = F.when(F.col("direction") == "home", home).otherwise(away)
    label = (
        F.when(size < 0.05, "No movement")
        .when(F.col("movement") < 0, F.concat(home, F.lit(" "), signed(F.col("current_spread"))))
        .otherwise(F.concat(away, F.lit(" "), signed(size)))
    )
    strength = F.when(F.col("classification") == "sharp_action", "Sharp").otherwise("Moderate")
    text = (
        F.when(F.col("pending"), F.concat(F.lit("Opening line "), signed(opening), F.lit(" -- game not yet closed")))
        .when(F.col("classification") == "stable", F.concat(
            F.lit("Line stable at "), signed(F.col("current_spread")), F.lit(" -- no significant money movement")))
        .otherwise(F.concat(
            F.lit("Line moved "), formatted(size, "%.1f"), F.lit(" pt(s) toward "), side, F.lit(" ("), signed(opening),
            F.lit(" -> "), signed(F.col("current_spread")), F.lit(") -- "), strength, F.lit(" money on "), side))
    )
    return (
        chosen.filter(usable)
        .withColumns({"current_spread": current, "movement": move, "pending": pending})
        .withColumns({
            "direction": F.when(F.col("movement") < -0.05, "home").when(F.col("movement") > 0.05, "away").otherwise("no_movement"),
            "classification": bucket(size, [0.5, 1.5], MOVES),
            "steam_move": (size >= 1.5).cast("int"),
        })
        .withColumns({"movement_label": label, "interpretation": text})
        .drop("__priority", "needs_close", "pending", "closing_spread")
    )
