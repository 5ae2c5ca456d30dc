"""Rule-ordered explanation texts as array expressions.

The sentences are fixed values: readers of the reports rely on their wording.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe.functions.market import probability_from_spread
from duelframe.functions.text import formatted, percent, signed


def _text(*parts: Column | str) -> Column:
    """Concatenation; NULL if any part is NULL, so a rule without data says nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _whole(value: Column) -> Column:
    return value.cast("int").cast("string")


def bullets(c: Mapping[str, Column], limit: int = 4) -> Column:
    """At most ``limit`` reasons in order of priority, and at least two.

    Uses ``home away p_home market away_b2b home_form away_form home_rest
    away_rest edge net_gap expected_gap home_expected away_expected``; forms are
    win rates of the last ten, ``market`` the probability the market implies.
    """
    implied = F.coalesce(percent(c["market"]), F.lit("N/A"))
    home_wins, away_wins = F.bround(c["home_form"] * 10), F.bround(c["away_form"] * 10)
    rules = F.array_compact(F.array(
        F.when(c["away_b2b"], _text(c["away"], " playing 2nd game in 2 nights -- fatigue factor")),
        F.when(c["p_home"] > 0.65, _text(
            "Model shows strong home advantage -- ", percent(c["p_home"]), " win probability vs ", implied,
            " implied by the line")),
        F.when(home_wins >= 7, _text(
            c["home"], " is ", _whole(home_wins), "-", _whole(10 - home_wins), " in their last 10 games")),
        F.when(away_wins <= 3, _text(
            c["away"], " has struggled recently -- only ", _whole(away_wins), " wins in their last 10 games")),
        F.when(c["home_rest"] > c["away_rest"] + 1, _text(
            c["home"], " has ", _whole(c["home_rest"]), " days rest vs ", c["away"], "'s ", _whole(c["away_rest"]),
            " -- significant rest advantage")),
        F.when(c["edge"] > 0.10, _text(
            "Model edge of ", percent(c["edge"]), " -- significantly above our threshold for value bets")),
        F.when(c["net_gap"] > 5.0, _text(
            c["home"], " outperforms ", c["away"], " by ", formatted(c["net_gap"], "%.1f"),
            " points per 100 possessions in net rating")),
        F.when(c["expected_gap"] > 0.10, F.coalesce(
            _text("Pythagorean win% gap favors ", c["home"], " (", percent(c["home_expected"]), " vs ",
                  percent(c["away_expected"]), ")"),
            _text("Pythagorean win% gap favors ", c["home"], " by ", percent(c["expected_gap"])))),
    ))
    projection = _text("Model projects ", c["home"], " as ", percent(c["p_home"]), " favorites -- market implies ", implied)
    form = F.coalesce(
        _text("Recent form: ", c["home"], " ", _whole(home_wins), "-", _whole(10 - home_wins), " L10 vs ", c["away"],
              " ", _whole(away_wins), "-", _whole(10 - away_wins), " L10"),
        _text("Matchup analysis points to ", F.when(c["p_home"] >= 0.5, c["home"]).otherwise(c["away"]),
              " as the stronger side"),
    )
    found = F.slice(rules, 1, limit)
    return (
        F.when(F.size(found) == 0, F.array(projection, form))
        .when(F.size(found) == 1, F.array_append(found, form))
        .otherwise(found)
    )


def one_liner(c: Mapping[str, Column], on_home: Column) -> Column:
    """One sentence on the recommended side; uses ``home away p_home market margin spread``.

    ``market`` is the market's probability for the recommended side.
    """
    name = F.when(on_home, c["home"]).otherwise(c["away"])
    model = percent(F.when(on_home, c["p_home"]).otherwise(1 - c["p_home"]))
    by_line = probability_from_spread(c["spread"])
    by_line = percent(F.when(on_home, by_line).otherwise(1 - by_line))
    suffix = F.coalesce(
        _text(" (model projects home win by ", formatted(F.abs(c["margin"]), "%.1f"), ")"),
        _text(" (line: ", signed(c["spread"]), ")"),
        F.lit(""),
    )
    return F.coalesce(
        _text(name, " is undervalued -- books give them ", percent(c["market"]), " but our model says ", model, suffix),
        _text(name, " is undervalued -- books imply ", by_line, " but our model says ", model, suffix),
        _text("Model projects ", name, " to win with ", model, " probability", suffix),
    )


def confidence_text(c: Mapping[str, Column], on_home: Column) -> Column:
    """Why the model is as sure as it is; uses ``home away p_home tier net_gap expected_gap home_form away_form``."""
    name = F.when(on_home, c["home"]).otherwise(c["away"])
    sure = F.when(on_home, c["p_home"]).otherwise(1 - c["p_home"])
    base = _text("Model favors ", name, " with ", percent(sure, 0), " confidence")
    home_wins, away_wins = F.bround(c["home_form"] * 10), F.bround(c["away_form"] * 10)
    drivers = F.slice(F.array_compact(F.array(
        F.when(F.abs(c["net_gap"]) >= 2.0, _text(
            "net rating ", F.when(c["net_gap"] > 0, "advantage").otherwise("disadvantage"), " of ",
            signed(c["net_gap"]), " pts/100")),
        F.when(F.abs(c["expected_gap"]) >= 0.05, _text("pythagorean win% gap ", signed(c["expected_gap"] * 100), "%")),
        _text("recent form ", _whole(home_wins), "-", _whole(10 - home_wins), " vs ", _whole(away_wins), "-",
              _whole(10 - away_wins), " (L10)"),
    )), 1, 2)
    return F.when(F.size(drivers) > 0, _text(base, " based on ", F.array_join(drivers, "; "))).otherwise(
        _text(base, " (", F.lower(c["tier"]), " confidence)")
    )


# Text of each situation flag, with the side it names, in order.
_FLAG_TEXTS = {
    "HOME_B2B": ("home", " on back-to-back (fatigue risk)"),
    "AWAY_B2B": ("away", " on back-to-back (fatigue risk)"),
    "REST_ADV_HOME": ("home", " has rest advantage"),
    "REST_ADV_AWAY": ("away", " has rest advantage"),
    "HOME_HOT": ("home", " is hot (5+ of last 7)"),
    "AWAY_HOT": ("away", " is hot (5+ of last 7)"),
    "HOME_COLD": ("home", " is cold (2 or fewer of last 7)"),
    "AWAY_COLD": ("away", " is cold (2 or fewer of last 7)"),
    "INJ_IMPACT_HOME": ("home", " missing key player(s)"),
    "INJ_IMPACT_AWAY": ("away", " missing key player(s)"),
}


def factors(c: Mapping[str, Column]) -> Column:
    """Prediction factors; uses ``home away winner confidence flags home_streak away_streak home_rate away_rate margin edge``.

    ``confidence`` is a whole percentage, ``flags`` the array of situation
    flags, ``edge`` is NULL unless the pick is a value bet.
    """
    sure = _whole(c["confidence"])
    strength = (
        F.when(c["confidence"] >= 80, _text("Strong model confidence (", sure, "%) favoring ", c["winner"]))
        .when(c["confidence"] >= 65, _text("Moderate model confidence (", sure, "%) favoring ", c["winner"]))
        .when(c["confidence"] > 50, _text("Slight edge (", sure, "%) favoring ", c["winner"]))
    )
    flagged = [
        F.when(F.array_contains(c["flags"], flag), _text(c[side], text)) for flag, (side, text) in _FLAG_TEXTS.items()
    ]

    def run(side: str, place: str) -> Column:
        value = c[f"{side}_streak"]
        length = _whole(F.abs(value))
        return F.when(value >= 4, _text(c[side], " on ", length, f"-game {place} win streak")).when(
            value <= -4, _text(c[side], " on ", length, f"-game {place} losing streak")
        )

    home_better = c["home_rate"] > c["away_rate"]
    rounded = lambda rate: _whole(F.bround(rate * 100))
    record = F.when(F.abs(c["home_rate"] - c["away_rate"]) >= 0.2, _text(
        "Significant record gap: ", F.when(home_better, c["home"]).otherwise(c["away"]), " (",
        rounded(F.greatest(c["home_rate"], c["away_rate"])), "%) vs ",
        F.when(home_better, c["away"]).otherwise(c["home"]), " (",
        rounded(F.least(c["home_rate"], c["away_rate"])), "%)"))
    margin = F.when(F.abs(c["margin"]) >= 8, _text("Model projects decisive margin (", signed(c["margin"]), " pts)")).when(
        F.abs(c["margin"]) <= 3, _text("Model projects a tight game (", signed(c["margin"]), " pts)")
    )
    value = _text("Value bet detected (edge: ", percent(c["edge"]), ")")
    return F.array_compact(F.array(strength, *flagged, run("home", "home"), run("away", "road"), record, margin, value))
