"""Betting-market arithmetic: odds, probabilities, stakes and confidence tiers."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest edge of each tier, best first, and the margin below which models always agree.
TIERS = {"Best Bet": 0.08, "Solid Pick": 0.04, "Lean": 0.02}
MARGIN_DEAD_ZONE = 1.5
RESIDUAL_STD = 10.5

# Blend weights (win probability, cover probability, margin signal) per regime.
REGIMES = {
    "high_confidence": (0.75, 0.0, 0.25),
    "default": (0.65, 0.0, 0.35),
    "uncertain": (0.55, 0.0, 0.45),
}


def decimal_odds(american: Column) -> Column:
    """Decimal from American odds; 0 is not a quote and gives NULL."""
    return F.when(american >= 100, american / 100 + 1).when(american != 0, 100 / F.abs(american) + 1)


def implied_probability(american: Column) -> Column:
    """Probability in an American quote, margin of the bookmaker included."""
    size = F.abs(american)
    return F.when(american >= 100, 100 / (american + 100)).when(american != 0, size / (size + 100))


def no_vig(home: Column, away: Column) -> tuple[Column, Column]:
    """Both implied probabilities scaled to sum 1; NULL if a quote is missing."""
    p, q = implied_probability(home), implied_probability(away)
    return p / (p + q), q / (p + q)


def expected_value(model: Column, market: Column) -> Column:
    return F.when(market > 0, model / market - 1)


def kelly(model_home: Column, market_home: Column, on_home: Column, scale: float = 0.5, cap: float | None = 0.05) -> Column:
    """Fraction of the bankroll to stake; 0 without an edge or without a usable market price."""
    p = F.when(on_home, model_home).otherwise(1 - model_home)
    q = F.when(on_home, market_home).otherwise(1 - market_home)
    usable = (q > 0) & (q < 1)
    payout = F.when(usable, (1 - q) / q)
    stake = F.greatest(F.lit(0.0), scale * (p * payout - (1 - p)) / payout)
    if cap is not None:
        stake = F.least(stake, F.lit(cap))
    return F.coalesce(F.when(usable, stake), F.lit(0.0))


def tier(edge: Column, agree: Column) -> Column:
    """Confidence tier of an absolute edge; ``Skip`` if the models disagree."""
    ranked = reduce(lambda chain, item: chain.when(edge >= item[1], item[0]), TIERS.items(), F.when(~agree, "Skip"))
    return ranked.otherwise("Skip")


def tier_without_odds(home_prob: Column, agree: Column) -> Column:
    """Tier from the model alone, at most ``Solid Pick``."""
    favourite = F.greatest(home_prob, 1 - home_prob)
    return (
        F.when((favourite >= 0.72) & agree, "Solid Pick")
        .when(favourite >= 0.60, "Lean")
        .otherwise("Skip")
    )


def models_agree(win_prob: Column, margin: Column, dead_zone: float = MARGIN_DEAD_ZONE) -> Column:
    return (F.abs(margin) < dead_zone) | ((win_prob > 0.5) == (margin > 0))


def value_flags(model: Column, market: Column, threshold: float = 0.03) -> dict[str, Column]:
    """Edge, magnitude, flag, side, expected value and tier of a model against a market."""
    edge = model - market
    return {
        "edge": edge,
        "edge_magnitude": F.abs(edge),
        "is_value_bet": (F.abs(edge) > threshold).cast("int"),
        "bet_side": F.when(edge > 0, "home").otherwise("away"),
        "ev": expected_value(model, market),
        "confidence_tier": tier(F.abs(edge), F.lit(True)),
    }


def moneyline(win_prob: Column, margin: Column, home_ml: Column, away_ml: Column) -> dict[str, Column]:
    """Market row of a win bet."""
    market, _ = no_vig(home_ml, away_ml)
    edge = F.coalesce(win_prob - market, F.lit(0.0))
    agree = models_agree(win_prob, margin)
    return {
        "prob": win_prob,
        "edge": edge,
        "ev": expected_value(win_prob, market),
        "models_agree": agree.cast("int"),
        "confidence_tier": tier(F.abs(edge), agree),
    }


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a rational polynomial, error below 1.5e-7."""
    # Coefficients of Abramowitz and Stegun 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * z)
    poly = reduce(lambda acc, c: acc * t + F.lit(c), reversed(a[:-1]), F.lit(a[-1]))
    erf = 1 - poly * t * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def cover_probability(margin: Column, line: Column, std: float = RESIDUAL_STD) -> Column:
    return normal_cdf((margin - line) / std)


def over_probability(p25: Column, p50: Column, p75: Column, line: Column) -> Column:
    """Probability of going over a line, from three quantiles; the spread is at least 3."""
    width = F.greatest(p75 - p25, F.lit(3.0))
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 + (p50 - line) / width))


def home_covers(result: Column, favourite: Column) -> Column:
    """1 if the home side beat the line; ``result`` 1 favourite, 0 underdog, 2 push (NULL)."""
    winner = F.when(favourite == "home", 1).otherwise(0)
    return F.when(result != 2, (result == winner).cast("int"))


def closing_line_value(opening: Column, closing: Column, side: Column) -> Column:
    """Points gained against the closing line on the side of the bet, 0 if unknown."""
    move = F.when(side == "home", opening - closing).otherwise(closing - opening)
    return F.coalesce(move, F.lit(0.0))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def blend(win_prob: Column, cover_prob: Column, margin: Column, regimes: Mapping[str, tuple] = REGIMES, scale: float = 15.0) -> dict[str, Column]:
    """Weighted score whose weights depend on how sure the win model is."""
    signal = logistic(margin / scale)
    regime = (
        F.when((win_prob > 0.65) | (win_prob < 0.35), "high_confidence")
        .when(win_prob.between(0.45, 0.55), "uncertain")
        .otherwise("default")
    )
    scores = {
        name: w * win_prob + c * cover_prob + m * signal for name, (w, c, m) in regimes.items()
    }
    score = F.coalesce(*[F.when(regime == name, value) for name, value in scores.items()])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    edge = score - 0.5
    return {
        "margin_signal": signal,
        "ensemble_score": score,
        "ensemble_edge": edge,
        "confidence": F.when(F.abs(edge) > 0.15, "high").when(F.abs(edge) > 0.08, "medium").otherwise("low"),
        "weight_regime": regime,
    }


def lopsided_minutes(minutes: Column, spread: Column, steepness: float = 0.3, midpoint: float = 10.0, reduction: float = 0.25) -> Column:
    """Minutes reduced by the logistic probability of a one-sided game."""
    return minutes * (1 - reduction * logistic(steepness * (F.abs(spread) - midpoint)))


def spread_from_probability(p: Column) -> Column:
    return (0.5 - p) * 33.3


def probability_from_spread(spread: Column) -> Column:
    return logistic(spread / 10)


def proxy_win_probability(rate_gap: Column, margin_gap: Column) -> Column:
    """Win probability from two feature differences, where no model is at hand."""
    return logistic(F.coalesce(rate_gap, F.lit(0.0)) * 2.5 + F.coalesce(margin_gap, F.lit(0.0)) * 0.03)


def paired_strength(rate_a: Column, rate_b: Column, home_advantage: float = 0.60, shrink: float = 0.15) -> Column:
    """Bradley-Terry probability of two win rates with home advantage, shrunk towards one half."""

    def strength(rate: Column) -> Column:
        clipped = F.least(F.greatest(rate, F.lit(0.01)), F.lit(0.99))
        return clipped / (1 - clipped)

    at_home = strength(rate_a) * (home_advantage / (1 - home_advantage))
    return (1 - shrink) * at_home / (at_home + strength(rate_b)) + shrink * 0.5
