"""Model queries. Metrics of fitted models have no SQL twin, but for splits and guards."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.market import no_vig
from duelframe.operators import attribution as at, models as ml, quality
from duelframe.operators.sets import union_by_name
from duelframe.plans import features as ft, queries_features as qf
from duelframe.plans.registry import query
from duelframe.plans.shapes import Shapes
from duelframe.storage import materialise

# Differences of everything known of both sides, and what belongs to the game.
FEATURES = [
    *[f"diff_{c}" for c in (*ft.TEAM_FEATURES, *qf.SIDE_DIMENSIONS)], "matchup_edge", "diff_fatigue", "diff_factors_composite", *ft.NO_CREW,
    "diff_elo", "home_expected", "elo_x_days_rest", "elo_x_is_back_to_back", "elo_x_streak",
]
PLAYER = ["pts_ewma", "minutes_ewma", "usage_rate_ewma", "reb_ewma", "ast_ewma", "fg3m_ewma", "is_b2b", "season_game_num"]
PLAYER_STATS = ["pts", "reb", "ast"]
PROP_STATS = [*PLAYER_STATS, "fg3m"]


_STORED: dict[tuple[str, str], DataFrame] = {}


def contest_table(s: Shapes) -> DataFrame:
    """Contests with every feature known before the game and their outcome, stored once per session and folder: several models train on it."""
    key = (s.spark.sparkContext.applicationId, s.folder)
    if key not in _STORED:
        games = s.contest().select("game", "game_date", "home", "away", (F.col("home_pts") - F.col("away_pts")).cast("double").alias("margin"))
        quoted = games.join(s.odds(), ["game_date", "home", "away"]).select("game", "margin", "home_ml", "away_ml", "spread", F.lit(1).alias("quoted"))
        wide = qf.full_contests(s, quoted).filter("quoted = 1")
        market, _ = no_vig(F.col("home_ml"), F.col("away_ml"))
        covers = F.when(F.col("margin") != F.col("spread"), (F.col("margin") > F.col("spread")).cast("double"))
        _STORED[key] = materialise(wide.select(
            "game", "season", *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("home_win").cast("double").alias("label"), "margin",
            covers.alias("covers"), market.alias("market_home"),
        ), "contests", once=True)
    return _STORED[key]


def player_table(s: Shapes) -> DataFrame:
    rows = ft.prop_features(s.player_log())
    return materialise(rows.select(
        "player", "game", "season", *[F.col(c).cast("double").alias(c) for c in PLAYER],
        *[F.col(c).cast("double").alias(c) for c in ("minutes", *PROP_STATS, *[f"{stat}_per36" for stat in PROP_STATS])],
    ), "players")


def quick() -> LogisticRegression:
    return LogisticRegression(labelCol="label", featuresCol="features", maxIter=50, regParam=0.01)


@query(
    "ml_season_splits",
    "fold:i season:i role:s",
    """WITH s AS (SELECT season, row_number() OVER (ORDER BY season) AS n FROM (SELECT DISTINCT season FROM contest))
    SELECT f.n - 3 AS fold, s.season, CASE WHEN s.n < f.n THEN 'train' ELSE 'valid' END AS role FROM s JOIN s f ON s.n <= f.n WHERE f.n > 3""",
)
def season_splits(s: Shapes) -> DataFrame:
    return ml.split_membership(s.contest(), "season", 3)


@query(
    "ml_null_rate_guard",
    "column:s null_rate:f6",
    """SELECT 'minutes' AS "column", avg(CAST(minutes IS NULL AS INT)) AS null_rate FROM player_log UNION ALL SELECT 'pts', avg(CAST(pts IS NULL AS INT)) FROM player_log""",
)
def null_rate_guard(s: Shapes) -> DataFrame:
    checked = quality.guard_null_rates(s.player_log(), ["minutes", "pts"])
    return quality.null_rates(checked, ["minutes", "pts"])


def summary(s: Shapes, trained: ml.Trained, held: DataFrame) -> DataFrame:
    """The hold-out metrics next to the validation score of each candidate."""
    scores = F.explode(F.array(*[
        F.struct(F.lit(n).alias("candidate"), F.lit(float(v)).alias("validation"), F.lit(int(n == trained.name)).alias("chosen"))
        for n, v in trained.validation.items()]))
    return held.select("*", scores.alias("c")).select("c.*", *held.columns)


@query("ml_outcome_classifier", "candidate:s validation:f6 chosen:i n:l accuracy:f6 brier:f6 threshold:f2")
def outcome_classifier(s: Shapes) -> DataFrame:
    df = contest_table(s)
    trained = ml.train_outcome(df, FEATURES, "label", "season", candidates=ml.classifiers("label"))
    test = ml.scored(trained.model, df.filter(F.col("season") == trained.test_season))
    held = test.agg(*ml.metric_columns("p", "label", trained.threshold)).withColumn("threshold", F.lit(trained.threshold))
    return summary(s, trained, held)


@query("ml_cover_classifier", "candidate:s validation:f6 chosen:i n:l accuracy:f6 brier:f6 features:i calibrator:s brier_calibrated:f6")
def cover_classifier(s: Shapes) -> DataFrame:
    df = contest_table(s)
    trained, kept, method, calibrate = ml.train_cover(df, FEATURES, "covers", "season")
    test = ml.scored(trained.model, df.filter((F.col("season") == trained.test_season) & F.col("covers").isNotNull()))
    calibrated = F.avg(F.pow(F.col("calibrated") - F.col("covers"), F.lit(2))).alias("brier_calibrated")
    held = calibrate(test.select("p", "covers")).agg(*ml.metric_columns("p", "covers"), calibrated)
    return summary(s, trained, held.withColumns({"features": F.lit(len(kept)), "calibrator": F.lit(method)}))


@query("ml_margin_regressor", "candidate:s validation:f6 chosen:i n:l mae:f6 rmse:f6 residual_std:f6")
def margin_regressor(s: Shapes) -> DataFrame:
    df = contest_table(s)
    trained, residual = ml.train_margin(df, FEATURES, "margin", "season")
    test = trained.model.transform(df.filter(F.col("season") == trained.test_season))
    held = test.agg(*ml.error_columns("prediction", "margin")).withColumn("residual_std", F.lit(residual))
    return summary(s, trained, held)


@query("ml_prune_refit", "features:i kept:i n:l accuracy:f6 brier:f6")
def prune_refit(s: Shapes) -> DataFrame:
    df = contest_table(s)
    seasons = ml.seasons_of(df, "season")
    train, valid = df.filter(F.col("season") < seasons[-1]), df.filter(F.col("season") == seasons[-1])
    boosted = GBTClassifier(labelCol="label", featuresCol="features", maxDepth=3, seed=ml.SEED)
    model, kept = ml.prune_and_refit(train, valid, FEATURES, boosted, "label")
    metrics = ml.scored(model, valid).agg(*ml.metric_columns("p", "label"))
    return metrics.withColumns({"features": F.lit(len(FEATURES)), "kept": F.lit(len(kept))})


@query("ml_player_regressors", "stat:s model:s n:l mae:f6 rmse:f6 baseline_mae:f6")
def player_regressors(s: Shapes) -> DataFrame:
    """Errors on the last season; a statistic without a model, for want of players with enough rows, has no tested rows."""
    df = player_table(s)
    trained = ml.train_players(df, PLAYER, PLAYER_STATS, "season")
    parts = [
        s.spark.range(1).select(F.lit(stat).alias("stat"), F.lit(None).cast("string").alias("model"), F.lit(0).alias("n"),
                                *[F.lit(None).cast("double").alias(c) for c in ("mae", "rmse", "baseline_mae")])
        for stat in PLAYER_STATS if stat not in trained
    ]
    for stat, t in trained.items():
        test = t.model.transform(df.filter(F.col("season") == t.test_season))
        mean = df.filter(F.col("season") < t.test_season).agg(F.avg(stat)).first()[0]
        baseline = F.avg(F.abs(F.col(stat) - mean)).alias("baseline_mae")
        parts.append(test.agg(*ml.error_columns("prediction", stat), baseline).withColumns({"stat": F.lit(stat), "model": F.lit(t.name)}))
    return union_by_name(parts)


@query("ml_two_stage_props", "player:l game:l pred_minutes:f6 pred_pts:f6 pred_reb:f6 pred_ast:f6 pred_fg3m:f6")
def two_stage_props(s: Shapes) -> DataFrame:
    df = player_table(s)
    last = ml.seasons_of(df, "season")[-1]
    minutes, rates = ml.train_two_stage(df.filter(F.col("season") < last), PLAYER, PROP_STATS)
    return ml.predict_two_stage(minutes, rates, df.filter(F.col("season") == last))


@query("ml_residual_band", "player:l game:l prediction:f6 p25:f6 p50:f6 p75:f6")
def residual_band(s: Shapes) -> DataFrame:
    df = player_table(s)
    last = ml.seasons_of(df, "season")[-1]
    known = df.filter(F.col("season") < last)
    model = ml.fit(known, PLAYER, ml.regressors("pts")["ridge"])
    bands = ml.quantile_band(model.transform(known), "prediction", "pts")
    return ml.with_band(model.transform(df.filter(F.col("season") == last)), "prediction", bands)


@query("ml_calibrate", "method:s n:l accuracy:f6 brier:f6 chosen:i")
def calibrate(s: Shapes) -> DataFrame:
    df = contest_table(s)
    *train, held, test = ml.seasons_of(df, "season")
    model = ml.fit(df.filter(F.col("season").isin(train)), FEATURES, quick())
    score = lambda season: ml.scored(model, df.filter(F.col("season") == season)).select("game", "label", "p")
    rows = materialise(score(held), "calibration-season")
    methods, (best, _) = ml.calibrators(rows, "p", "label"), ml.chosen_calibrator(rows, "p", "label")
    tested = materialise(score(test), "test-season")
    return union_by_name([
        apply(tested).agg(*ml.metric_columns("calibrated", "label")).withColumns({"method": F.lit(name), "chosen": F.lit(int(name == best))})
        for name, apply in methods.items()
    ])


@query("ml_walk_forward", "season:i train_seasons:i n:l accuracy:f6 auc:f6 brier:f6")
def walk_forward(s: Shapes) -> DataFrame:
    return ml.walk_forward(contest_table(s), FEATURES, "label", "season", quick())


@query("ml_batch_score", "game:l season:i edge:f6 bet_side:s ev:f6 confidence_tier:s")
def batch_score(s: Shapes) -> DataFrame:
    df = contest_table(s)
    last = ml.seasons_of(df, "season")[-1]
    model = ml.fit(df.filter(F.col("season") < last), FEATURES, quick())
    return ml.value_scan(model, df, "market_home", 0.05)


@query("ml_strong_bets", "game:l season:i edge:f6 bet_side:s composite_score:f6 p_cover:f6 passes_cover:i")
def strong_bets(s: Shapes) -> DataFrame:
    """The last season's bets that the cover model, calibrated on a season of its own, lets through."""
    df = contest_table(s)
    last = ml.seasons_of(df, "season")[-1]
    model = ml.fit(df.filter(F.col("season") < last), FEATURES, quick())
    trained, _, _, calibrate = ml.train_cover(df, FEATURES, "covers", "season")
    scan = ml.value_scan(model, df.filter(F.col("season") == last), "market_home", 0.05)
    cover = calibrate(ml.scored(trained.model, df.filter(F.col("season") == last)).select("game", "p")).select("game", F.col("calibrated").alias("p_cover"))
    return ml.strong_bets(scan.join(cover, "game", "left"), "edge", "p_cover")


@query("ml_permutation_importance", "feature:s drop:f6 rank:i")
def permutation_importance(s: Shapes) -> DataFrame:
    df = contest_table(s)
    last = ml.seasons_of(df, "season")[-1]
    model = ml.fit(df.filter(F.col("season") < last), FEATURES, quick())
    test = df.filter(F.col("season") == last)
    return ml.permutation_importance(model, test, FEATURES, "label", "game")


@query("ml_tree_attributions", "model:s feature:s mean_abs:f6 rank:i exact:i")
def tree_attributions(s: Shapes) -> DataFrame:
    """The last season's contests explained by boosted trees, a forest and a logistic model; ``exact``: base and parts sum to the model's own score in every row."""
    df = contest_table(s)
    last = ml.seasons_of(df, "season")[-1]
    parts = []
    train = df.filter(F.col("season") < last)
    for name, model in ml.fits(train, FEATURES, ml.classifiers("label", trees=8)).items():
        rows = at.attributed(model, at.scored_margin(model, df.filter(F.col("season") == last)), FEATURES)
        rows = materialise(rows.select("contributions", (F.abs(F.col("explained") - F.col("scored")) > 1e-9).cast("int").alias("off")), "attributed")
        exact = 1 - rows.agg(F.max("off")).first()[0]
        parts.append(at.importance(rows, FEATURES).withColumns({
            "model": F.lit(name), "rank": F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(F.desc("mean_abs"), "feature")), "exact": F.lit(exact)}))
    return union_by_name(parts)


@query(
    "sc_strong_bets",
    "id:l edge_magnitude:f6 composite_score:f6 p_cover:f6 passes_cover:i",
    """SELECT *, 1 AS passes_cover FROM (SELECT id, abs(p_home - market_home) AS edge_magnitude, CASE WHEN id % 5 <> 0 THEN ((id * 29) % 97 + 2) / 101.0 END AS p_cover,
      0.6 * abs(p_home - market_home) AS composite_score FROM priced)
    WHERE edge_magnitude > 0.08 AND composite_score > 0.04 AND coalesce(p_cover, 1) >= 0.53""",
)
def strong_bets_of_all(s: Shapes) -> DataFrame:
    """The gate on all predictions, with a cover probability made of the id that every fifth lacks."""
    from duelframe.functions.market import value_flags
    from duelframe.plans.queries_scalars import with_market

    rows = with_market(s).withColumns(value_flags(F.col("p_home"), F.col("market_home")))
    cover = F.when(F.col("id") % 5 != 0, ((F.col("id") * 29) % 97 + 2) / 101.0)
    return ml.strong_bets(rows.withColumn("p_cover", cover), "edge_magnitude", "p_cover")
