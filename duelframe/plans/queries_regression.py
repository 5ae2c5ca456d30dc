"""Ridge lines of walk-forward folds and quantile planes, with a second solution of the normal equations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators import linear, windows as wn
from duelframe.operators.ordered import entity_log
from duelframe.operators.sets import union_by_name
from duelframe.plans import features as ft
from duelframe.plans.queries_models import PLAYER, PROP_STATS
from duelframe.plans.queries_windows import rows
from duelframe.plans.registry import SHARED_SQL, query
from duelframe.plans.shapes import Shapes
from duelframe.storage import materialise

FORM = ("pts_roll5", "pts_roll20", "reb_roll5", "ast_roll5", "minutes_roll20", "minutes_roll5")
TARGETS = ("pts", "reb", "ast")
# Players have 15 games on average here, so 8 earlier ones are enough to train on, where the operator asks for 20.
PENALTY, MIN_TRAIN, MIN_ROWS, MIN_GAMES = 0.1, 3, 100, 8


def player_form(s: Shapes) -> DataFrame:
    """Players' rolling means before each game, which a first game does not have, and the game's statistics."""
    log = entity_log(s.player_log(), ["player"], ["game_date", "game"])
    rolled = wn.lag_mean(log, ["pts", "reb", "ast", "minutes"], [5, 20]).result
    return materialise(rolled.select("player", "season", *FORM, *TARGETS), "player-form")


_P = "OVER (PARTITION BY player ORDER BY game_date, game"
SHARED_SQL["player_form"] = "SELECT player, season, " + ", ".join(TARGETS) + ", " + ", ".join(
    f"avg({c.split('_roll')[0]}) {_P} {rows(int(c.split('_roll')[1]))}) AS {c}" for c in FORM
) + " FROM player_log"


def _ridge_ctes(target: str) -> str:
    """Folds as copies of their rows, imputation and scaling by fold, then Gauss-Jordan elimination, one column per recursion."""
    p = range(len(FORM))
    z = lambda t: [f"(coalesce({t}{c}, m{i}) - m{i}) / s{i}" for i, c in enumerate(FORM)]
    n = len(FORM)
    inner = ", ".join(
        "[" + ", ".join([f"avg(z{i} * z{j})" + (f" + {PENALTY}" if i == j else "") for j in p] + [f"avg(z{i} * (y - label_mean))"]) + "]" for i in p
    )
    return f"""folds AS (SELECT season AS t FROM (SELECT season, row_number() OVER (ORDER BY season) AS n FROM (SELECT DISTINCT season FROM player_form)) WHERE n > {MIN_TRAIN}),
  train AS (SELECT * FROM (SELECT t, f.*, {target} AS y, count(*) OVER (PARTITION BY t, player) AS games FROM folds JOIN player_form f ON f.season < t)
    WHERE games >= {MIN_GAMES} AND y IS NOT NULL),
  means AS (SELECT t, count(*) AS n_train, avg(y) AS label_mean, {", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(FORM))} FROM train GROUP BY t),
  scales AS (SELECT t, any_value(n_train) AS n_train, any_value(label_mean) AS label_mean, {", ".join(f"any_value(m{i}) AS m{i}, stddev_pop(coalesce({c}, m{i})) AS s{i}" for i, c in enumerate(FORM))}
    FROM train JOIN means USING (t) GROUP BY t),
  scaled AS (SELECT t, y, label_mean, {", ".join(f"{e} AS z{i}" for i, e in enumerate(z("")))} FROM train JOIN scales USING (t)),
  solve AS (SELECT t, 1 AS k, [{inner}] AS m FROM scaled GROUP BY t
    UNION ALL SELECT t, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / m[k][k])
      ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END) FROM solve WHERE k <= {n}),
  solved AS (SELECT t, list_transform(m, lambda row: row[{n + 1}]) AS b FROM solve WHERE k = {n + 1})"""


def _walk_sql(target: str) -> str:
    line = "label_mean + " + " + ".join(f"b[{i + 1}] * (coalesce({c}, m{i}) - m{i}) / s{i}" for i, c in enumerate(FORM))
    return f"""SELECT '{target}' AS stat, t AS season, n_train, count(*) AS n_test, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(o)) AS baseline_mae, avg(abs(o)) - avg(abs(e)) AS gain
    FROM (WITH RECURSIVE {_ridge_ctes(target)} SELECT t, n_train, {line} - {target} AS e, label_mean - {target} AS o
      FROM player_form f JOIN scales ON t = f.season JOIN solved USING (t) WHERE {target} IS NOT NULL) GROUP BY ALL HAVING count(*) >= {MIN_ROWS}"""


@query(
    "ml_walk_forward_regression",
    "stat:s season:l n_train:l n_test:l mae:f6 rmse:f6 baseline_mae:f6 gain:f6",
    " UNION ALL ".join(f"SELECT * FROM ({_walk_sql(t)})" for t in TARGETS),
)
def walk_forward_regression(s: Shapes) -> DataFrame:
    df = player_form(s)
    return union_by_name([
        linear.walk_forward_regression(df, FORM, t, "season", "player", MIN_TRAIN, MIN_ROWS, MIN_GAMES, PENALTY).withColumn("stat", F.lit(t)) for t in TARGETS
    ])


@query(
    "ml_ridge_by_season",
    "season:l feature:s coefficient:f6",
    f"""WITH RECURSIVE {_ridge_ctes("pts")},
  slopes AS (SELECT t AS season, unnest([{", ".join(f"'{c}'" for c in FORM)}]) AS feature, unnest([{", ".join(f"b[{i + 1}] / s{i}" for i in range(len(FORM)))}]) AS coefficient
    FROM scales JOIN solved USING (t))
  SELECT * FROM slopes UNION ALL
  SELECT t, 'intercept', label_mean - {" - ".join(f"b[{i + 1}] / s{i} * m{i}" for i in range(len(FORM)))} FROM scales JOIN solved USING (t)""",
)
def ridge_by_season(s: Shapes) -> DataFrame:
    df = player_form(s)
    return linear.coefficient_table(df, linear.fold_lines(df, FORM, "pts", "season", "player", MIN_TRAIN, MIN_GAMES, PENALTY))


@query(
    "ml_attributions",
    "season:l feature:s mean_abs:f6 n:l exact:i",
    f"""WITH RECURSIVE {_ridge_ctes("pts")}
  SELECT season, feature, avg(abs(part)) AS mean_abs, count(*) AS n, 1 AS exact FROM
    (SELECT season, unnest([{", ".join(f"'{c}'" for c in FORM)}]) AS feature,
      unnest([{", ".join(f"b[{i + 1}] * (coalesce({c}, m{i}) - m{i}) / s{i}" for i, c in enumerate(FORM))}]) AS part
     FROM player_form JOIN scales ON t = season JOIN solved USING (t)) GROUP BY season, feature""",
)
def attributions(s: Shapes) -> DataFrame:
    """Each season's rows, explained by the line of the seasons before; ``exact`` says that base and parts sum to every prediction."""
    df = player_form(s)
    parts = []
    for season, line in linear.fold_lines(df, FORM, "pts", "season", "player", MIN_TRAIN, MIN_GAMES, PENALTY).items():
        rows = df.where(F.col("season") == season).withColumns({"contributions": line.contributions(), "predicted": line.column()})
        gap = F.aggregate("contributions", F.lit(line.label_mean), lambda total, c: total + c) - F.col("predicted")
        named = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in FORM]).alias("feature"), F.col("contributions").alias("part"))).alias("x")
        long = rows.select((F.abs(gap) <= 1e-9).cast("int").alias("exact"), named).select("exact", "x.*")
        parts.append(long.groupBy("feature").agg(
            F.avg(F.abs("part")).alias("mean_abs"), F.count(F.lit(1)).alias("n"), F.min("exact").alias("exact")).withColumn("season", F.lit(season)))
    return union_by_name(parts)


def prop_rates(s: Shapes) -> DataFrame:
    """Form before each game, minutes and per-36 rates of the game."""
    found = ft.prop_features(s.player_log())
    names = [*PLAYER, "minutes", *[f"{c}_per36" for c in PROP_STATS]]
    return materialise(found.select("player", "game", "season", *[F.col(c).cast("double").alias(c) for c in names]), "prop-rates")


@query("ml_quantile_band", "player:l game:l stat:s pred_minutes:f6 p25:f6 p50:f6 p75:f6")
def quantile_band(s: Shapes) -> DataFrame:
    """Per statistic: quantiles of the per-36 rate by the pinball loss, times the predicted minutes."""
    df = prop_rates(s)
    last = df.agg(F.max("season")).first()[0]
    known, held = df.where(F.col("season") < last), df.where(F.col("season") == last)
    played = known.where("minutes > 0")
    minutes = linear.ridge(linear.moments(played, PLAYER, "minutes", F.lit(0))[0], PLAYER, PENALTY)
    expected = F.greatest(F.lit(0.0), F.least(F.lit(48.0), minutes.column()))
    parts = []
    fitted = linear.fit_quantiles_all(played, PLAYER, [f"{stat}_per36" for stat in PROP_STATS])
    for stat in PROP_STATS:
        planes = fitted[f"{stat}_per36"]
        scaled = {n: F.greatest(c, F.lit(0.0)) * F.col("pred_minutes") / 36 for n, c in planes.columns(["p25", "p50", "p75"]).items()}
        parts.append(held.withColumn("pred_minutes", expected).withColumns(scaled).select("player", "game", F.lit(stat).alias("stat"), "pred_minutes", *scaled))
    return union_by_name(parts)
