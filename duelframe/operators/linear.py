"""Linear models from sums that merge: one pass gives the normal equations of every season, every walk-forward fold is a
prefix sum of them; quantiles are fitted by Newton steps on a smoothed pinball loss, one sum per step.

A task adds its rows to one vector of sums and emits it once, so what is shuffled does not grow with the rows. What the driver
holds is bounded by the number of features, squared, times the number of seasons.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector_sums(df: DataFrame, add: Callable[[pa.RecordBatch, dict[int, np.ndarray]], None]) -> DataFrame:
    """(key, pos, value): vectors by key, added over all rows of ``df``. ``add`` adds a batch to the vectors of a task; a task emits each vector once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: dict[int, np.ndarray] = {}
        for batch in batches:
            add(batch, vectors)
        if vectors:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(vectors), pa.int64()), pa.array(list(vectors.values()), pa.list_(pa.float64()))], ["key", "vector"]
            )

    parts = df.mapInArrow(work, "key long, vector array<double>")
    return parts.select("key", F.posexplode("vector").alias("pos", "value")).groupBy("key", "pos").agg(F.sum("value").alias("value"))


def summed(df: DataFrame, add: Callable[[pa.RecordBatch, dict[int, np.ndarray]], None]) -> dict[int, np.ndarray]:
    """``vector_sums`` on the driver, for a few vectors of a bounded size."""
    got = vector_sums(df, add).orderBy("key", "pos").toArrow()
    keys, values = got["key"].to_numpy(), got["value"].to_numpy()
    return {int(k): values[keys == k] for k in np.unique(keys)}


def _design(features: Sequence[str], label: str) -> list[Column]:
    return [*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y")]


def _numbers(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch[n].to_numpy(zero_copy_only=False) for n in names]) if names else np.zeros((batch.num_rows, 0))


def moments(df: DataFrame, features: Sequence[str], label: str, key: Column) -> dict[int, np.ndarray]:
    """Sums of products of (features, their missing flags, 1, label), a square matrix per value of the whole-number ``key``, in one pass.

    Rows without a label or key do not count. A missing feature (NULL or NaN) is 0 with a flag, so that any imputation by a constant is a
    linear map of these sums.
    """
    p = len(features)
    size = 2 * p + 2
    upper = np.triu_indices(size)

    def add(batch: pa.RecordBatch, vectors: dict[int, np.ndarray]) -> None:
        x, y = _numbers(batch, [f"x{i}" for i in range(p)]), batch["y"].to_numpy(zero_copy_only=False)
        keys = batch["key"].to_numpy(zero_copy_only=False)
        missing = np.isnan(x)
        z = np.column_stack([np.where(missing, 0.0, x), missing, np.ones(len(y)), y])
        for k in np.unique(keys[~np.isnan(y)]):
            rows = z[(keys == k) & ~np.isnan(y)]
            vectors[int(k)] = vectors.get(int(k), 0.0) + (rows.T @ rows)[upper]

    slim = df.select(key.cast("long").alias("key"), *_design(features, label)).where("key IS NOT NULL")
    out = {}
    for k, packed in summed(slim, add).items():
        square = np.zeros((size, size))
        square[upper] = packed
        out[k] = square + np.triu(square, 1).T
    return out


@dataclass(frozen=True)
class Line:
    """A fitted linear model. A missing feature counts as its mean."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    label_mean: float
    rows: int

    def column(self) -> Column:
        """The prediction."""
        return predicted(self.features, *[F.array(*[F.lit(v) for v in vs]) for vs in (self.means, self.coefficients)], F.lit(self.intercept))

    def contributions(self) -> Column:
        """What each feature adds to the prediction of an average row, the mean label: an array in the order of the features. A missing feature adds 0."""
        parts = [
            F.lit(b) * (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) - F.lit(m))
            for c, m, b in zip(self.features, self.means, self.coefficients, strict=True)
        ]
        return F.array(*parts)


def predicted(features: Sequence[str], means: Column, coefficients: Column, intercept: Column) -> Column:
    """Intercept plus coefficients times features, from array columns."""
    filled = F.zip_with(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in features]), means, lambda x, m: F.coalesce(x, m))
    return F.aggregate(F.zip_with(filled, coefficients, lambda x, b: x * b), intercept, lambda total, v: total + v)


def ridge(gram: np.ndarray, features: Sequence[str], penalty: float) -> Line:
    """Least squares over standardised features plus ``penalty`` times the squared coefficients (per row), from moments.

    Missing values are the mean of the others. A feature that does not vary has coefficient 0.
    """
    p = len(features)
    one, y = 2 * p, 2 * p + 1
    n = gram[one, one]
    present = n - np.diag(gram)[p : 2 * p]
    means = np.divide(gram[:p, one], present, out=np.zeros(p), where=present > 0)
    # the imputed features, 1 and the label are linear in what was summed
    fill = np.zeros((2 * p + 2, p + 2))
    fill[range(p), range(p)] = 1.0
    fill[range(p, 2 * p), range(p)] = means
    fill[one, p] = fill[y, p + 1] = 1.0
    full = fill.T @ gram @ fill / n
    centre = full[p, : p + 2].copy()
    spread = full - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread)[:p], 0.0))
    varies = scale > 1e-9 * (1 + np.abs(means))
    unit = np.where(varies, scale, 1.0)
    inner = spread[:p, :p] / np.outer(unit, unit) + penalty * np.eye(p)
    outer = spread[:p, p + 1] / unit
    solved = np.zeros(p)
    if varies.any():
        solved[varies] = np.linalg.solve(inner[np.ix_(varies, varies)], outer[varies])
    coefficients = solved / unit
    intercept = centre[p + 1] - coefficients @ means
    return Line(tuple(features), tuple(map(float, means)), tuple(map(float, coefficients)), float(intercept), float(centre[p + 1]), int(round(n)))


def entering(df: DataFrame, entity: str, season: str, least: int) -> DataFrame:
    """``df`` with ``__enter``: the season from which on later folds train on the row.

    A fold trains on the earlier seasons' rows of entities that have ``least`` rows there. So a row enters with its own season or
    with the one in which its entity reaches that number. Rows of others, and of no entity, are left out.
    """
    counts = df.where(F.col(entity).isNotNull() & F.col(season).isNotNull()).groupBy(entity, season).agg(F.count(F.lit(1)).alias("__rows"))
    # an entity has one row per season here
    upto = F.sum("__rows").over(Window.partitionBy(entity).orderBy(season))
    reached = counts.withColumn("__upto", upto).where(F.col("__upto") >= least).groupBy(entity).agg(F.min(season).alias("__reached"))
    return df.join(reached, entity).withColumn("__enter", F.greatest(F.col(season), F.col("__reached"))).drop("__reached")


def fold_lines(
    df: DataFrame, features: Sequence[str], label: str, season: str, entity: str | None = None, min_train: int = 3, min_entity_rows: int = 20, penalty: float = 0.1
) -> dict[int, Line]:
    """A line per season, fitted on all earlier ones: prefix sums of the moments of one pass."""
    known = sorted(r[0] for r in df.where(F.col(season).isNotNull()).select(season).distinct().collect())
    rows = df if entity is None else entering(df, entity, season, min_entity_rows)
    found = moments(rows, features, label, F.col(season if entity is None else "__enter"))
    lines, total, entered = {}, None, iter(sorted(found))
    pending = next(entered, None)
    for i, s in enumerate(known):
        while pending is not None and pending < s:
            total = found[pending] if total is None else total + found[pending]
            pending = next(entered, None)
        if i >= min_train and total is not None:
            lines[int(s)] = ridge(total, features, penalty)
    return lines


def walk_forward_regression(
    df: DataFrame, features: Sequence[str], label: str, season: str, entity: str | None = None, min_train: int = 3, min_rows: int = 100,
    min_entity_rows: int = 20, penalty: float = 0.1,
) -> DataFrame:
    """Per season: errors of a ridge line fitted on all earlier seasons, next to those of the mean label.

    (season, n_train, n_test, mae, rmse, baseline_mae, gain). Two passes over the table, whatever the number of folds: one for all fits, one for
    all errors. Seasons with fewer than ``min_train`` seasons before them or ``min_rows`` labelled rows are left out.
    """
    lines = fold_lines(df, features, label, season, entity, min_train, min_entity_rows, penalty)
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(s, line.rows, list(line.means), list(line.coefficients), line.intercept, line.label_mean) for s, line in lines.items()],
        "__season long, n_train long, __means array<double>, __coefficients array<double>, __intercept double, __label_mean double",
    )
    # one row per season
    tested = df.where(F.col(label).isNotNull()).join(F.broadcast(table), F.col(season) == F.col("__season"))
    gap = predicted(features, F.col("__means"), F.col("__coefficients"), F.col("__intercept")) - F.col(label)
    errors = tested.select(F.col(season), "n_train", gap.alias("__gap"), (F.col("__label_mean") - F.col(label)).alias("__off"))
    out = errors.groupBy(season, "n_train").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs("__gap")).alias("mae"),
        F.sqrt(F.avg(F.col("__gap") * F.col("__gap"))).alias("rmse"), F.avg(F.abs("__off")).alias("baseline_mae"),
    )
    return out.where(F.col("n_test") >= min_rows).withColumn("gain", F.col("baseline_mae") - F.col("mae"))


def coefficient_table(df: DataFrame, lines: dict[int, Line]) -> DataFrame:
    """(season, feature, coefficient), the intercept too: a few rows per season."""
    rows = [(s, f, c) for s, line in lines.items() for f, c in [*zip(line.features, line.coefficients, strict=True), ("intercept", line.intercept)]]
    return df.sparkSession.createDataFrame(rows, "season long, feature string, coefficient double")


@dataclass(frozen=True)
class QuantilePlanes:
    """Quantiles that cannot cross: one plane for the level nearest to one half, and softplus of a plane for every gap to the next level."""

    features: tuple[str, ...]
    levels: tuple[float, ...]
    means: tuple[float, ...]
    planes: tuple[tuple[float, ...], ...]
    gap_unit: float

    def columns(self, names: Sequence[str]) -> dict[str, Column]:
        """One column per level."""
        means = F.array(*[F.lit(v) for v in self.means])
        at = [predicted(self.features, means, F.array(*[F.lit(v) for v in plane[:-1]]), F.lit(plane[-1])) for plane in self.planes]
        middle = _middle(self.levels)
        softplus = lambda v: self.gap_unit * (F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v))))
        out = {middle: at[middle]}
        for k in range(middle - 1, -1, -1):
            out[k] = out[k + 1] - softplus(at[k])
        for k in range(middle + 1, len(self.levels)):
            out[k] = out[k - 1] + softplus(at[k])
        return {name: out[k] for k, name in enumerate(names)}


def _middle(levels: Sequence[float]) -> int:
    return min(range(len(levels)), key=lambda k: abs(levels[k] - 0.5))


def pinball_sums(x: np.ndarray, y: np.ndarray, planes: np.ndarray, levels: Sequence[float], width: float) -> np.ndarray:
    """Smoothed pinball loss over all levels, its gradient by the planes, and the upper half of its Gauss-Newton matrix, as one vector.

    The loss at residual u is level * u + width * log(1 + exp(-u / width)), the pinball loss smoothed over ``width``.
    """
    n_levels, middle = len(levels), _middle(levels)
    at = x @ planes.T
    gap = np.logaddexp(0.0, at)
    slope = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
    inside = np.zeros((n_levels, n_levels, len(y)))
    q = np.zeros((n_levels, len(y)))
    for k in range(n_levels):
        q[k] = at[:, middle]
        inside[k, middle] = 1.0
        for j in range(k, middle):
            q[k] -= gap[:, j]
            inside[k, j] = -slope[:, j]
        for j in range(middle + 1, k + 1):
            q[k] += gap[:, j]
            inside[k, j] = slope[:, j]
    u = y - q
    below = 1 / (1 + np.exp(np.clip(u / width, -500, 500)))
    loss = sum((level * u[k] + width * np.logaddexp(0.0, -u[k] / width)).sum() for k, level in enumerate(levels))
    down = below - np.array(levels)[:, None]
    gradient = np.einsum("kn,kjn->jn", down, inside) @ x
    weight = below * (1 - below) / width
    size = x.shape[1]
    curve = np.zeros((n_levels * size, n_levels * size))
    for j in range(n_levels):
        for i in range(j + 1):
            w = (weight * inside[:, i] * inside[:, j]).sum(axis=0)
            curve[i * size : (i + 1) * size, j * size : (j + 1) * size] = x.T @ (x * w[:, None])
    return np.concatenate([[loss], gradient.ravel(), curve[np.triu_indices(len(curve))]])


def descend(sums: Callable[[np.ndarray, float], np.ndarray], planes: np.ndarray, widths: Sequence[float], steps: int = 15) -> np.ndarray:
    """Damped Newton steps at each of the shrinking widths. ``sums`` gives the vector of ``pinball_sums`` over all rows."""
    return descend_all(lambda asked: {k: sums(*a) for k, a in asked.items()}, {0: planes}, widths, steps)[0]


Asked = tuple[np.ndarray, float]


def descend_all(
    sums: Callable[[dict[int, Asked]], dict[int, np.ndarray]], planes: dict[int, np.ndarray], widths: Sequence[float], steps: int = 15
) -> dict[int, np.ndarray]:
    """``descend`` for several problems side by side: ``sums`` gives what all that still go on ask for, at once."""
    runs = {k: _descent(p, widths, steps) for k, p in planes.items()}
    asked = {k: next(run) for k, run in runs.items()}
    done: dict[int, np.ndarray] = {}
    while asked:
        got, following = sums(asked), {}
        for k in asked:
            try:
                following[k] = runs[k].send(got[k])
            except StopIteration as end:
                done[k] = end.value
        asked = following
    return done


def _descent(planes: np.ndarray, widths: Sequence[float], steps: int) -> Generator[Asked, np.ndarray, np.ndarray]:
    m = planes.size
    upper = np.triu_indices(m)
    for width in widths:
        now, damping = (yield planes, width), 1e-3
        for _ in range(steps):
            curve = np.zeros((m, m))
            curve[upper] = now[1 + m :]
            curve += np.triu(curve, 1).T
            heavy = curve + np.diag(damping * np.diag(curve) + 1e-9 * max(now[0], 1.0))
            tried = planes - np.linalg.solve(heavy, now[1 : 1 + m]).reshape(planes.shape)
            then = yield tried, width
            gain = now[0] - then[0]
            if gain > 0:
                planes, now, damping = tried, then, damping / 10
            else:
                damping *= 10
            if abs(gain) <= 1e-7 * abs(now[0]):
                break
    return planes


def fit_quantiles(
    df: DataFrame, features: Sequence[str], label: str, levels: Sequence[float] = (0.25, 0.5, 0.75), widths: Sequence[float] = (0.5, 0.2, 0.1, 0.05)
) -> QuantilePlanes:
    """All quantile levels together, so that they never cross, by the pinball loss smoothed over the last of ``widths`` (in standard deviations of the label).

    Each step is one job that sums a vector of a size fixed by the features and levels. Missing features count as their mean; rows without a label do not count.
    ``df`` should be stored: it is read once per step.
    """
    return fit_quantiles_all(df, features, [label], levels, widths)[label]


def fit_quantiles_all(
    df: DataFrame, features: Sequence[str], labels: Sequence[str], levels: Sequence[float] = (0.25, 0.5, 0.75), widths: Sequence[float] = (0.5, 0.2, 0.1, 0.05)
) -> dict[str, QuantilePlanes]:
    """``fit_quantiles`` for several labels: a step of all of them is one job, and reads ``df`` once."""
    levels = tuple(sorted(levels))
    starts = {k: _start(df, features, label, levels) for k, label in enumerate(labels)}
    p = len(features)
    columns = [*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(labels)]]
    slim = df.select(*columns)

    def sums(asked: dict[int, Asked]) -> dict[int, np.ndarray]:
        def add(batch: pa.RecordBatch, vectors: dict[int, np.ndarray]) -> None:
            x = _numbers(batch, [f"x{i}" for i in range(p)])
            for k, (at, width) in asked.items():
                y, start = batch[f"y{k}"].to_numpy(zero_copy_only=False), starts[k]
                has = ~np.isnan(y)
                if not has.any():
                    continue
                own = (x if has.all() else x[has]) - start.means
                own = np.where(np.isnan(own), 0.0, own / start.scale)
                z = (y[has] - start.label_mean) / start.spread
                vectors[k] = vectors.get(k, 0.0) + pinball_sums(np.column_stack([own, np.ones(len(z))]), z, at, levels, width)

        return summed(slim, add)

    found = descend_all(sums, {k: s.planes for k, s in starts.items()}, widths)
    return {label: _unscaled(starts[k], found[k], features, levels) for k, label in enumerate(labels)}


@dataclass(frozen=True)
class _Start:
    """The planes that a fit of one label begins with, and how its features and label are scaled."""

    planes: np.ndarray
    means: np.ndarray
    scale: np.ndarray
    label_mean: float
    spread: float


def _start(df: DataFrame, features: Sequence[str], label: str, levels: tuple[float, ...]) -> _Start:
    p = len(features)
    gram = moments(df, features, label, F.lit(0)).get(0)
    if gram is None:
        raise ValueError("no row has a label")
    line = ridge(gram, features, 1e-6)
    n = gram[2 * p, 2 * p]
    means = np.array(line.means)
    present = n - np.diag(gram)[p : 2 * p]
    scale = np.sqrt(np.maximum(np.diag(gram)[:p] - present * means**2, 0.0) / n)
    scale = np.where(scale > 1e-9 * (1 + np.abs(means)), scale, np.inf)
    spread = max(float(np.sqrt(max(gram[-1, -1] / n - line.label_mean**2, 0.0))), 1e-12)
    middle = _middle(levels)
    planes = np.zeros((len(levels), p + 1))
    planes[middle, :p] = np.array(line.coefficients) * np.where(np.isinf(scale), 0.0, scale) / spread
    return _Start(planes, means, scale, line.label_mean, spread)


def _unscaled(start: _Start, planes: np.ndarray, features: Sequence[str], levels: tuple[float, ...]) -> QuantilePlanes:
    p, middle = len(features), _middle(levels)
    slopes = planes[:, :p] / start.scale
    base = planes[:, p] - slopes @ start.means
    slopes[middle] = planes[middle, :p] / start.scale * start.spread
    base[middle] = planes[middle, p] * start.spread + start.label_mean - slopes[middle] @ start.means
    raw = tuple((*map(float, s), float(b)) for s, b in zip(slopes, base, strict=True))
    return QuantilePlanes(tuple(features), levels, tuple(map(float, start.means)), raw, start.spread)
