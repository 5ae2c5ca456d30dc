"""Window features that go on where they stopped: new rows are computed from a stored state, without the rows before.

The state has one row per entity: the last rows that bounded windows look back to, and the carries of unbounded ones (sums, the
exponential mean with its weight, the run that is under way). A step takes the state and the new rows and gives their features,
the same as a run over all rows, and the next state. Its work grows with the new rows and the entities, not with the history.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators import windows as wn
from duelframe.operators.ordered import EntityLog, entity_log
from duelframe.operators.topk import latest_array
from duelframe.sources.files import changed_since
from duelframe.storage import materialise


@dataclass(frozen=True)
class Resumable:
    """Which features to keep going, per ``entity`` in the total ``order``.

    ``means``: column to windows, as ``lag_mean``. ``decays``: column to spans, as ``ewma``. ``streaks``: name to 0/1 flag, as ``streak``.
    ``records``: flag to (wins, losses, rate), as ``cumulative_record``, started anew when a column of ``within`` changes;
    an entity's rows with one value of ``within`` follow each other. New rows come after the old ones of their entity.
    """

    entity: Sequence[str]
    order: Sequence[str]
    means: Mapping[str, Sequence[int]] = field(default_factory=dict)
    decays: Mapping[str, Sequence[int]] = field(default_factory=dict)
    streaks: Mapping[str, str] = field(default_factory=dict)
    records: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)
    within: Sequence[str] = ()

    @property
    def look_back(self) -> int:
        return max((w for ws in self.means.values() for w in ws), default=1)

    @property
    def features(self) -> list[str]:
        return [
            *[f"{c}_roll{w}" for c, ws in self.means.items() for w in ws], *[f"{c}_ewma{s}" for c, spans in self.decays.items() for s in spans],
            *self.streaks, *[n for names in self.records.values() for n in names],
        ]

    @property
    def carries(self) -> list[str]:
        """Columns of the state beside the key and the last rows."""
        decays = [f"{kind}_{c}{s}" for c, spans in self.decays.items() for s in spans for kind in ("__mean", "__weight")]
        records = [f"__{kind}_{flag}" for flag in self.records for kind in ("won", "lost")]
        return [*decays, *[f"__run_{name}" for name in self.streaks], *records, *[f"__in_{c}" for c in self.within]]


def _same_entity(spec: Resumable, prefix: str) -> Column:
    match = F.lit(True)
    for c in spec.entity:
        match = match & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return match


def _with_carries(spec: Resumable, rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """The new rows, each with the carries of its entity under names that begin with ``__old``."""
    if state is None:
        nothing = {f"__old{c}": F.lit(None).cast("double") for c in spec.carries if not c.startswith("__in_")}
        return rows.withColumns(nothing | {f"__old__in_{c}": F.lit(None).cast(rows.schema[c].dataType) for c in spec.within} | {"__known": F.lit(None).cast("boolean")})
    kept = state.select(
        *[F.col(c).alias(f"__key_{c}") for c in spec.entity], *[F.col(c).alias(f"__old{c}") for c in spec.carries], F.lit(True).alias("__known")
    )
    return rows.join(kept, _same_entity(spec, "__key_"), "left").drop(*[f"__key_{c}" for c in spec.entity])


def _decayed(spec: Resumable, log: EntityLog) -> EntityLog:
    """Exponential means before each row, and mean and weight after it: sums of the own chunk and of the one before, which for the first chunk is the carry."""
    for c, spans in spec.decays.items():
        for span in spans:
            keep, size = 1 - 2 / (span + 1), wn.ewma_rows(span)
            old_mean, old_weight = F.col(f"__old__mean_{c}{span}"), F.coalesce(f"__old__weight_{c}{span}", F.lit(0.0))
            position = F.col("__n") % size
            grow = F.pow(F.lit(keep), -position)

            def build(_, c=c, keep=keep, size=size, position=position, grow=grow, old_mean=old_mean, old_weight=old_weight):
                own = log.window("__chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
                earlier = Window.partitionBy(*log.keys).orderBy("__chunk").rangeBetween(-1, -1)

                def total(value: Column, carry: Column) -> Column:
                    here = F.sum(value).over(own) * F.pow(F.lit(keep), position)
                    there = F.coalesce(F.sum(value).over(earlier), F.lit(0.0)) * F.pow(F.lit(keep), position + size)
                    return here + F.when(F.col("__n") < size, carry * F.pow(F.lit(keep), position + 1)).otherwise(there)

                has = F.col(c).isNotNull()
                weight = total(F.when(has, grow), old_weight)
                value = total(F.col(c) * grow, old_weight * F.coalesce(old_mean, F.lit(0.0)))
                return {"__value": F.when(has, F.try_divide(value, weight)), "__heavy": F.when(has, weight)}

            log = log.map(lambda df, size=size: df.withColumn("__chunk", F.floor(F.col("__n") / size)))
            log = log.lagged_log(2 * size, build)
            log = log.running_log({f"{c}_ewma{span}": ("last", F.col("__value"))})
            at = F.when(F.col("__value").isNotNull(), F.struct(F.col("__value").alias("m"), F.col("__heavy").alias("w"), F.col("__n").alias("n")))
            log = log.running_log({"__last": ("last", at)}, include_current=True)
            name = f"{c}_ewma{span}"
            columns = {
                name: F.coalesce(name, old_mean),
                f"__mean_{c}{span}": F.coalesce(F.col("__last.m"), old_mean),
                f"__weight_{c}{span}": F.coalesce(
                    F.col("__last.w") * F.pow(F.lit(keep), F.col("__n") - F.col("__last.n")), old_weight * F.pow(F.lit(keep), F.col("__n") + 1)
                ),
            }
            log = log.map(lambda df, columns=columns: df.withColumns(columns).drop("__value", "__heavy", "__chunk", "__last"))
    return log


def _streaks(spec: Resumable, log: EntityLog) -> EntityLog:
    for name, flag in spec.streaks.items():
        run, old = F.col("__local"), F.col(f"__old__run_{name}")
        goes_on = (F.abs(run) == F.col("__n") + 1) & (F.signum(run) == F.signum(old))
        log = _runs(log, flag).map(lambda df, c=F.when(goes_on, run + old).otherwise(run), n=name: df.withColumn(f"__run_{n}", c.cast("double")).drop("__local"))
        log = log.lagged_log(1, lambda w, n=name, o=old: {n: F.coalesce(F.lag(f"__run_{n}").over(w), o, F.lit(0)).cast("long")})
    return log


def _runs(log: EntityLog, flag: str) -> EntityLog:
    """Run lengths; the name of the row number that is used inside must be free."""
    kept = log.map(lambda df: df.withColumnRenamed("__n", "__nth"))
    return wn.run_lengths(kept, flag, "__local").map(lambda df: df.withColumnRenamed("__nth", "__n"))


def _records(spec: Resumable, df: DataFrame, sized_by: DataFrame) -> DataFrame:
    if not spec.records:
        return df
    log = entity_log(df, [*spec.entity, *spec.within], spec.order, sized_by=sized_by)
    sums = {f"__{kind}_{flag}": ("sum", F.col(flag) if kind == "won" else 1 - F.col(flag)) for flag in spec.records for kind in ("won", "lost")}
    before = log.running_log({f"__before{n}": s for n, s in sums.items()})
    out = before.running_log(sums, include_current=True).result
    same = F.coalesce("__known", F.lit(False))
    for c in spec.within:
        same = same & F.col(c).eqNullSafe(F.col(f"__old__in_{c}"))
    for flag, (wins, losses, rate) in spec.records.items():
        for kind, name in (("won", wins), ("lost", losses)):
            carry = F.when(same, F.col(f"__old__{kind}_{flag}")).otherwise(0)
            out = out.withColumns({name: (F.col(f"__before__{kind}_{flag}") + carry).cast("long"), f"__{kind}_{flag}": (F.col(f"__{kind}_{flag}") + carry).cast("double")})
        played = F.col(wins) + F.col(losses)
        out = out.withColumn(rate, F.coalesce(F.try_divide(F.col(wins), played), F.lit(0.5)))
    return out.withColumns({f"__in_{c}": F.col(c) for c in spec.within})


def _means(spec: Resumable, df: DataFrame, state: DataFrame | None) -> DataFrame:
    if not spec.means:
        return df
    both = df.withColumn("__old", F.lit(False))
    if state is not None:
        old = state.select(*spec.entity, F.inline("__tail")).withColumn("__old", F.lit(True))
        both = both.unionByName(old, allowMissingColumns=True)
    log = entity_log(both, spec.entity, spec.order)
    named = lambda w: {f"{c}_roll{n}": F.avg(c).over(w.rowsBetween(-n, -1)) for c, ns in spec.means.items() for n in ns}
    return log.lagged(spec.look_back, named).where(~F.col("__old")).drop("__old")


def step(spec: Resumable, rows: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Features of the new ``rows`` next to their columns, and the state after them. Without a state the rows are the first.

    A NULL key is an entity. Entities without new rows keep their state. No rows give no features and the same state.
    """
    log = entity_log(_with_carries(spec, rows, state), spec.entity, spec.order, sized_by=rows).numbered_log("__n", start=0)
    done = _records(spec, _streaks(spec, _decayed(spec, log)).result.drop("__n"), rows)
    done = materialise(_means(spec, done, state).select(*rows.columns, *spec.features, *spec.carries), "resumed")
    return done.select(*rows.columns, *spec.features), _next_state(spec, done, state)


def _next_state(spec: Resumable, done: DataFrame, state: DataFrame | None) -> DataFrame:
    values = [*spec.order, *spec.means]
    latest = done.groupBy(*spec.entity).agg(F.max_by(F.struct(F.lit(1).alias("__one"), *spec.carries), F.struct(*spec.order)).alias("__c"))
    carried = latest.select(*spec.entity, *[F.col(f"__c.{c}").alias(c) for c in spec.carries])
    rows = done.select(*spec.entity, *values)
    if state is not None:
        rows = rows.unionByName(state.select(*spec.entity, F.inline("__tail")))
    tails = latest_array(rows, list(spec.entity), list(spec.order), values, spec.look_back, "__tail")
    named = tails.select(*[F.col(c).alias(f"__key_{c}") for c in spec.entity], "__tail")
    new = carried.join(named, _same_entity(spec, "__key_")).drop(*[f"__key_{c}" for c in spec.entity])
    if state is not None:
        keys = carried.select(*[F.col(c).alias(f"__key_{c}") for c in spec.entity])
        new = new.unionByName(state.join(keys, _same_entity(spec, "__key_"), "left_anti"))
    return materialise(new, "resumable-state")


def late_rows(spec: Resumable, rows: DataFrame, state: DataFrame) -> DataFrame:
    """New rows that do not come after the old ones of their entity; a step would misplace them."""
    newest = F.array_max(F.transform("__tail", lambda x: F.struct(*[x[c].alias(c) for c in spec.order])))
    last = state.select(*[F.col(c).alias(f"__key_{c}") for c in spec.entity], newest.alias("__newest"))
    return rows.join(last, _same_entity(spec, "__key_")).where(F.struct(*spec.order) <= F.col("__newest")).select(*rows.columns)


def resume(spec: Resumable, source: DataFrame, root: str) -> int:
    """One run over the files of ``source`` that are newer than those of the runs before; returns the number of the run.

    ``root`` gets the new rows with their features in ``features/resumed=n``, the state in ``state/resumed=n``, and last of all a line in ``runs``. A run
    that was lost before that line is done again into the same folders. Late rows are an error: nothing is written.
    """
    spark = source.sparkSession
    try:
        last = spark.read.schema("run int, until timestamp").parquet(f"{root}/runs").orderBy(F.desc("run")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    state = None
    rows = source
    if last is not None:
        state = spark.read.parquet(f"{root}/state/resumed={last['run']}")
        rows = changed_since(source, F.lit(last["until"]))
    rows = materialise(rows.withColumn("__written", F.col("_metadata.file_modification_time")), "new-rows")
    until = rows.agg(F.max("__written")).first()[0]
    if until is None:
        return last["run"] if last else 0
    rows = rows.drop("__written")
    if state is not None and late_rows(spec, rows, state).limit(1).count():
        raise ValueError("rows that come before known ones of their entity need a run over all rows")
    run = last["run"] + 1 if last else 1
    features, following = step(spec, rows, state)
    features.write.mode("overwrite").parquet(f"{root}/features/resumed={run}")
    following.write.mode("overwrite").parquet(f"{root}/state/resumed={run}")
    spark.createDataFrame([(run, until)], "run int, until timestamp").coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return run
