"""Operators as SQL: scalar functions, and table functions that take a table.

    register(spark)
    spark.sql("SELECT * FROM lag_mean(TABLE(log), 'team', 'game_date, game', 'pts, plus_minus', '5, 20')")

Scalar functions are SQL functions made from the same column expressions that the DataFrame operators use, so they are inlined into the plan. A table
function says itself how its table is partitioned and ordered; an entity streams through one task in order and only its last rows are held.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from duelframe.functions import market, measures
from duelframe.functions.geo import great_circle_miles


def _names(argument: AnalyzeArgument, what: str) -> list[str]:
    if not isinstance(argument.value, str) or not argument.value.strip():
        raise ValueError(f"{what} must be a text of names with commas between them")
    return [n.strip() for n in argument.value.split(",")]


def _checked(log: AnalyzeArgument, names: list[str]) -> T.StructType:
    if not log.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    lacking = sorted(set(names) - set(log.dataType.names))
    if lacking:
        raise ValueError(f"the table has no column {', '.join(lacking)}")
    return log.dataType


def _placed(schema: T.StructType, entity: list[str], order: list[str]) -> dict:
    return {
        "schema": schema,
        "partitionBy": [PartitioningColumn(c) for c in entity],
        "orderBy": [OrderingColumn(c, ascending=True, overrideNullsFirst=False) for c in order],
    }


@dataclass
class Windows(AnalyzeResult):
    """What ``LagMean`` was asked for."""

    columns: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)


class LagMean:
    """lag_mean(TABLE(log), entity, order, columns, windows): the log's columns and the mean of the previous rows as ``<column>_roll<n>``, as the operator of that name.

    NULLs do not count and a mean without values is NULL. A NULL entity is an entity; NULLs in the order come last.
    """

    @staticmethod
    def analyze(log: AnalyzeArgument, entity: AnalyzeArgument, order: AnalyzeArgument, columns: AnalyzeArgument, windows: AnalyzeArgument) -> Windows:
        keys, sort, values = _names(entity, "entity"), _names(order, "order"), _names(columns, "columns")
        known = _checked(log, [*keys, *sort, *values])
        sizes = [int(n) for n in _names(windows, "windows")]
        added = [T.StructField(f"{c}_roll{n}", T.DoubleType()) for n in sizes for c in values]
        return Windows(**_placed(T.StructType([*known.fields, *added]), keys, sort), columns=values, sizes=sizes)

    def __init__(self, asked: Windows) -> None:
        self.asked = asked
        self.held = {c: deque(maxlen=max(asked.sizes)) for c in asked.columns}

    def eval(self, row, *_) -> Iterator[tuple]:
        means = []
        for n in self.asked.sizes:
            for c in self.asked.columns:
                past = self.held[c]
                seen = [v for i, v in enumerate(past) if i >= len(past) - n and v is not None]
                means.append(sum(seen) / len(seen) if seen else None)
        yield (*row, *means)
        for c, past in self.held.items():
            past.append(None if row[c] is None else float(row[c]))


@dataclass
class Decays(AnalyzeResult):
    """What ``Ewma`` was asked for."""

    columns: list[str] = field(default_factory=list)
    spans: list[int] = field(default_factory=list)


class Ewma:
    """ewma(TABLE(log), entity, order, columns, spans): the log's columns and exponentially weighted means of the rows before as ``<column>_ewma<span>``.

    A NULL takes up a position but adds nothing.
    """

    @staticmethod
    def analyze(log: AnalyzeArgument, entity: AnalyzeArgument, order: AnalyzeArgument, columns: AnalyzeArgument, spans: AnalyzeArgument) -> Decays:
        keys, sort, values = _names(entity, "entity"), _names(order, "order"), _names(columns, "columns")
        known = _checked(log, [*keys, *sort, *values])
        sizes = [int(n) for n in _names(spans, "spans")]
        added = [T.StructField(f"{c}_ewma{n}", T.DoubleType()) for n in sizes for c in values]
        return Decays(**_placed(T.StructType([*known.fields, *added]), keys, sort), columns=values, spans=sizes)

    def __init__(self, asked: Decays) -> None:
        self.asked = asked
        self.state = {(c, s): (None, 0.0) for s in asked.spans for c in asked.columns}

    def eval(self, row, *_) -> Iterator[tuple]:
        yield (*row, *[mean for mean, _ in self.state.values()])
        for (c, span), (mean, weight) in self.state.items():
            weight *= 1 - 2 / (span + 1)
            value = row[c]
            if value is not None:
                mean = float(value) if mean is None else (mean * weight + float(value)) / (weight + 1)
                weight += 1
            self.state[c, span] = (mean, weight)


TABLE_FUNCTIONS = {"lag_mean": LagMean, "ewma": Ewma}

# name: (arguments, result type, expression of the argument columns)
SCALARS: dict[str, tuple[dict[str, str], str, Callable[..., Column]]] = {
    "decimal_odds": ({"american": "DOUBLE"}, "DOUBLE", market.decimal_odds),
    "implied_probability": ({"american": "DOUBLE"}, "DOUBLE", market.implied_probability),
    "no_vig_home": ({"home_odds": "DOUBLE", "away_odds": "DOUBLE"}, "DOUBLE", lambda home, away: market.no_vig(home, away)[0]),
    "expected_value": ({"model": "DOUBLE", "price": "DOUBLE"}, "DOUBLE", market.expected_value),
    "kelly_stake": ({"model_home": "DOUBLE", "market_home": "DOUBLE", "on_home": "BOOLEAN"}, "DOUBLE", market.kelly),
    "confidence_tier": ({"edge": "DOUBLE", "agree": "BOOLEAN"}, "STRING", market.tier),
    "pythagorean": ({"points": "DOUBLE", "allowed": "DOUBLE"}, "DOUBLE", measures.pythagorean),
    "great_circle_miles": ({"lat_a": "DOUBLE", "lon_a": "DOUBLE", "lat_b": "DOUBLE", "lon_b": "DOUBLE"}, "DOUBLE", great_circle_miles),
}


def _as_sql(spark: SparkSession, arguments: dict[str, str], build: Callable[..., Column]) -> str:
    """The text of an expression over columns named like the arguments."""
    empty = spark.createDataFrame([], ", ".join(f"{a} {kind}" for a, kind in arguments.items()))
    analysed = empty.select(build(*[F.col(a) for a in arguments]).alias("answer"))._jdf.queryExecution().analyzed()
    return analysed.expressions().apply(0).children().apply(0).sql()


def register(spark: SparkSession) -> list[str]:
    """Register all functions for this session and name them."""
    for name, handler in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler))
    for name, (arguments, result, build) in SCALARS.items():
        body = _as_sql(spark, arguments, build)
        listed = ", ".join(f"{a} {kind}" for a, kind in arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS {result} RETURN {body}")
    return [*TABLE_FUNCTIONS, *SCALARS]
