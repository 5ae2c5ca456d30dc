"""Registry of named queries, their output columns and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.plans.shapes import Shapes, with_shapes

# Output types: l long, i int, s string, d date, t timestamp, f<n> double with n decimals.
_SPARK_TYPES = {"l": "bigint", "i": "int", "s": "string", "d": "date", "t": "timestamp_ntz"}
_SQL_TYPES = {"l": "BIGINT", "i": "INTEGER", "s": "VARCHAR", "d": "DATE", "t": "TIMESTAMP"}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Shapes], DataFrame]
    out: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Shapes(spark, folder))
        return df.select(*[_spark_column(name, kind) for name, kind in self.out]) if self.out else df

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        body = f"({self.sql})"
        columns = ", ".join(_sql_column(name, kind) for name, kind in self.out)
        return with_shapes(f"SELECT {columns} FROM {body} AS answer", self.sql_ctes())

    def sql_ctes(self) -> dict[str, str]:
        return SHARED_SQL


SHARED_SQL: dict[str, str] = {}
REGISTRY: dict[str, Query] = {}


def query(name: str, out: str = "", sql: str | None = None):
    """Register a query. ``out`` lists ``column:type``; results are cast and rounded to it."""
    columns = tuple(tuple(item.split(":")) for item in out.split())

    def register(build: Callable[[Shapes], DataFrame]) -> Callable[[Shapes], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, columns, sql)
        return build

    return register


def _spark_column(name: str, kind: str):
    if kind[0] == "f":
        # Rounding on doubles, half away from zero; adding zero turns a negative zero into a plain one.
        # As text, since a table may have hundreds of columns and each call that builds an expression takes its time.
        value, scale = f"CAST(`{name}` AS DOUBLE)", f"{10 ** int(kind[1:])}D"
        return F.expr(f"signum({value}) * floor(abs({value}) * {scale} + 0.5D) / {scale} + 0D AS `{name}`")
    return F.expr(f"CAST(`{name}` AS {_SPARK_TYPES[kind]}) AS `{name}`")


def _sql_column(name: str, kind: str) -> str:
    if kind[0] == "f":
        return f'round(CAST("{name}" AS DOUBLE), {kind[1:]}) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"'
