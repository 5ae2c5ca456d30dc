"""Payloads as VARIANT: fields are read by path, and nothing that does not fit is lost.

A payload that is no JSON, a field of the wrong type and a field that nobody knows are all kept beside the typed columns: the reader of a feed sees
what changed in it, and later runs can read the new field from the stored rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.sources import nested
from duelframe.storage import materialise


@dataclass(frozen=True)
class Layout:
    """Known fields of a payload: column to (path, SQL type). ``ignored`` are known top-level fields that no column reads."""

    fields: Mapping[str, tuple[str, str]]
    ignored: tuple[str, ...] = ()

    @property
    def top_level(self) -> list[str]:
        return sorted({path.removeprefix("$.").split(".")[0].split("[")[0] for path, _ in self.fields.values()} | set(self.ignored))


def _present(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


def _fits(v: Column, path: str, kind: str) -> Column:
    """Does the field cast to its type? Texts are no numbers here, even if they could be read as such, and numbers no texts."""
    real = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    kinds = {
        "string": real == "STRING",
        "boolean": real == "BOOLEAN",
        "timestamp": (real == "STRING") & F.try_variant_get(v, path, "timestamp").isNotNull(),
    }
    if kind in kinds:
        return kinds[kind]
    if kind.startswith("array"):
        return real.startswith("ARRAY")
    return ~real.isin("STRING", "BOOLEAN") & F.try_variant_get(v, path, kind).isNotNull()


def read(df: DataFrame, payload: str, layout: Layout) -> DataFrame:
    """``df`` with the columns of ``layout``, ``problems`` and ``unknown``; one row per row.

    * ``problems`` lists ``no JSON`` and ``<column>: not <type>`` for fields that are there but do not fit; their column is NULL. A missing or null field is no problem.
    * ``unknown`` maps the names of top-level fields that are not in the layout to their JSON text; empty if there are none.
    * NULL and empty payloads are ``no JSON``. A payload that is no object has no fields. The payload itself stays.
    """
    v = F.try_parse_json(payload)
    whole = df.withColumn("__v", v)
    names = layout.top_level
    known = F.expr("try_cast(__v AS MAP<STRING, VARIANT>)")
    others = F.map_filter(known, lambda k, _: ~k.isin(names))
    wrong = [
        F.when(_present(F.col("__v"), path) & ~_fits(F.col("__v"), path, kind), F.lit(f"{column}: not {kind.split('<')[0]}"))
        for column, (path, kind) in layout.fields.items()
    ]
    problems = F.when(F.col("__v").isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(F.array(*wrong)))
    typed = {
        column: F.when(_present(F.col("__v"), path) & _fits(F.col("__v"), path, kind), F.try_variant_get(F.col("__v"), path, kind))
        for column, (path, kind) in layout.fields.items()
    }
    text = F.transform_values(others, lambda _, value: F.to_json(value))
    empty = F.create_map().cast("map<string,string>")
    return whole.withColumns(typed | {"problems": problems, "unknown": F.coalesce(text, empty)}).drop("__v")


MATCHUP = Layout({
    "id": ("$.id", "bigint"), "parentId": ("$.parentId", "bigint"), "startTime": ("$.startTime", "timestamp"),
    "participants": ("$.participants", "array<struct<alignment: string, name: string>>"),
})
MARKET = Layout({
    "matchupId": ("$.matchupId", "bigint"), "type": ("$.type", "string"), "period": ("$.period", "int"), "position": ("$.position", "bigint"),
    "prices": ("$.prices", "array<struct<designation: string, price: int, points: double>>"),
})
PROP = Layout({
    "id": ("$.id", "bigint"), "startTime": ("$.startTime", "timestamp"),
    "special": ("$.special", "struct<category: string, description: string>"),
    "participants": ("$.participants", "array<struct<id: bigint, name: string>>"),
    "prices": ("$.prices", "array<struct<participantId: bigint, designation: string, price: int, points: double>>"),
})


def _typed(fields: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """An object's fields as a struct; one that does not fit is NULL."""
    return lambda v: F.struct(*[F.when(_present(v, f"$.{n}") & _fits(v, f"$.{n}", k), F.try_variant_get(v, f"$.{n}", k)).alias(n) for n, k in fields])


def _misfit(name: str, kind: str) -> Callable[[Column], Column]:
    return lambda v: _present(v, f"$.{name}") & ~_fits(v, f"$.{name}", kind)


def read_with_items(df: DataFrame, payload: str, layout: Layout) -> DataFrame:
    """``read``, where a field of an item of an array or of an inner object may have a wrong type too: only that inner field is NULL then.

    ``inner_problems`` lists ``<column>.<field>: not <type>`` once per column and field.
    """
    plain = Layout({c: (p, k if not k.startswith(("array<struct", "struct")) else ("array<variant>" if k.startswith("array") else "map<string,variant>")) for c, (p, k) in layout.fields.items()}, layout.ignored)
    out = read(df, payload, plain)
    inner = []
    for column, (_, kind) in layout.fields.items():
        if not kind.startswith(("array<struct", "struct")):
            continue
        fields = [tuple(x.strip() for x in f.split(":")) for f in kind[kind.index("struct<") + 7 :].rstrip(">").split(",")]
        if kind.startswith("array"):
            bad = {n: F.exists(column, _misfit(n, k)) for n, k in fields}
            value = F.transform(column, _typed(fields))
        else:
            entry = {n: F.try_element_at(F.col(column), F.lit(n)) for n, _ in fields}
            there = {n: v.isNotNull() & ~F.is_variant_null(v) for n, v in entry.items()}
            bad = {n: there[n] & ~_fits(entry[n], "$", k) for n, k in fields}
            value = F.struct(*[F.when(there[n] & _fits(entry[n], "$", k), F.try_variant_get(entry[n], "$", k)).alias(n) for n, k in fields])
            value = F.when(F.col(column).isNotNull(), value)
        kinds = dict(fields)
        inner += [F.when(b, F.lit(f"{column}.{n}: not {kinds[n]}")) for n, b in bad.items()]
        out = out.withColumn(f"__new_{column}", value)
    out = out.withColumn("inner_problems", F.array_compact(F.array(*inner)) if inner else F.array().cast("array<string>"))
    swapped = [c.removeprefix("__new_") for c in out.columns if c.startswith("__new_")]
    return out.drop(*swapped).withColumnsRenamed({f"__new_{c}": c for c in swapped})


def quotes(matchups: DataFrame, markets: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``nested.quotes`` of two tables of payloads, and every payload that was not read in full: (feed, payload, problems, unknown).

    A wrong field costs that field alone: a moneyline without a price still gives the contest's other columns.
    """
    # read once and stored: both answers come from it
    games = materialise(read_with_items(matchups, payload, MATCHUP), "matchups")
    lines = materialise(read_with_items(markets, payload, MARKET), "markets")
    return nested.quotes(games, lines), unread([("matchups", games), ("markets", lines)], payload)


def props(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """``nested.props`` of a table of payloads, and every payload that was not read in full."""
    read_in = materialise(read_with_items(payloads, payload, PROP), "props")
    return nested.props(read_in), unread([("props", read_in)], payload)


def unread(feeds: list[tuple[str, DataFrame]], payload: str) -> DataFrame:
    """(feed, payload, problems, unknown) of the payloads with a problem or an unknown field."""
    out = None
    for name, df in feeds:
        found = df.select(F.lit(name).alias("feed"), F.col(payload).alias("payload"), F.array_union("problems", "inner_problems").alias("problems"), "unknown")
        found = found.where((F.size("problems") > 0) | (F.size("unknown") > 0))
        out = found if out is None else out.unionByName(found)
    return out
