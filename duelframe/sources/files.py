"""Seasonal files: read with the season from the file name, reject bad keys, replace partitions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions.text import clean_columns, clean_name
from duelframe.operators.sets import union_by_name, without_keys
from duelframe.operators.topk import first_row


def season_from_name(prefix: str) -> Column:
    """Season code of ``<prefix>_202425.csv`` anywhere in the path of the file a row came from."""
    return F.regexp_extract("_metadata.file_path", rf"{prefix}_(\d{{6}})", 1).try_cast("int")


def read_seasons(spark: SparkSession, path: str, prefix: str, schema: T.StructType) -> DataFrame:
    """All season files below ``path`` as one table with a ``season`` column.

    The schema is given, so no file is read to infer it; malformed values become NULL.
    """
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return files.csv(path).withColumn("season", season_from_name(prefix))


def changed_since(df: DataFrame, instant: Column) -> DataFrame:
    """Rows of files written after ``instant``; Spark prunes the other files by their metadata."""
    return df.filter(F.col("_metadata.file_modification_time") > instant)


def with_integer_key(df: DataFrame, key: str) -> DataFrame:
    """Cast a key to a number and drop the rows where that fails."""
    return df.withColumn(key, F.col(key).try_cast("bigint")).filter(F.col(key).isNotNull())


def rejected(df: DataFrame, key: str) -> DataFrame:
    """How many rows a key cast keeps and rejects."""
    ok = F.col(key).try_cast("bigint").isNotNull()
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


def replace_seasons(existing: DataFrame, rebuilt: DataFrame, season: str, keys: Sequence[str] | None, order: Sequence[str] = ()) -> DataFrame:
    """Existing rows of the other seasons plus the rebuilt ones, one row per key.

    For a table partitioned by season, ``write_seasons`` replaces the
    partitions in place without reading the others.
    """
    kept = without_keys(existing, rebuilt.select(season).distinct(), [season])
    merged = kept.unionByName(rebuilt, allowMissingColumns=True)
    return first_row(merged, keys, list(order)) if keys else merged.distinct()


def write_seasons(df: DataFrame, path: str, season: str = "season") -> None:
    """Write by season; only the seasons in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)


def dimension(df: DataFrame, names: Mapping[str, str], key: str, order: Sequence[str] = ()) -> DataFrame:
    """Dimension table: clean and rename columns, coerce the key, one row per key."""
    renamed = clean_columns(df).withColumnsRenamed(dict(names))
    return first_row(with_integer_key(renamed, key), [key], list(order) or sorted(renamed.columns))


def tolerant_union(spark: SparkSession, paths: Mapping[str, str], required: Sequence[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the CSV sources that have the required columns, and why each other one was left out.

    Only headers are looked at to decide; a source that is not there is left out, any other failure to read is an error.
    """
    usable, skipped = [], {}
    for name, path in paths.items():
        try:
            reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
            df = clean_columns(reader.csv(path))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            skipped[name] = "absent"
            continue
        if set(required) <= set(df.columns):
            usable.append(df.withColumn("source", F.lit(name)))
        else:
            skipped[name] = "lacks " + ", ".join(sorted(set(required) - set(df.columns)))
    return (union_by_name(usable) if usable else None), skipped


def first_present(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first of several spellings of a column that the table has; NULL if it has none."""
    have = [n for n in names if n in df.columns]
    return F.coalesce(*[F.col(n) for n in have]).cast(kind) if have else F.lit(None).cast(kind)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order, cast, with NULL for those the table lacks."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def player_index(df: DataFrame) -> DataFrame:
    """(player_id, player_name, position) from any of several layouts of a player list."""
    t = clean_columns(df)
    parts = [first_present(t, [c]) for c in ("player_first_name", "player_last_name")]
    given = F.nullif(F.trim(F.concat_ws(" ", *[F.trim(p) for p in parts])), F.lit(""))
    key = first_present(t, ["person_id", "player_id", "personid"])
    name = F.coalesce(first_present(t, ["player_name"]), given, first_present(t, ["display_first_last"]), key)
    return t.select(
        key.try_cast("bigint").alias("player_id"),
        name.alias("player_name"),
        F.trim(F.coalesce(first_present(t, ["position", "pos"]), F.lit(""))).alias("position"),
    ).filter(F.col("player_id").isNotNull())


def missing_periods(incoming: DataFrame, existing: DataFrame, period: str) -> DataFrame:
    """Rows of periods that the target does not hold yet."""
    return without_keys(incoming, existing.select(period).distinct(), [period])


@dataclass(frozen=True)
class SeasonalTable:
    """One registered raw table."""

    prefix: str
    schema: T.StructType
    key: str
    dedupe: Sequence[str]
    transform: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    optional: bool = False


def load_registered(spark: SparkSession, root: str, tables: Mapping[str, SeasonalTable]) -> dict[str, DataFrame]:
    """Read, clean, coerce, transform and dedupe every registered table; absent optional ones are left out."""
    loaded = {}
    for name, table in tables.items():
        try:
            raw = read_seasons(spark, f"{root}/{name}", table.prefix, table.schema)
        except AnalysisException as missing:
            if table.optional and missing.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        df = raw.transform(lambda d: d.toDF(*[clean_name(c) for c in d.columns]))
        df = table.transform(with_integer_key(df, table.key))
        loaded[name] = first_row(df, table.dedupe, sorted(df.columns))
    return loaded
