"""Parsing of pairings, season codes, durations, dates and category labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_home(matchup: Column) -> Column:
    """1 for ``A vs. B``, 0 for ``A @ B``."""
    return F.contains(matchup, F.lit(" vs. ")).cast("int")


def opponent(matchup: Column) -> Column:
    """The last name of ``A vs. B`` or ``A @ B``."""
    return F.trim(F.element_at(F.split(matchup, r" vs\. | @ "), -1))


def season_of_date(date: Column, first_month: int = 10) -> Column:
    """Six-digit code of the season that a date falls in; a season starts in ``first_month``."""
    start = F.year(date) - (F.month(date) < first_month).cast("int")
    return (start * 100 + F.pmod(start + 1, F.lit(100))).cast("int")


def season_code(text: Column) -> Column:
    """Six-digit season code from ``2024-25``, ``2023-2024``, ``202425``, ``2425``, ``22024`` or an end year.

    A four-digit value from 2000 to 2099 is an end year; any other is two
    two-digit years. A five-digit value carries the start year after its first digit.
    """
    digits = F.regexp_replace(F.trim(text), "[^0-9]", "")
    size = F.length(digits)

    def from_start(start: Column) -> Column:
        return (start * 100 + F.pmod(start + 1, F.lit(100))).cast("int")

    def number(value: Column) -> Column:
        return value.try_cast("int")

    end_year = number(digits)
    return (
        F.when(size == 8, from_start(number(F.substring(digits, 1, 4))))
        .when(size == 6, number(digits))
        .when(size == 5, from_start(number(F.substring(digits, 2, 4))))
        .when((size == 4) & end_year.between(2000, 2099), from_start(end_year - 1))
        .when(size == 4, number(F.concat(F.lit("20"), digits)))
    )


def season_label(code: Column) -> Column:
    """``2024-25`` for 202425."""
    return F.concat(F.floor(code / 100).cast("string"), F.lit("-"), F.lpad(F.pmod(code, F.lit(100)).cast("string"), 2, "0"))


def clock_minutes(text: Column) -> Column:
    """Minutes from ``MM:SS`` or a plain number."""
    minutes = F.split_part(text, F.lit(":"), F.lit(1)).try_cast("double")
    seconds = F.split_part(text, F.lit(":"), F.lit(2)).try_cast("double")
    return F.when(F.contains(text, F.lit(":")), minutes + seconds / 60).otherwise(text.try_cast("double"))


def iso_clock(text: Column) -> Column:
    """``4:22`` from ``PT04M22.00S``."""
    minutes = F.regexp_extract(text, r"PT(\d+)M(\d+)", 1).try_cast("int")
    seconds = F.regexp_extract(text, r"PT(\d+)M(\d+)", 2).try_cast("int")
    return F.when(minutes.isNotNull(), F.concat(minutes.cast("string"), F.lit(":"), F.lpad(seconds.cast("string"), 2, "0")))


def feet_inches(text: Column) -> Column:
    """Inches from ``6-6``."""
    feet = F.split_part(text, F.lit("-"), F.lit(1)).try_cast("int")
    inches = F.split_part(text, F.lit("-"), F.lit(2)).try_cast("int")
    return feet * 12 + inches


def record_wins(text: Column) -> Column:
    """Wins from ``10-5``, 0 if it cannot be read."""
    return F.coalesce(F.split_part(text, F.lit("-"), F.lit(1)).try_cast("int"), F.lit(0))


def record_losses(text: Column) -> Column:
    return F.coalesce(F.split_part(text, F.lit("-"), F.lit(2)).try_cast("int"), F.lit(0))


def mixed_date(text: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")) -> Column:
    """The first of several date formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def local_date(instant: Column, zone: str | None = None, offset_hours: int = -5) -> Column:
    """Local calendar date of a UTC instant: by zone rules, or by a fixed offset without daylight saving."""
    if zone is not None:
        return F.to_date(F.from_utc_timestamp(instant, zone))
    return F.to_date(instant + F.make_dt_interval(hours=F.lit(offset_hours)))


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def category(text: Column, known: Mapping[str, str], default: str) -> Column:
    """Category by exact label, first token, first letter, else ``default``."""
    clean = F.upper(F.trim(text))
    lookup = literal_map(known)
    token = F.trim(F.split_part(clean, F.lit("-"), F.lit(1)))
    letter = F.substring(token, 1, 1)
    found = [F.try_element_at(lookup, key) for key in (clean, token, letter)]
    return F.when(F.coalesce(clean, F.lit("")) == "", default).otherwise(F.coalesce(*found, F.lit(default)))


def granular_positions(label: Column, height: Column, assists: Column) -> Column:
    """Detailed positions from a roster label, height in inches (78 if unknown) and assists per game."""
    clean = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    tall = F.coalesce(F.nullif(height, F.lit(0)), F.lit(78))
    creator = F.coalesce(assists, F.lit(0)) >= 5
    first = F.split_part(clean, F.lit("-"), F.lit(1))
    guard = F.when(tall <= 76, "PG").when((tall <= 78) & creator, "PG, SG").otherwise("SG")
    forward = F.when(tall <= 79, "SF").when(tall <= 81, "SF, PF").otherwise("PF")
    swing = F.when(creator, "PG, SG").otherwise("SG, SF")
    return (
        F.when(clean == "G", guard)
        .when(clean == "G-F", "SG, SF")
        .when(clean == "F-G", swing)
        .when(clean == "F", forward)
        .when(clean == "F-C", "PF, C")
        .when(clean == "C-F", "C, PF")
        .when(first == "C", "C")
        .when(first == "G", "SG")
        .when(first == "F", "SF")
        .otherwise("")
    )


def clean_name(name: str) -> str:
    """Column name in lower case with ``_`` for blanks, hyphens and slashes."""
    lowered = name.strip().lower()
    return "".join("_" if ch in " -/" else ch for ch in lowered)


def clean_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def formatted(value: Column, pattern: str) -> Column:
    """A number as text; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(pattern, value.cast("double")))


def signed(value: Column, decimals: int = 1) -> Column:
    """A number with its sign, as in ``+3.5``."""
    return formatted(value, f"%+.{decimals}f")


def percent(value: Column, decimals: int = 1) -> Column:
    """A rate as in ``63.2%``."""
    return formatted(value * 100, f"%.{decimals}f%%")
