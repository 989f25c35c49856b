"""Which partitions lie in the future, by range bound or by name, in the table's own time zone."""

from __future__ import annotations

import re
import zoneinfo
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.coerce import meta_trim
from querylens.schema_audit.inputs import KEY

_DAY_US = 86_400_000_000
_LOWER = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?: ([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?)?\z"
UNITS = ("HOUR", "DAY", "WEEK", "MONTH", "YEAR")


def known_zones() -> list[str]:
    """Zone names that the JVM knows too."""
    return sorted(z for z in zoneinfo.available_timezones() if re.match(r"^[A-Z]", z) and z not in ("ROC", "Factory"))


def lower_bound_us(text: Column) -> Column:
    """Civil microseconds of a range lower bound; NULL for texts that are not a dashed date."""
    value = meta_trim(F.substring_index(meta_trim(F.btrim(text, F.lit("\"'"))), ",", 1))

    def part(i: int) -> Column:
        return F.regexp_extract(value, _LOWER, i)

    def num(i: int) -> Column:
        return F.coalesce(F.nullif(part(i), F.lit("")).try_cast("int"), F.lit(0))

    day = F.unix_date(F.nullif(part(1), F.lit("")).try_cast("date")).cast("bigint")
    micros = F.rpad(F.substring(part(5), 1, 6), 6, "0").cast("bigint")
    in_day = (num(2) * 60 + num(3)) * 60 + num(4)
    sane = (num(2) < 24) & (num(3) < 60) & (num(4) < 60)
    return F.when(sane, day * _DAY_US + in_day.cast("bigint") * 1_000_000 + micros)


def week_day(day: Column) -> Column:
    """1 (Monday) to 7 of an epoch day."""
    return F.pmod(day + 3, F.lit(7)) + 1


def week_start(day: Column, first_day: Column) -> Column:
    return day - F.pmod(week_day(day) - first_day, F.lit(7))


def week_token(day: Column, first_day: Column) -> tuple[Column, Column]:
    """Year and week number as partition names carry them."""
    date = F.date_from_unix_date(day.cast("int"))
    jan1 = F.unix_date(F.make_date(F.year(date), F.lit(1), F.lit(1)))
    offset = F.pmod(week_day(jan1) - first_day, F.lit(7))
    week = F.floor((F.dayofyear(date) + offset - 1) / 7) + 1
    return F.year(date), F.when((week <= 1) & (F.month(date) == 12), week + 52).otherwise(week)


def _unit_number(us: Column, unit: Column, first_day: Column) -> Column:
    """A number that grows by calendar unit; NULL for an unknown unit."""
    day = F.floor(us / _DAY_US)
    date = F.date_from_unix_date(day.cast("int"))
    return (
        F.when(unit == "DAY", day)
        .when(unit == "HOUR", F.floor(us / 3_600_000_000))
        .when(unit == "WEEK", week_start(day, first_day))
        .when(unit == "MONTH", (F.year(date) * 12 + F.month(date)).cast("bigint"))
        .when(unit == "YEAR", F.year(date).cast("bigint"))
    )


def _signed_int(text: Column) -> Column:
    """Integers of any length that 64 bits hold; the pattern keeps other texts from a failing cast."""
    return F.when(text.rlike(r"^[+-]?[0-9]{1,19}\z"), text).try_cast("bigint")


def window_columns(properties: Column, as_of: datetime, default_zone: str = "UTC") -> dict[str, Column]:
    """Dynamic-partition settings of a table as columns; ``as_of`` is a UTC clock reading."""

    def prop(name: str) -> Column:
        return meta_trim(F.try_element_at(properties, F.lit(f"dynamic_partition.{name}")))

    start, end = _signed_int(prop("start")), _signed_int(prop("end"))
    zone = prop("time_zone")
    zone = F.when(zone.isin(*known_zones()), zone).otherwise(F.lit(default_zone))
    dow = _signed_int(prop("start_day_of_week"))
    clock = F.lit(as_of.replace(tzinfo=None)).cast("timestamp_ntz")
    utc = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), clock))
    return {
        "dyn_enabled": F.coalesce(F.lower(prop("enable")).isin("1", "t", "true"), F.lit(False)),
        "dyn_span": F.when(end >= start, F.try_add(F.try_subtract(end, start), F.lit(1))),
        "dyn_end": F.greatest(end, F.lit(0)),
        "dyn_unit": F.coalesce(F.upper(prop("time_unit")), F.lit("")),
        "dyn_prefix": F.coalesce(prop("prefix"), F.lit("")),
        "dyn_first_day": F.when(dow.between(1, 7), dow).otherwise(1).cast("int"),
        "dyn_now_us": F.unix_micros(F.from_utc_timestamp(utc, zone)),
    }


def future_by_range(lower_us: Column) -> Column:
    """True / false, NULL when the bound cannot be placed."""
    unit, first = F.col("dyn_unit"), F.col("dyn_first_day")
    return _unit_number(lower_us, unit, first) > _unit_number(F.col("dyn_now_us"), unit, first)


def future_by_name(name: Column) -> Column:
    """True / false, NULL when the name does not follow the table's naming rule."""
    unit, prefix, first = F.col("dyn_unit"), F.col("dyn_prefix"), F.col("dyn_first_day")
    trimmed = meta_trim(name)
    token = F.when(F.startswith(trimmed, prefix), F.substr(trimmed, F.length(prefix) + 1))
    # Digits of the token per unit.
    digits = F.when(unit == "DAY", 8).when(unit == "HOUR", 10).when(unit == "MONTH", 6).when(unit == "YEAR", 4)
    dated = F.when((F.length(token) == digits) & token.rlike(r"^[0-9]+\z"), F.rpad(token, 10, "0"))
    month = F.when(F.substring(dated, 5, 2) == "00", F.when(unit == "YEAR", "01")).otherwise(F.substring(dated, 5, 2))
    day = F.when(F.substring(dated, 7, 2) == "00", F.when(unit.isin("YEAR", "MONTH"), "01")).otherwise(
        F.substring(dated, 7, 2)
    )
    date = F.concat(F.substring(dated, 1, 4), F.lit("-"), month, F.lit("-"), day).try_cast("date")
    hour = F.substring(dated, 9, 2).cast("bigint")
    us = F.unix_date(date).cast("bigint") * _DAY_US + F.when(hour < 24, hour) * 3_600_000_000
    now_day = F.floor(F.col("dyn_now_us") / _DAY_US)
    this_year, this_week = week_token(now_day, first)
    halves = F.split(token, "_")
    year, week = _signed_int(F.get(halves, F.lit(0))), _signed_int(F.get(halves, F.lit(1)))
    by_week = F.when(
        (F.size(halves) == 2) & year.isNotNull() & (week > 0),
        F.when(year != this_year, year > this_year).otherwise(week > this_week),
    )
    by_date = _unit_number(us, unit, first) > _unit_number(F.col("dyn_now_us"), unit, first)
    return F.when(unit == "WEEK", by_week).otherwise(by_date)


def mark_future(partitions: DataFrame, tables: DataFrame) -> DataFrame:
    """Partitions with ``lower_us, range_future, name_future`` and the table's settings.

    ``tables`` holds one row per table; a table with very many partitions is the only repeated key.
    """
    settings = [c for c in tables.columns if c.startswith("dyn_")]
    marked = partitions.join(tables.select(*KEY, *settings), KEY, "left").withColumn(
        "lower_us", lower_bound_us(F.col("range_lower"))
    )
    usable = F.coalesce(F.col("dyn_enabled"), F.lit(False)) & (F.col("dyn_unit") != "")
    return marked.withColumn("range_future", F.when(usable, future_by_range(F.col("lower_us")))).withColumn(
        "name_future", F.when(usable, future_by_name(F.col("name")))
    )
