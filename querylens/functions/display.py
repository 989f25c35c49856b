"""Presentation columns: durations, byte sizes, percentages and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.coerce import collapse_space


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, from the exact value, ties away from zero."""
    doubled = value * float(2 ** (digits + 1))
    is_tie = (doubled == F.floor(doubled)) & (F.pmod(F.floor(doubled), F.lit(2)) == 1)
    nudged = F.when(is_tie, value + F.signum(value) * 10.0 ** -(digits + 1)).otherwise(value)
    return F.replace(F.format_number(nudged.cast("double"), digits), F.lit(","), F.lit(""))


def duration_label(ms: Column) -> Column:
    sec = ms / 1000.0
    return (
        F.when(ms.isNull(), F.lit("-"))
        .when(ms < 1000, F.concat(fixed(ms.cast("double"), 0), F.lit(" ms")))
        .when(sec < 60, F.concat(fixed(sec, 2), F.lit(" s")))
        .when(sec < 3600, F.concat(fixed(sec / 60, 2), F.lit(" min")))
        .otherwise(F.concat(fixed(sec / 3600, 2), F.lit(" h")))
    )


def bytes_label(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.concat(fixed(n / float(1024 ** (len(units) - 1)), 1), F.lit(f" {units[-1]}"))
    for power in range(len(units) - 2, -1, -1):
        scaled = n / float(1024**power)
        out = F.when(scaled < 1024, F.concat(fixed(scaled, 1), F.lit(f" {units[power]}"))).otherwise(out)
    return F.when(n.isNull(), F.lit("-")).otherwise(out)


def percent_label(ratio: Column, digits: int = 2) -> Column:
    return F.when(ratio.isNull(), F.lit("-")).otherwise(F.concat(fixed(ratio * 100.0, digits), F.lit("%")))


def middle_cut(text: Column, limit: int = 140) -> Column:
    left = (limit - 3) // 2
    right = limit - 3 - left
    cut = F.concat(F.substring(text, 1, left), F.lit("..."), F.right(text, F.lit(right)))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def sql_label(sql: Column, limit: int = 140) -> Column:
    return middle_cut(collapse_space(sql), limit)


def bucket_width_label(seconds: Column) -> Column:
    whole = seconds.cast("bigint")
    out = F.concat(whole.cast("string"), F.lit("s"))
    for width, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        out = F.when(whole % width == 0, F.concat(F.floor(whole / width).cast("string"), F.lit(unit))).otherwise(out)
    return out
