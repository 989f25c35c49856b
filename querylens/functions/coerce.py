"""Lenient text-to-value conversions (all NULL on bad input, so ANSI mode never aborts a job)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space in log and plan text.
TEXT_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Characters that count as white space in catalogue metadata.
META_SPACE = (
    "\t\n\x0b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as TEXT_SPACE, as the inside of a regex character class.
SPACE_CLASS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# The same set as a class of its own: plain text is settled by the first two tests.
SPACE = rf"[\s[\x{{A0}}-\x{{FEFF}}&&[{SPACE_CLASS}]]]"

TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time however often it is used."""
    return F.transform(F.array(value), use)[0]


def _trimmed(text: Column, space: str) -> Column:
    last = F.right(text, F.lit(1))
    plain = (text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f")
    touched = F.left(text, F.lit(1)).isin(*space) | last.isin(*space)
    return F.when(plain, text).when(touched, F.btrim(text, F.lit(space))).otherwise(text)


def trimmed(text: Column) -> Column:
    """``trim`` of a column or a lambda's variable, which may be named several times; compiled where it stands outside lambdas.

    Only texts that begin or end with white space are trimmed: most have a printable ASCII character at both ends, and to
    compare texts is cheap.
    """
    return _trimmed(text, TEXT_SPACE)


def trim(col: Column) -> Column:
    return once(col, trimmed)


def meta_trim(col: Column) -> Column:
    return once(col, lambda text: _trimmed(text, META_SPACE))


def non_blank(col: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(trim(col), F.lit(""))


def collapse_space(col: Column) -> Column:
    # a single blank stays as it is, and most are single
    return F.trim(F.regexp_replace(col, f"{SPACE}(?:(?<! )|(?={SPACE})){SPACE}*+", " "))


def first_non_blank(cols: Sequence[Column]) -> Column:
    return F.coalesce(*[non_blank(c) for c in cols])


def prefix_int(col: Column) -> Column:
    """Leading integer of a text (``13ms`` gives 13)."""
    digits = F.regexp_extract(col, rf"^[{SPACE_CLASS}]*([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def loose_bool(col: Column) -> Column:
    word = F.lower(trim(col))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def client_address(col: Column) -> Column:
    """Cut the port: everything from the last colon on, unless the colon comes first."""
    return F.regexp_replace(non_blank(col), r"(?s)^(.+):[^:]*\z", "$1")


# Whole text: a log time, or anything else (which leaves all groups empty).
_EVENT_TIME = (
    rf"(?s)^(?:([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){SPACE}+([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}})"
    rf"(?:[,.]([0-9]{{3,6}}))?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?|.*)\z"
)


def time_digits(col: Column) -> Column:
    """``yyyyMMddHHmmss|fraction|zone`` of a log time, ``||`` for other texts."""
    return F.regexp_replace(trim(col), _EVENT_TIME, "$1$2$3$4$5$6|$7|$8")


def millis_of_digits(digits: Column, tz: str = "UTC") -> Column:
    """Epoch milliseconds; texts without an offset are wall-clock time in ``tz``.

    Out-of-range parts roll over (month 13 is next January), which is why the civil time is summed
    up from its parts instead of being parsed. Only digits are ever cast: a failing ``try_cast``
    costs an exception per row.
    """

    def part(number: Column, unit: int, modulus: int = 100) -> Column:
        return (F.call_function("div", number, F.lit(unit)) % modulus).cast("int")

    def civil(number: Column) -> Column:
        year = part(number, 10**10, 10_000)
        full_year = year + F.when(year < 100, 1900).otherwise(0)
        month_start = F.add_months(F.make_date(full_year, F.lit(1), F.lit(1)), part(number, 10**8) - 1)
        day = F.unix_date(F.date_add(month_start, part(number, 10**6) - 1)).cast("bigint")
        seconds = (part(number, 10**4) * 60 + part(number, 100)) * 60 + part(number, 1)
        return day * 86_400_000 + seconds.cast("bigint") * 1000

    def instant(text: Column) -> Column:
        fraction = F.substring(F.split_part(text, F.lit("|"), F.lit(2)), 1, 3)
        wall = once(F.substring(text, 1, 14).cast("bigint"), civil) + F.when(
            fraction != "", fraction.cast("int")
        ).otherwise(0)
        zone = F.replace(F.split_part(text, F.lit("|"), F.lit(3)), F.lit(":"), F.lit(""))
        minutes = F.substring(zone, 2, 2).cast("bigint") * 60 + F.substring(zone, 4, 2).cast("bigint")
        sign = F.when(F.startswith(zone, F.lit("-")), -60_000).otherwise(60_000)
        local = wall if tz.upper() in ("UTC", "Z") else F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall), tz))
        return F.when(zone == "", local).when(zone == "Z", wall).otherwise(wall - minutes * sign)

    return F.when(digits != "||", once(digits, instant))


def event_time_ms(col: Column, tz: str = "UTC") -> Column:
    return millis_of_digits(time_digits(col), tz)


def loose_unsigned(col: Column) -> Column:
    """Catalogue counts: thousands commas allowed, fractions cut, negatives 0, saturating."""
    text = F.regexp_replace(meta_trim(col), ",", "")
    whole = F.when(text.rlike(r"^[0-9]+\z"), text)
    exact = whole.try_cast("bigint")
    as_float = text.try_cast("double")
    saturated = (
        F.when(as_float.isNull() | F.isnan(as_float), F.lit(None).cast("bigint"))
        .when(as_float < 0, F.lit(0).cast("bigint"))
        .when(as_float >= F.lit(9.223372036854775e18), F.lit(9223372036854775807))
        .otherwise(as_float.try_cast("bigint"))
    )
    return F.when(text != "", F.coalesce(exact, saturated))


# Byte-size units, each 1024 times the one before.
BYTE_UNITS = [("B",), ("K", "KB", "KIB"), ("M", "MB", "MIB"), ("G", "GB", "GIB"), ("T", "TB", "TIB"), ("P", "PB", "PIB")]


def byte_size(col: Column) -> Column:
    """``12.5 GB`` or ``3MiB`` in bytes; unknown units give NULL."""
    text = F.regexp_replace(meta_trim(col), ",", "")
    space = F.regexp_replace(text, rf"[{SPACE_CLASS}\x85]+", " ")
    words = F.split(space, " ")
    glued = F.size(words) == 1
    number_text = F.when(glued, F.regexp_extract(words[0], r"^[0-9.+-]*", 0)).otherwise(F.get(words, F.lit(0)))
    unit_text = F.when(glued, F.regexp_replace(words[0], r"^[0-9.+-]*", "")).otherwise(F.get(words, F.lit(1)))
    unit = F.when(unit_text == "", F.lit("B")).otherwise(F.upper(unit_text))
    factor = F.lit(None).cast("double")
    for power, names in enumerate(BYTE_UNITS):
        factor = F.when(unit.isin(*names), F.lit(float(1024**power))).otherwise(factor)
    value = F.nullif(number_text, F.lit("")).try_cast("double")
    total = value * factor
    return (
        F.when(value.isNull() | (text == ""), F.lit(None).cast("bigint"))
        .when(value < 0, F.lit(0).cast("bigint"))
        .when(total >= F.lit(9.223372036854775e18), F.lit(9223372036854775807))
        .otherwise(total.try_cast("bigint"))
    )


def number_like(col: Column) -> Column:
    """Numbers as plans print them (``149,996,355``, ``1_000``)."""
    text = F.nullif(trim(F.regexp_replace(col, "[, _]", "")), F.lit(""))
    value = F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), text).try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / F.nullif(denominator, F.lit(0))).otherwise(F.lit(0.0))
