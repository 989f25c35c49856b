"""``key=value`` and ``KEY: value`` segments of plan nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions.coerce import collapse_space, once, trim, trimmed

# How facts of a node are written.
_EQ = r"^([A-Za-z_][A-Za-z0-9_]*)=(.+)\z"
_COLON = r"^([A-Za-z_][A-Za-z0-9_ ]*):\s*(.+)\z"
_NEXT_PAIR = r",\s+(?=[A-Za-z_][A-Za-z0-9_ ]*\s*[:=])"


def entry(segment: Column) -> Column:
    """``struct(k, v)``, NULL when the segment, a lambda's variable, is no pair. ``=`` keys are lower, ``:`` keys upper case."""

    def parts(sign: str) -> tuple[Column, Column]:
        """No key holds its sign, so the first sign ends it."""
        key = F.substring_index(segment, sign, 1)
        return key, trim(F.substr(segment, F.length(key) + 2))

    (key, value), (name, fact) = parts("="), parts(":")
    upper = F.when(F.contains(name, F.lit(" ")), F.replace(F.upper(collapse_space(name)), F.lit(" "), F.lit("_"))).otherwise(F.upper(name))
    return F.when(
        F.contains(segment, F.lit("=")) & segment.rlike(_EQ), F.struct(F.lower(key).alias("k"), value.alias("v"))
    ).when(F.contains(segment, F.lit(":")) & segment.rlike(_COLON), F.struct(upper.alias("k"), fact.alias("v")))


def entries(segments: Column) -> Column:
    return F.filter(F.transform(segments, entry), lambda e: e.isNotNull())


def split_pairs(segment: Column) -> Column:
    """A continuation line may hold several pairs, separated by commas."""

    def cut(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(",")), F.transform(F.split(text, _NEXT_PAIR), trimmed)).otherwise(F.array(text))

    return F.filter(once(trim(segment), cut), lambda s: s != "")


def _by_key(pairs: Column, combine) -> Column:
    def build(found: Column) -> Column:
        def by_distinct(keys: Column) -> Column:
            values = F.transform(
                keys, lambda k: combine(F.transform(F.filter(found, lambda e: e["k"] == k), lambda e: e["v"]))
            )
            # a key that comes once has nothing to combine
            return F.when(F.size(keys) == F.size(found), F.map_from_entries(found)).otherwise(F.map_from_arrays(keys, values))

        return once(F.array_distinct(F.transform(found, lambda e: e["k"])), by_distinct)

    return once(pairs, build)


def last_map(pairs: Column) -> Column:
    """The last value of a repeated key counts."""
    return _by_key(pairs, lambda values: F.element_at(values, -1))


def merged_map(pairs: Column) -> Column:
    """Different values of a repeated key are joined in first-seen order."""

    def merge(acc: Column, value: Column) -> Column:
        seen = (acc == value) | F.array_contains(F.split(acc, "; "), value)
        return F.when(acc == "", value).when(seen, acc).otherwise(F.concat(acc, F.lit("; "), value))

    kept = F.filter(pairs, lambda e: e["v"] != "")
    return _by_key(kept, lambda values: F.aggregate(values, F.lit(""), merge))


def first_value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda e: (e["k"] == key) & (e["v"] != "")), F.lit(0))["v"]


def lookup(kv: Column, key: str) -> Column:
    """Value by exact, lower-case or upper-case key."""
    return F.coalesce(*[F.try_element_at(kv, F.lit(k)) for k in dict.fromkeys((key, key.lower(), key.upper()))])
