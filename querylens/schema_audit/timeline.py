"""Partitions of a table in time order, without ever sorting one table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.ordering import Buckets, position, running_total
from querylens.schema_audit.inputs import KEY

_BUCKET_BITS = 13
_TIME_BUCKET_US = 3_600_000_000 << _BUCKET_BITS

ORDERED = Buckets(tuple(KEY), ("_slice",), ("ord",))


def timeline(partitions: DataFrame) -> DataFrame:
    """Add ``ord``: partitions with a readable lower bound are sorted among their own places.

    ``partitions`` holds ``pos`` (unique per table) and ``lower_us``.
    """
    dated = partitions.where(F.col("lower_us").isNotNull()).select(*KEY, "pos", "lower_us", "name")
    by_time = position(
        dated.withColumn("_slice", F.floor(F.col("lower_us") / _TIME_BUCKET_US)),
        Buckets(tuple(KEY), ("_slice",), ("lower_us", "name", "pos")),
        "rank",
    ).select(*KEY, "rank", "pos")
    places = position(
        dated.withColumn("_slice", F.shiftright("pos", _BUCKET_BITS)),
        Buckets(tuple(KEY), ("_slice",), ("pos",)),
        "rank",
    ).select(*KEY, "rank", F.col("pos").alias("ord"))
    moved = by_time.join(places, [*KEY, "rank"]).drop("rank")
    return partitions.join(moved, [*KEY, "pos"], "left").withColumn("ord", F.coalesce("ord", "pos"))


def with_slices(ordered: DataFrame) -> DataFrame:
    return ordered.withColumn("_slice", F.shiftright("ord", _BUCKET_BITS))


def counted(ordered: DataFrame, counts: dict[str, object]) -> DataFrame:
    """Running counts of the given conditions along the timeline."""
    out = with_slices(ordered)
    for name, condition in counts.items():
        out = running_total(out, ORDERED, condition.cast("bigint"), name)
    return out
