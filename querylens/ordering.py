"""Order-dependent columns over groups of any size.

A group (a file, a table) may hold a third of the data, so no window ever spans one. Its rows fall
into ordered buckets of bounded size (runs of lines, runs of positions): windows run inside a bucket,
and one row per bucket carries the result across.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Buckets:
    """``group`` and ``bucket`` name the bucket of a row, ``order`` its place inside.

    Several ``bucket`` columns name it from the outside in: split and run of a line.
    """

    group: tuple[str, ...]
    bucket: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def keys(self) -> list[str]:
        return [*self.group, *self.bucket]

    def rows(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def before_buckets(
    buckets: DataFrame, lanes: Buckets, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None
) -> DataFrame:
    """Add what the buckets before each one hold: sums of numbers, and last non-NULL values.

    ``buckets`` has one row per bucket, and a window runs over the buckets of a group. Without a group
    it runs over those with the same first column, which are then folded to a row each.
    """
    sums, lasts = sums or {}, lasts or {}
    own = {name: F.coalesce(amount.cast("bigint"), F.lit(0)) for name, amount in sums.items()} | lasts
    level = buckets.select("*", *[column.alias(f"_own_{name}") for name, column in own.items()])

    def across(rows: DataFrame, window, prefix: str) -> DataFrame:
        earlier = _before(window)
        found = {name: F.coalesce(F.sum(f"_own_{name}").over(earlier), F.lit(0)) for name in sums}
        found |= {name: F.last(f"_own_{name}", ignorenulls=True).over(earlier) for name in lasts}
        return rows.select("*", *[column.alias(prefix + name) for name, column in found.items()]).drop(
            *[f"_own_{name}" for name in own]
        )

    top, *inner = lanes.bucket
    if lanes.group or not inner:
        window = Window.partitionBy(*lanes.group) if lanes.group else Window
        return across(level, window.orderBy(*lanes.bucket), "")
    place = F.struct(*inner)
    folded = level.groupBy(top).agg(
        *[F.sum(f"_own_{name}").alias(f"_own_{name}") for name in sums],
        *[
            F.max_by(f"_own_{name}", F.when(F.col(f"_own_{name}").isNotNull(), place)).alias(f"_own_{name}")
            for name in lasts
        ],
    )
    inside = across(level, Window.partitionBy(top).orderBy(*inner), "_in_")
    joined = inside.join(across(folded, Window.orderBy(top), "_up_"), top)
    whole = {name: F.col(f"_in_{name}") + F.col(f"_up_{name}") for name in sums}
    whole |= {name: F.coalesce(f"_in_{name}", f"_up_{name}") for name in lasts}
    return joined.select(*buckets.columns, *[column.alias(name) for name, column in whole.items()])


def running_total(df: DataFrame, lanes: Buckets, amount: Column, out: str) -> DataFrame:
    """Sum of ``amount`` over the rows of the group up to and including each row."""
    marked = df.withColumn("_amount", F.coalesce(amount.cast("bigint"), F.lit(0)))
    totals = marked.groupBy(*lanes.keys).agg(F.sum("_amount").alias("_total"))
    offsets = before_buckets(totals, lanes, sums={"_offset": F.col("_total")}).drop("_total")
    local = F.sum("_amount").over(lanes.rows().rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_local", local)
        .join(offsets, lanes.keys)
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_amount", "_local", "_offset")
    )


def position(df: DataFrame, lanes: Buckets, out: str) -> DataFrame:
    """1-based rank of every row in its group."""
    return running_total(df, lanes, F.lit(1), out)


def carry_last(df: DataFrame, lanes: Buckets, value: Column, out: str) -> DataFrame:
    """Last non-NULL ``value`` among the rows of the group that come before each row."""
    marked = df.withColumn("_value", value)
    local = F.last("_value", ignorenulls=True).over(_before(lanes.rows()))
    # Buckets without any value still need the carry, so the bucket list comes from all rows.
    place = F.when(F.col("_value").isNotNull(), F.struct(*lanes.order))
    buckets = marked.groupBy(*lanes.keys).agg(F.max_by("_value", place).alias("_last"))
    carried = before_buckets(buckets, lanes, lasts={"_carry": F.col("_last")}).drop("_last")
    return (
        marked.withColumn("_here", local)
        .join(carried, lanes.keys)
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_value", "_here", "_carry")
    )


def assemble(
    rows: DataFrame, lanes: Buckets, piece: str, local_seq: str, flag: str, joiner: str = "", lead: bool = True
) -> DataFrame:
    """Concatenate the rows of one record, also when it crosses buckets.

    ``local_seq`` numbers records inside a bucket and ``flag`` marks the rows that move that number
    on; record 0 of a bucket continues the record left open before it. Rows before the first mark of
    their group are a record too; without ``lead`` its text is NULL and its rows are not put together,
    so that a group without marks, however large, makes no cell.

    Result: group and bucket columns of the record's first row, ``record_seq`` (per group) and ``text``.
    """
    keys = lanes.keys
    ordered = F.array_sort(F.collect_list(F.struct(*lanes.order, F.col(piece).alias("_p"))))
    parts = rows.groupBy(*keys, local_seq).agg(
        F.array_join(F.transform(ordered, lambda r: r["_p"]), joiner).alias("_text")
    )

    bucket = F.struct(*lanes.bucket)
    totals = rows.groupBy(*keys).agg(F.sum(F.col(flag).cast("bigint")).alias("_n"))
    buckets = before_buckets(totals, lanes, sums={"_offset": F.col("_n"), "_buckets": F.lit(1)})
    owns = (F.col("_n") > 0) | (F.lit(lead) & (F.col("_buckets") == 0))
    buckets = before_buckets(buckets, lanes, lasts={"_owner": F.when(owns, bucket)})
    parts = parts.join(buckets, keys)
    continued = (F.col(local_seq) == 0) & F.col("_owner").isNotNull()
    if not lead:
        leads = (F.col(local_seq) == 0) & F.col("_owner").isNull()
        parts = parts.where(~leads | (F.col("_buckets") == 0)).withColumn("_text", F.when(~leads, F.col("_text")))
    piece_of = F.struct(bucket.alias("_b"), F.col("_text").alias("_p"))
    tails = (
        parts.where(continued)
        .groupBy(*lanes.group, "_owner")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece_of)), lambda r: r["_p"]), joiner).alias("_tail"))
        .select(*lanes.group, "_owner.*", "_tail")
    )
    last = (F.col(local_seq) == F.col("_n")) & F.col("_tail").isNotNull()
    return (
        parts.where(~continued)
        .join(tails, keys, "left")
        .select(
            *keys,
            (F.col("_offset") + F.col(local_seq)).alias("record_seq"),
            F.when(last, F.concat_ws(joiner, "_text", "_tail")).otherwise(F.col("_text")).alias("text"),
        )
    )


def dense_ids(df: DataFrame, order: str, out: str, bucket_rows_log2: int = 20) -> DataFrame:
    """Consecutive ids from 1 in the order of a unique non-negative number."""
    levels = {f"_bucket_{bits}": F.shiftright(order, bits) for bits in (bucket_rows_log2 + 12, bucket_rows_log2)}
    return position(df.withColumns(levels), Buckets((), tuple(levels), (order,)), out).drop(*levels)
