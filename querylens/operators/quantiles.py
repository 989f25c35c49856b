"""Quantiles: a sketch for everyday use, exact ranks where a figure must be reproducible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.ordering import Buckets, running_total

ACCURACY = 10_000
_VALUES_PER_BUCKET = 4096


def approx_quantile(column: str, q: float) -> Column:
    return F.percentile_approx(column, q, ACCURACY)


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, probabilities: dict[str, float]) -> DataFrame:
    """Per group, the smallest value that at least the given share of rows does not exceed.

    Rows shrink to one count per distinct value before the shuffle; the running count then goes
    over the distinct values in buckets of at most 4096 of them.
    """
    lanes = Buckets(tuple(keys), ("_bucket",), (column,))
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count("*").alias("_count"))
        .withColumn("_bucket", F.floor(F.col(column) / _VALUES_PER_BUCKET))
    )
    ranked = running_total(counts, lanes, F.col("_count"), "_rank")
    if keys:
        ranked = ranked.join(counts.groupBy(*keys).agg(F.sum("_count").alias("_n")), list(keys))
    else:
        ranked = ranked.withColumn("_n", counts.agg(F.sum("_count")).scalar())
    n = F.col("_n").cast("double")
    picks = [
        F.min(F.when(F.col("_rank") >= F.greatest(n - F.floor(n - q * n), F.lit(1)), F.col(column))).alias(name)
        for name, q in probabilities.items()
    ]
    return ranked.groupBy(*keys).agg(*picks)
