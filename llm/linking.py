"""From bucket members to components, for operators that link similar items. No step gathers a bucket, a group or a component."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import stage

#: Rows of a bucket, and their weight in all, that one task compares with as many others; larger buckets are cut into parts.
BLOCK = 2048
BLOCK_WEIGHT = 1 << 20


def members_of(buckets: DataFrame, label: str) -> DataFrame:
    """(key, node, n, total) of buckets with at least two different nodes, from (key, node, weight); n and total: the bucket's rows and weight."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.min("node").alias("low"), F.max("node").alias("high"))
    sizes = sizes.where("low < high").select("key", "n", "total")
    buckets = buckets.select("key", "node")
    return stage(buckets.join(sizes, "key"), label)


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: every node with the most central node of each of its buckets.

    Central is the node whose buckets hold most rows: in a group of variants that is the text they were made
    from. There are fewer pairs than rows, however large the buckets are.
    """
    # a node is in a bucket per band at most, so this window is small for every node
    scored = members.withColumn("score", F.sum("n").over(Window.partitionBy("node")))
    centres = scored.groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("centre"))
    return ordered_pairs(scored.join(centres, "key"), "node", "centre")


def ordered_pairs(df: DataFrame, one: str, other: str) -> DataFrame:
    return df.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of all nodes with an edge; component: the smallest node reachable.

    Alternates the large-star and small-star steps until every component is a star around its
    smallest node; each round is written, so lost executors cost a round at most and plans stay short.
    """
    edges = ordered_pairs(edges, "a", "b")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node move to the smallest of its neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select("b", "m")
        # small star: a node and its smaller neighbours move to the smallest of them
        small = large.join(large.groupBy("b").agg(F.min("m").alias("least")), "b")
        moved = ordered_pairs(small.select(F.col("m").alias("x"), "least").union(small.select(F.col("b").alias("x"), "least")), "x", "least")
        edges = stage(moved, label)
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("hub")).union(edges.select("a", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub")).where("leaf > 1 OR leaf > 0 AND hub > 0").take(1):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, block, node, component) of buckets of three or more that still hold several components.

    What no star pair has decided can only be there. A bucket beyond BLOCK rows or BLOCK_WEIGHT is cut into
    parts; every two parts meet in one block, so that all pairs of the bucket are in some block.
    """
    labelled = members.where("n > 2").join(found, "node", "left").select("key", "n", "total", "node", F.coalesce("component", "node").alias("component"))
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_WEIGHT)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = labelled.join(several, "key").withColumn("own", own)
    block = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.struct(F.least("own", other).alias("low"), F.greatest("own", other).alias("high"))))
    return dealt.select("key", block.alias("block"), "node", "component")
