"""Exact deduplication by a tree-merge of sorted digest runs.

Every row belongs to one of R = f^L runs (f: the fan-in). At level 0 each run holds one entry per
digest: the best row so far and a count. In round l the f runs whose numbers agree after division
by f^l are merged: the f-way merge of their digest-sorted entries is a sort-based aggregation on
(digest, parent run), so that equal digests of sibling runs meet, the better candidate stays and
the counts add up. After L rounds each digest has one entry. Parents are split over tasks by digest,
so no level gathers a run, and a digest that holds a third of all rows sends one entry per run and level.

The winners go back down the same tree: each level's entries get their parent's winner, and rows get
theirs from their own run. Thus rows of a hot digest are spread over all runs on the way down too.

A level's candidate is verified by the length of the normalised text, which is part of the key beside SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import SPACES, documents, shuffle_width, stage, table

KEY = ["text_sha256", "norm_bytes"]


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def levels_for(spark: SparkSession, fan_in: int) -> int:
    """Rounds so that there are at least as many runs as shuffle partitions."""
    width, levels = shuffle_width(spark), 1
    while fan_in**levels < width:
        levels += 1
    return levels


def digest_rows(df: DataFrame, runs: int) -> DataFrame:
    """Narrow rows: id, run, digest and byte length of the normalised text, and the order of preference."""
    plain = documents(df).withColumn("norm", normalised(F.col("text")))
    return plain.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("norm").cast("long").alias("norm_bytes"),
        # most code points first, then the smallest id; a null id comes after every id
        F.struct((-F.char_length("text")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id").alias("rank"),
    )


def merge_round(entries: DataFrame, fan_in: int) -> DataFrame:
    """One round: sibling runs exchange entries by digest and are merged into their parent run."""
    parents = entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    return parents.groupBy(*KEY, "run").agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))


def exact_dedup(df: DataFrame, fan_in: int = 8) -> DataFrame:
    """Per row of (doc_id, text): keep_id, group_size, kept and the digest of the normalised text.

    Texts are equal when they are identical without ASCII white space; null counts as empty, and all
    empty texts are one group. Of equal texts the one with the most code points stays, then the
    smallest doc_id; a null doc_id comes last and is kept only in a group without any id. Rows that
    repeat the kept row (same id, same length) are kept like it. Extra columns are ignored.
    """
    spark = df.sparkSession
    levels = levels_for(spark, fan_in)
    rows = stage(digest_rows(df, fan_in**levels), "op1-rows")
    tree = [rows.groupBy(*KEY, "run").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))]
    for _ in range(levels):
        tree.append(merge_round(tree[-1], fan_in))
    tree = [tree[0], *(stage(level, "op1-level") for level in tree[1:])]
    winners = tree[-1]
    for entries in reversed(tree[:-1]):
        children = entries.select(*KEY, "run", F.floor(F.col("run") / fan_in).cast("int").alias("parent"))
        above = winners.select(*KEY, F.col("run").alias("parent"), "rank", "n")
        winners = children.join(above, [*KEY, "parent"]).drop("parent")
    found = winners.select(*KEY, "run", F.col("rank").alias("best"), F.col("n").alias("group_size"))
    return rows.join(found, [*KEY, "run"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rank") == F.col("best")).alias("kept"),
        "text_sha256",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)
"""
