"""The corpus pipeline: quality classifier, line dedup, near-duplicate dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import stage, table
from llm.hyperminhash import near_duplicates
from llm.line_dedup import fresh_name, without_repeats
from llm.pu_quality import HELD_OUT, accepted
from llm.vector_packing import packed_documents


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"), f"NOT ({HELD_OUT})")


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier place of the corpus has; a document of which nothing but blank lines is left goes."""
    out = without_repeats(docs, leave_out_emptied=True)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The one with the smallest id stays; a null id comes last. Rows that repeat an id are documents of their own, of which the text's digest decides;
    of rows that agree in id and text one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").take(1):
        gone = near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    row, number = fresh_name(docs, "row"), fresh_name(docs, "number")
    # numbers in the order of the keys: tasks of a sorted table hold ranges that follow each other
    numbers = stage(docs.select(key.alias(row)).distinct().orderBy(row).withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    numbered = stage(docs.withColumn(row, key).dropDuplicates([row]).join(numbers, row), "pipeline-numbered")
    gone = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), words=5, percent=80).where("NOT kept").select(F.col("doc_id").alias(number))
    return numbered.join(gone, number, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, as op4 returns them."""
    return packed_documents(docs)


STAGES = [("quality classifier", good_quality), ("line dedup", first_lines), ("MinHash near-dedup", one_of_a_group), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and sequence numbers of tasks are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
