"""One plan document per row of ``orders``: tree form for even keys, plan form for odd ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import stored, table
from querylens.plans.lines import plan_lines, with_form
from querylens.plans.nodes import parse_nodes
from querylens.plans.signals import PlanAnalysis, analyze_plans
from querylens.session import stage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of 1 to 4 fragments, the last one scans; every 5th plan reports materialised views."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        (F.col("o_orderkey") % 4).cast("int").alias("last"),
        F.format_number(F.floor("o_totalprice"), 0).alias("card"),
        F.when(F.col("o_orderstatus") == "F", "orders_mv")
        .when(F.col("o_orderstatus") == "P", "rollup_p")
        .otherwise("orders")
        .alias("index"),
        F.col("o_orderstatus").alias("status"),
        F.concat((F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("/3 (p1)")).alias("parts"),
    )
    number = F.col("doc_id").cast("string")

    def two(f):
        return F.lpad(f.cast("string"), 2, "0")

    def tree(f):
        dashes = F.repeat(F.lit("--"), f * 2)
        tag = F.concat(F.lit("||[Fragment: "), f.cast("string"), F.lit("]||"))
        sink = F.when(f == 0, F.concat(F.lit("[00]:[0: ResultSink]"), tag, F.lit("VRESULT SINK||"))).otherwise(
            F.concat(F.lit("["), two(f), F.lit("]:["), f.cast("string"), F.lit(": DataStreamSink]"), tag, F.lit("STREAM DATA SINK||EXCHANGE ID: "), two(f), F.lit("||"))
        )
        body = F.when(
            f < F.col("last"),
            F.concat(F.lit("["), two(f + 1), F.lit("]:["), (f + 1).cast("string"), F.lit(": VEXCHANGE]"), tag, F.lit("offset: 0||")),
        ).otherwise(
            F.concat(F.lit("[00]:[0: VOlapScanNode]"), tag, F.lit("TABLE: shop.orders("), "index", F.lit(")||cardinality="), "card", F.lit("||PREDICATES: (o = "), number, F.lit(")||partitions="), "parts", F.lit("||"))
        )
        return F.concat(dashes, sink, F.lit("\n--"), dashes, body)

    def plan(f):
        head = F.concat(F.lit("PLAN FRAGMENT "), f.cast("string"), F.lit("\n  PARTITION: HASH\n\n"))
        sink = F.when(f == 0, F.lit("  VRESULT SINK\n     MYSQL_PROTOCAL\n\n")).otherwise(
            F.concat(F.lit("  STREAM DATA SINK\n    EXCHANGE ID: "), two(f), F.lit("\n    UNPARTITIONED\n\n"))
        )
        body = F.when(f < F.col("last"), F.concat(F.lit("  "), (f + 1).cast("string"), F.lit(":VEXCHANGE\n     offset: 0\n"))).otherwise(
            F.concat(F.lit("  0:VOlapScanNode(85)\n     TABLE: shop.orders("), "index", F.lit(")\n     PREDICATES: (o = "), number, F.lit(")\n     partitions="), "parts", F.lit("\n     cardinality="), "card", F.lit(", avgRowSize=2.0, numNodes=3\n"))
        )
        return F.concat(head, sink, body)

    fragments = F.sequence(F.lit(0), F.col("last"))
    text = F.when(F.col("doc_id") % 2 == 0, F.array_join(F.transform(fragments, tree), "\n")).otherwise(
        F.array_join(F.transform(fragments, plan), "\n")
    )
    views = F.when(
        F.col("doc_id") % 5 == 0,
        F.concat(F.lit("\n== MATERIALIZATIONS ==\nRBO.mv_"), (F.col("doc_id") % 7).cast("string"), F.lit(" chose\nCBO.other fail\nFailInfo: first\nFailInfo: because "), "status", F.lit("\nCBO.idle not chose\n")),
    ).otherwise(F.lit(""))
    return rows.select("doc_id", F.concat(text, views).alias("text"))


def analysis(spark: SparkSession, sf_dir: str) -> PlanAnalysis:
    return stored(spark, sf_dir, "plans", lambda: analyze_plans(documents(spark, sf_dir)))


def joined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan per row of ``customer``: a join with repeated facts and runtime filters, fed twice by one fragment; every third
    plan was made without statistics."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        (F.col("c_nationkey") % 8 + 2).cast("string").alias("low"),
        (F.col("c_custkey") % 90 + 10).cast("string").alias("high"),
        (F.col("c_nationkey") % 3).cast("string").alias("filter"),
        F.col("c_mktsegment").alias("segment"),
    )
    lines = [
        "PLAN FRAGMENT 0\n  PARTITION: UNPARTITIONED\n\n  VRESULT SINK\n     MYSQL_PROTOCAL\n\n  200:VHASH JOIN(40)\n  |  join op: INNER JOIN\n",
        "  |  runtime filters: RF000\n  |  join op: INNER JOIN\n  |  runtime filters: RF00",
        F.col("filter"),
        "\n  |----",
        F.col("high"),
        ":VEXCHANGE\n  |       offset: 0\n  |\n  ",
        F.col("low"),
        ":VEXCHANGE\n     offset: 0\n\nPLAN FRAGMENT 1\n  PARTITION: HASH\n\n  STREAM DATA SINK\n    EXCHANGE ID: 0",
        F.col("high"),
        "\n    UNPARTITIONED\n\n  STREAM DATA SINK\n    EXCHANGE ID: 0",
        F.col("low"),
        "\n    UNPARTITIONED\n\n  0:VOlapScanNode(8)\n     TABLE: shop.customer(",
        F.col("segment"),
        ")\n     cardinality=40\n",
        F.when(F.col("doc_id") % 3 == 0, "\nplanned with unknown column statistics\n").otherwise(""),
    ]
    return rows.select("doc_id", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("text"))


def joined_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and nodes of those plans."""

    def build() -> tuple[DataFrame, DataFrame]:
        lines = stage(with_form(plan_lines(joined_documents(spark, sf_dir))), "joined-lines")
        return lines, stage(parse_nodes(lines), "joined-nodes")

    return stored(spark, sf_dir, "joined-plans", build)
