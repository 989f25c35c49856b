"""Fragment graph: data-exchange edges, per-fragment summary, levels and degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions import coerce
from querylens.plans.keyvalues import lookup
from querylens.plans.nodes import is_fragment_header

_EXCHANGE_ID = r"(?i)EXCHANGE\s+ID\s*:\s*([0-9]+)"
_STREAM_SINK = r"(?i)STREAM\s+DATA\s+SINK"
FRAGMENT = ["doc_id", "fragment_id"]


def plain_id(text: Column) -> Column:
    """Exchange id without leading zeros."""
    trimmed = coerce.trim(text)
    return F.when(trimmed.rlike(r"^[0-9]{1,18}\z"), trimmed.try_cast("bigint").cast("string")).otherwise(
        F.nullif(trimmed, F.lit(""))
    )


def sorted_ids(ids: Column) -> Column:
    """Distinct texts, numbers by value."""
    keyed = F.transform(F.array_distinct(ids), lambda x: F.struct(number_of(x).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda r: r["x"])


def number_of(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{1,18}\z"), text).try_cast("bigint")


def exchange_ends(nodes: DataFrame) -> DataFrame:
    """``doc_id, fragment_id, exchange_id, side`` of every node that sends or receives data."""
    op = F.upper("operator")
    text = F.concat_ws("\n", F.array_join("segments", "\n"), F.col("raw_line"))
    consumer = F.contains(op, F.lit("EXCHANGE")) & ~F.contains(op, F.lit("STREAM DATA SINK")) & ~F.endswith(op, F.lit("SINK"))
    producer = op.rlike(_STREAM_SINK) | F.contains(op, F.lit("DATASTREAMSINK")) | text.rlike(_STREAM_SINK)
    named = F.coalesce(
        plain_id(lookup(F.col("kv"), "EXCHANGE ID")), plain_id(F.regexp_extract(text, _EXCHANGE_ID, 1))
    )
    side = F.when(consumer, "consumer").when(producer, "producer")
    own = F.when(consumer, F.coalesce(F.col("node_id").cast("string"), plain_id(F.col("ids_raw"))))
    return (
        nodes.where(F.col("fragment_id").isNotNull())
        .select(*FRAGMENT, side.alias("side"), F.coalesce(named, own).alias("exchange_id"))
        .where(F.col("side").isNotNull() & F.col("exchange_id").isNotNull())
        .distinct()
    )


def fragment_edges(ends: DataFrame) -> DataFrame:
    """``doc_id, from_fragment, to_fragment, exchange_ids``."""
    producers = ends.where("side = 'producer'").select("doc_id", "exchange_id", F.col("fragment_id").alias("from_fragment"))
    consumers = ends.where("side = 'consumer'").select("doc_id", "exchange_id", F.col("fragment_id").alias("to_fragment"))
    return (
        producers.join(consumers, ["doc_id", "exchange_id"])
        .where(F.col("from_fragment") != F.col("to_fragment"))
        .groupBy("doc_id", "from_fragment", "to_fragment")
        .agg(sorted_ids(F.collect_set("exchange_id")).alias("exchange_ids"))
    )


def fragment_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, fragment_id, level``: longest way from a source fragment.

    A fragment passes its level on once all fragments before it are settled, so fragments on a
    cycle keep the best level that reached them. One document's graph is one row: every round takes
    off the fragments that wait for none, and with them the edges they send, each of them once.
    """
    fragments = nodes.where(F.col("fragment_id").isNotNull()).select(*FRAGMENT).distinct()
    before = edges.groupBy("doc_id", F.col("to_fragment").alias("fragment_id")).agg(
        F.collect_set("from_fragment").alias("before")
    )
    none = F.array().cast("array<bigint>")
    node = F.struct(
        F.col("fragment_id").alias("f"), F.coalesce("before", none).alias("before"), F.lit(0).alias("level")
    )
    graphs = fragments.join(before, FRAGMENT, "left").groupBy("doc_id").agg(F.collect_list(node).alias("waiting"))
    ready = F.filter("waiting", lambda n: F.size(n["before"]) == 0)
    waiting = F.filter("waiting", lambda n: F.size(n["before"]) > 0)
    start = F.struct(
        F.array().cast("array<struct<f:bigint,level:int>>").alias("done"),
        ready.alias("ready"),
        waiting.alias("waiting"),
    )

    def peel(state: Column, _round: Column) -> Column:
        taken = F.transform(state["ready"], lambda n: n["f"])

        def reached(n: Column) -> Column:
            levels = F.filter(state["ready"], lambda r: F.array_contains(n["before"], r["f"]))
            return F.struct(
                n["f"].alias("f"),
                F.array_except(n["before"], taken).alias("before"),
                F.greatest(n["level"], F.coalesce(F.array_max(F.transform(levels, lambda r: r["level"] + 1)), F.lit(0))).alias("level"),
            )

        def split(rest: Column) -> Column:
            return F.struct(
                F.concat(state["done"], F.transform(state["ready"], _level_of)).alias("done"),
                F.filter(rest, lambda n: F.size(n["before"]) == 0).alias("ready"),
                F.filter(rest, lambda n: F.size(n["before"]) > 0).alias("waiting"),
            )

        return F.when(F.size(state["ready"]) == 0, state).otherwise(
            coerce.once(F.transform(state["waiting"], reached), split)
        )

    def ended(state: Column) -> Column:
        return F.concat(state["done"], F.transform(F.concat(state["ready"], state["waiting"]), _level_of))

    final = F.aggregate(F.sequence(F.lit(1), F.size("waiting")), start, peel, ended)
    return graphs.select("doc_id", F.explode(final).alias("s")).select(
        "doc_id", F.col("s.f").alias("fragment_id"), F.col("s.level").alias("level")
    )


def _level_of(node: Column) -> Column:
    return F.struct(node["f"].alias("f"), node["level"].alias("level"))


def fragment_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of distinct fragments before and after every fragment."""
    fragments = nodes.where(F.col("fragment_id").isNotNull()).select(*FRAGMENT).distinct()
    up = edges.groupBy("doc_id", F.col("to_fragment").alias("fragment_id")).agg(
        F.count_distinct("from_fragment").alias("upstream")
    )
    down = edges.groupBy("doc_id", F.col("from_fragment").alias("fragment_id")).agg(
        F.count_distinct("to_fragment").alias("downstream")
    )
    return fragments.join(up, FRAGMENT, "left").join(down, FRAGMENT, "left").fillna(0, subset=["upstream", "downstream"])


def fragment_summary(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Counts, tables, root operator, partitioning and exchange ids per fragment."""
    op = F.upper("operator")
    rows = nodes.where(F.col("fragment_id").isNotNull()).withColumn("_head", is_fragment_header(F.col("operator")))
    payload = ~F.col("_head")
    head_kv = F.min(F.when(F.col("_head"), F.struct("node_seq", lookup(F.col("kv"), "PARTITION").alias("p"), lookup(F.col("kv"), "HAS_COLO_PLAN_NODE").alias("c"))))
    summary = rows.groupBy(*FRAGMENT).agg(
        head_kv.alias("_h"),
        F.min(F.when(payload, F.struct("node_seq", "operator"))).alias("_root"),
        F.count_if(payload).alias("node_count"),
        F.count_if(payload & op.rlike(r"\bJOIN\b")).alias("join_count"),
        F.count_if(payload & op.rlike(r"\bSCAN\b")).alias("scan_count"),
        F.count_if(payload & (F.coalesce(lookup(F.col("kv"), "RUNTIME_FILTERS"), F.lit("")) != "")).alias(
            "runtime_filter_count"
        ),
        F.max(F.when(payload, coerce.number_like(F.col("cardinality")))).alias("max_cardinality"),
        F.array_sort(
            F.collect_set(F.when(payload & (coerce.trim(F.col("table")) != ""), F.col("table")))
        ).alias("tables"),
    )
    sides = ends.groupBy(*FRAGMENT).agg(
        sorted_ids(F.collect_set(F.when(F.col("side") == "producer", F.col("exchange_id")))).alias("producer_exchange_ids"),
        sorted_ids(F.collect_set(F.when(F.col("side") == "consumer", F.col("exchange_id")))).alias("consumer_exchange_ids"),
    )
    none = F.array().cast("array<string>")
    return summary.join(sides, FRAGMENT, "left").select(
        *FRAGMENT,
        F.col("_h.p").alias("partition"),
        (F.lower(coerce.trim(F.col("_h.c"))) == "true").alias("has_colocate_plan_node"),
        F.col("_root.operator").alias("root_operator"),
        "node_count",
        "join_count",
        "scan_count",
        "runtime_filter_count",
        "max_cardinality",
        "tables",
        F.coalesce("producer_exchange_ids", none).alias("producer_exchange_ids"),
        F.coalesce("consumer_exchange_ids", none).alias("consumer_exchange_ids"),
    )
