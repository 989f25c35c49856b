"""Optimisation signals: predicate pushdown, pruning, transparent rewrites."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions import coerce
from querylens.plans.graph import (
    exchange_ends,
    fragment_degrees,
    fragment_edges,
    fragment_levels,
    fragment_summary,
)
from querylens.plans.keyvalues import lookup
from querylens.plans.lines import by_doc, plan_lines, with_form
from querylens.plans.nodes import document_status, is_fragment_header, parse_nodes
from querylens.session import stage

_OUTCOME = r"(?i)^(?:RBO|CBO)\.(\S+)\s+(chose|not chose|fail)\z"
_REASON = r"(?i)^FailInfo:\s*(.+)\z"
_PRUNED = r"([0-9]+)\s*/\s*([0-9]+)"


def materializations(lines: DataFrame) -> DataFrame:
    """``doc_id, chosen, not_chosen, failed`` for documents that report materialised views.

    A reason belongs to the failure right before it; of several in a row the last one counts.
    """
    rows = lines.where(F.col("line").isNotNull() & F.col("has_views"))
    text = coerce.trim(F.col("line"))
    rows = rows.select(
        "doc_id",
        "line_no",
        F.lower(F.regexp_replace(F.regexp_extract(text, _OUTCOME, 2), r"\s+", " ")).alias("outcome"),
        F.regexp_extract(text, _OUTCOME, 1).alias("name"),
        F.nullif(coerce.trim(F.regexp_extract(text, _REASON, 1)), F.lit("")).alias("reason"),
    )
    upto = by_doc().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.sum(F.col("reason").isNull().cast("int")).over(upto))
    islands = rows.groupBy("doc_id", "_island").agg(
        F.max(F.when(F.col("reason").isNull(), F.struct("line_no", "outcome", "name"))).alias("h"),
        F.max(F.when(F.col("reason").isNotNull(), F.struct("line_no", "reason"))).alias("r"),
    )

    def named(outcome: str) -> Column:
        rows_of = F.when(F.col("h.outcome") == outcome, F.struct("h.line_no", "h.name"))
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(rows_of)), lambda r: r["name"]))

    failed = F.when(
        F.col("h.outcome") == "fail",
        F.struct(F.col("h.line_no").alias("line_no"), F.col("h.name").alias("name"), F.col("r.reason").alias("reason")),
    )
    summary = islands.groupBy("doc_id").agg(
        named("chose").alias("chosen"),
        named("not chose").alias("not_chosen"),
        F.transform(
            F.array_sort(F.collect_list(failed)), lambda r: F.struct(r["name"].alias("name"), r["reason"].alias("reason"))
        ).alias("failed"),
    )
    return summary.where((F.size("chosen") > 0) | (F.size("not_chosen") > 0) | (F.size("failed") > 0))


def pruning(value: Column, prefix: str) -> dict[str, Column]:
    """``selected/total`` of a scan: active when fewer are read than there are."""
    selected = F.nullif(F.regexp_extract(value, _PRUNED, 1), F.lit("")).try_cast("bigint")
    total = F.nullif(F.regexp_extract(value, _PRUNED, 2), F.lit("")).try_cast("bigint")
    known = total > 0
    return {
        f"{prefix}_pruned": F.coalesce(known & (selected < total), F.lit(False)),
        f"{prefix}_selected": F.when(known, selected),
        f"{prefix}_total": F.when(known, total),
        f"{prefix}_ratio": F.when(known, selected / F.nullif(total, F.lit(0))),
        f"{prefix}_evidence": F.nullif(value, F.lit("")),
    }


def node_signals(nodes: DataFrame, views: DataFrame) -> DataFrame:
    """Nodes with their signals as columns; ``views`` comes from ``materializations``."""
    kv = F.col("kv")
    evidence = coerce.first_non_blank(
        [F.col("predicates"), lookup(kv, "PREDICATES"), lookup(kv, "FRONTEND_PREDICATES")]
    )
    table = F.coalesce(F.col("table"), lookup(kv, "TABLE"))
    index = F.nullif(coerce.trim(F.regexp_extract(table, r"\(([^()]+)\)\s*\z", 1)), F.lit(""))
    joined = nodes.join(views.select("doc_id", F.col("chosen").alias("chosen_views")), "doc_id", "left")
    signalled = joined.withColumns(
        {
            "predicate_evidence": evidence,
            "index_name": index,
            "is_scan": F.contains(F.upper("operator"), F.lit("SCAN")),
            "runtime_filters": F.nullif(coerce.trim(lookup(kv, "RUNTIME_FILTERS")), F.lit("")),
            **pruning(lookup(kv, "partitions"), "partition"),
            **pruning(lookup(kv, "tablets"), "tablet"),
        }
    )
    hit = F.col("is_scan") & (F.size(F.coalesce("chosen_views", F.array().cast("array<string>"))) > 0)
    candidate = F.col("is_scan") & F.col("index_name").rlike("(?i)mv|rollup|materialized|agg")
    return signalled.withColumn("predicate_pushdown", F.col("predicate_evidence").isNotNull()).withColumn(
        "rewrite_level", F.when(hit, "hit").when(candidate, "candidate").otherwise("none")
    )


def fragment_signals(signals: DataFrame) -> DataFrame:
    """Counts of nodes with each signal per fragment."""
    rows = signals.where(F.col("fragment_id").isNotNull() & ~is_fragment_header(F.col("operator")))
    return rows.groupBy("doc_id", "fragment_id").agg(
        F.count_if("predicate_pushdown").alias("predicate_pushdown_count"),
        F.count_if(F.col("partition_pruned") | F.col("tablet_pruned")).alias("pruning_count"),
        F.count_if(F.col("rewrite_level") != "none").alias("rewrite_count"),
        F.count_if("is_scan").alias("scan_count"),
    )


@dataclass
class PlanAnalysis:
    status: DataFrame
    nodes: DataFrame
    materializations: DataFrame
    fragment_signals: DataFrame
    #: Nodes as staged, without signals.
    parsed: DataFrame

    @cached_property
    def ends(self) -> DataFrame:
        """Exchange ends, staged once for all that is asked of the graph."""
        return stage(exchange_ends(self.parsed), "plan-ends")

    @cached_property
    def edges(self) -> DataFrame:
        return fragment_edges(self.ends)

    @cached_property
    def fragments(self) -> DataFrame:
        key = ["doc_id", "fragment_id"]
        return (
            fragment_summary(self.parsed, self.ends)
            .join(fragment_levels(self.parsed, self.edges), key)
            .join(fragment_degrees(self.parsed, self.edges), key)
        )


def analyze_plans(docs: DataFrame) -> PlanAnalysis:
    """All tables for a corpus of plans. Lines and nodes are staged once, as every table needs them."""
    lines = stage(with_form(plan_lines(docs)), "plan-lines")
    nodes = stage(parse_nodes(lines), "plan-nodes")
    views = materializations(lines)
    signals = node_signals(nodes, views)
    return PlanAnalysis(
        status=document_status(docs, lines, nodes),
        nodes=signals,
        materializations=views,
        fragment_signals=fragment_signals(signals),
        parsed=nodes,
    )
