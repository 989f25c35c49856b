"""Plan-text queries over the derived documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.corpus_plans import analysis, documents, joined_documents, joined_nodes
from catalog.registry import query, table
from querylens.plans import nodes as plan_nodes
from querylens.plans.graph import exchange_ends, fragment_edges, fragment_levels, fragment_summary
from querylens.plans.keyvalues import lookup
from querylens.plans.lines import plan_lines
from querylens.plans.signals import materializations, node_signals

# One row per fragment of a document.
FRAGMENTS = (
    "(SELECT o_orderkey AS doc_id, CAST(o_orderkey % 4 AS BIGINT) AS last, o_orderkey % 2 = 0 AS tree, CAST(f AS BIGINT) AS fragment_id, "
    "floor(o_totalprice) AS card, o_orderstatus AS status FROM orders, (SELECT unnest([0, 1, 2, 3]) AS f) WHERE f <= o_orderkey % 4)"
)
INDEX = "CASE status WHEN 'F' THEN 'orders_mv' WHEN 'P' THEN 'rollup_p' ELSE 'orders' END"


@query(
    "src_29_plan_lines",
    # a tree has two lines per fragment; a plan 10 per inner fragment and 12 for the scanning one; views add 7
    "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 * (o_orderkey % 4 + 1) ELSE 10 * (o_orderkey % 4) + 12 END "
    "+ CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 0 END AS n_lines FROM orders",
)
def src_29(spark, sf):
    return plan_lines(documents(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(
    "set_03_document_status",
    "SELECT o_orderkey AS doc_id, true AS ok, CASE WHEN o_orderkey % 2 = 0 THEN 'tree' ELSE 'plan' END AS form, "
    "CAST((o_orderkey % 4 + 1) * CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS n_nodes, o_orderkey % 4 + 1 AS n_fragments FROM orders",
)
def set_03(spark, sf):
    return analysis(spark, sf).status.select(
        "doc_id", "ok", "form", "n_nodes", F.size("fragments").cast("bigint").alias("n_fragments")
    )


@query(
    "plan_01_scan_nodes",
    f"SELECT doc_id, tree, fragment_id, 'shop.orders(' || {INDEX} || ')' AS \"table\", format('{{:,}}', card::BIGINT) AS cardinality, "
    "'(o = ' || doc_id || ')' AS predicates, CAST(CASE WHEN tree THEN fragment_id * 2 + 1 ELSE 1 END AS INTEGER) AS depth "
    f"FROM {FRAGMENTS} WHERE fragment_id = last",
)
def plan_01(spark, sf):
    scans = analysis(spark, sf).nodes.where("is_scan")
    return scans.select(
        "doc_id", (F.col("form") == "tree").alias("tree"), "fragment_id", "table", "cardinality", "predicates", "depth"
    )


@query(
    "plan_02_plan_form_nodes",
    f"SELECT doc_id, fragment_id, 'PLAN FRAGMENT ' || fragment_id AS operator, CAST(fragment_id * 3 AS INTEGER) AS node_seq FROM {FRAGMENTS} WHERE NOT tree UNION ALL "
    f"SELECT doc_id, fragment_id, CASE WHEN fragment_id = 0 THEN 'VRESULT SINK' ELSE 'STREAM DATA SINK' END, CAST(fragment_id * 3 + 1 AS INTEGER) FROM {FRAGMENTS} WHERE NOT tree UNION ALL "
    f"SELECT doc_id, fragment_id, CASE WHEN fragment_id = last THEN 'VOlapScanNode(85)' ELSE 'VEXCHANGE' END, CAST(fragment_id * 3 + 2 AS INTEGER) FROM {FRAGMENTS} WHERE NOT tree",
)
def plan_02(spark, sf):
    rows = analysis(spark, sf).nodes.where("form = 'plan'")
    return rows.select("doc_id", "fragment_id", "operator", F.col("node_seq").cast("int").alias("node_seq"))


@query(
    "plan_03_key_values",
    f"SELECT doc_id, (doc_id % 3 + 1) || '/3 (p1)' AS partitions, CASE WHEN tree THEN NULL ELSE '2.0' END AS avgrowsize FROM {FRAGMENTS} WHERE fragment_id = last",
)
def plan_03(spark, sf):
    scans = analysis(spark, sf).nodes.where("is_scan")
    return scans.select(
        "doc_id",
        F.try_element_at("kv", F.lit("partitions")).alias("partitions"),
        F.try_element_at("kv", F.lit("avgrowsize")).alias("avgrowsize"),
    )


@query(
    "join_08_fragment_edges",
    f"SELECT doc_id, fragment_id AS from_fragment, fragment_id - 1 AS to_fragment, CAST(fragment_id AS VARCHAR) AS exchange_ids FROM {FRAGMENTS} WHERE fragment_id > 0",
)
def join_08(spark, sf):
    return analysis(spark, sf).edges.withColumn("exchange_ids", F.array_join("exchange_ids", ","))


@query(
    "plan_08_exchange_ids",
    f"SELECT doc_id, fragment_id, 'producer' AS side, CAST(fragment_id AS VARCHAR) AS exchange_id FROM {FRAGMENTS} WHERE fragment_id > 0 UNION ALL "
    f"SELECT doc_id, fragment_id, 'consumer', CAST(fragment_id + 1 AS VARCHAR) FROM {FRAGMENTS} WHERE fragment_id < last",
)
def plan_08(spark, sf):
    return exchange_ends(analysis(spark, sf).nodes).select("doc_id", "fragment_id", "side", "exchange_id")


@query(
    "agg_23_fragment_summary",
    f"SELECT doc_id, fragment_id, CASE WHEN tree THEN NULL ELSE 'HASH' END AS partition, 2::BIGINT AS node_count, 0::BIGINT AS join_count, "
    "CASE WHEN fragment_id = last THEN card END AS max_cardinality, "
    f"CASE WHEN fragment_id = last THEN 'shop.orders(' || {INDEX} || ')' ELSE '' END AS tables, "
    "CASE WHEN tree THEN CASE WHEN fragment_id = 0 THEN 'ResultSink' ELSE 'DataStreamSink' END ELSE CASE WHEN fragment_id = 0 THEN 'VRESULT SINK' ELSE 'STREAM DATA SINK' END END AS root_operator, "
    "CASE WHEN fragment_id > 0 THEN CAST(fragment_id AS VARCHAR) ELSE '' END AS producers, CASE WHEN fragment_id < last THEN CAST(fragment_id + 1 AS VARCHAR) ELSE '' END AS consumers "
    f"FROM {FRAGMENTS}",
)
def agg_23(spark, sf):
    return analysis(spark, sf).fragments.select(
        "doc_id",
        "fragment_id",
        "partition",
        "node_count",
        "join_count",
        "max_cardinality",
        F.array_join("tables", ",").alias("tables"),
        "root_operator",
        F.array_join("producer_exchange_ids", ",").alias("producers"),
        F.array_join("consumer_exchange_ids", ",").alias("consumers"),
    )


@query(
    "plan_09_fragment_levels",
    f"SELECT doc_id, fragment_id, CAST(last - fragment_id AS INTEGER) AS level FROM {FRAGMENTS}",
)
def plan_09(spark, sf):
    return analysis(spark, sf).fragments.select("doc_id", "fragment_id", "level")


GRAPHS = (
    "(SELECT l_suppkey * 2 + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS doc_id, count(*) - 1 AS m FROM lineitem GROUP BY 1)"
)


@query(
    "plan_09_levels_of_graphs",
    "SELECT doc_id, f AS fragment_id, CAST(CASE doc_id % 3 WHEN 0 THEN CASE WHEN f > 0 THEN floor(log2(m // f)) WHEN m > 0 THEN floor(log2(m)) + 1 ELSE 0 END "
    "WHEN 1 THEN m - f ELSE CASE WHEN m < 2 OR f >= m // 2 THEN m - f ELSE 0 END END AS INTEGER) AS level "
    f"FROM (SELECT doc_id, m, unnest(range(0, m + 1)) AS f FROM {GRAPHS})",
)
def plan_09_graphs(spark, sf):
    """A graph per supplier and line status, of as many fragments as it has lines: a tree that gathers two fragments in one, a
    ladder of diamonds, and a chain with a cycle at its middle, behind which nothing is reached."""
    doc = (F.col("l_suppkey") * 2 + (F.col("l_linestatus") == "F").cast("int")).alias("doc_id")
    sizes = table(spark, sf, "lineitem").groupBy(doc).agg((F.count("*") - 1).alias("m"))
    frags = sizes.select("doc_id", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("fragment_id"))
    f, m, half = F.col("fragment_id"), F.col("m"), F.expr("m div 2")
    none = F.lit(None).cast("bigint")
    targets = (
        F.when(F.col("doc_id") % 3 == 0, F.array(F.when(f > 0, F.expr("fragment_id div 2"))))
        .when(F.col("doc_id") % 3 == 1, F.array(F.when(f > 0, f - 1), F.when(f > 1, f - 2)))
        .otherwise(F.array(F.when(f > 0, f - 1), F.when((m >= 2) & (f == half - 1), half).otherwise(none)))
    )
    edges = frags.select("doc_id", f.alias("from_fragment"), F.explode(F.array_compact(targets)).alias("to_fragment"))
    return fragment_levels(frags, edges)


@query(
    "agg_24_fragment_degrees",
    f"SELECT doc_id, fragment_id, (fragment_id < last)::BIGINT AS upstream, (fragment_id > 0)::BIGINT AS downstream FROM {FRAGMENTS}",
)
def agg_24(spark, sf):
    return analysis(spark, sf).fragments.select("doc_id", "fragment_id", "upstream", "downstream")


LEVEL = f"CASE WHEN doc_id % 5 = 0 THEN 'hit' WHEN {INDEX} <> 'orders' THEN 'candidate' ELSE 'none' END"


@query(
    "plan_10_scan_signals",
    f"SELECT doc_id, true AS predicate_pushdown, doc_id % 3 < 2 AS partition_pruned, doc_id % 3 + 1 AS partition_selected, 3::BIGINT AS partition_total, "
    f"round((doc_id % 3 + 1) / 3, 9) AS partition_ratio, {INDEX} AS index_name, {LEVEL} AS rewrite_level FROM {FRAGMENTS} WHERE fragment_id = last",
)
def plan_10(spark, sf):
    scans = analysis(spark, sf).nodes.where("is_scan")
    return scans.select(
        "doc_id",
        "predicate_pushdown",
        "partition_pruned",
        "partition_selected",
        "partition_total",
        F.round("partition_ratio", 9).alias("partition_ratio"),
        "index_name",
        "rewrite_level",
    )


@query(
    "agg_25_fragment_signals",
    f"SELECT doc_id, fragment_id, (fragment_id = last)::BIGINT AS predicate_pushdown_count, (fragment_id = last AND doc_id % 3 < 2)::BIGINT AS pruning_count, "
    f"(fragment_id = last AND {LEVEL} <> 'none')::BIGINT AS rewrite_count, (fragment_id = last)::BIGINT AS scan_count FROM {FRAGMENTS}",
)
def agg_25(spark, sf):
    return analysis(spark, sf).fragment_signals


@query(
    "agg_27_materializations",
    "SELECT o_orderkey AS doc_id, 'mv_' || o_orderkey % 7 AS chosen, 'idle' AS not_chosen, 'other: because ' || o_orderstatus AS failed FROM orders WHERE o_orderkey % 5 = 0",
)
def agg_27(spark, sf):
    return analysis(spark, sf).materializations.select(
        "doc_id",
        F.array_join("chosen", ",").alias("chosen"),
        F.array_join("not_chosen", ",").alias("not_chosen"),
        F.array_join(F.transform("failed", lambda f: F.concat_ws(": ", f["name"], f["reason"])), ",").alias("failed"),
    )


@query(
    "agg_28_distinct_fragments",
    "SELECT o_orderkey AS doc_id, array_to_string(range(0, o_orderkey % 4 + 1), ',') AS fragments FROM orders",
)
def agg_28(spark, sf):
    status = analysis(spark, sf).status
    return status.select("doc_id", F.array_join(F.col("fragments").cast("array<string>"), ",").alias("fragments"))


@query(
    "plan_07_operator_categories",
    f"SELECT category, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'scan' AS category, count(*) AS n FROM {FRAGMENTS} WHERE fragment_id = last UNION ALL "
    f"SELECT 'exchange', count(*) FROM {FRAGMENTS} WHERE fragment_id < last UNION ALL SELECT 'sink', count(*) FROM {FRAGMENTS} UNION ALL "
    f"SELECT 'other', count(*) FROM {FRAGMENTS} WHERE NOT tree) GROUP BY 1",
)
def plan_07(spark, sf):
    rows = analysis(spark, sf).nodes.groupBy(plan_nodes.operator_category(F.col("operator")).alias("category"))
    return rows.agg(F.count("*").alias("n"))


@query(
    "flt_11_telling_operators",
    f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM {FRAGMENTS} UNION ALL SELECT doc_id FROM {FRAGMENTS} WHERE tree AND fragment_id = 0) GROUP BY 1",
)
def flt_11(spark, sf):
    """Scans and exchanges stay; of the tree sinks only the plain result sink does."""
    return plan_nodes.telling_operators(analysis(spark, sf).nodes).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "flt_10_fragment_depths",
    f"SELECT doc_id, fragment_id, CAST(CASE WHEN tree THEN 1 ELSE 2 END AS BIGINT) AS depths FROM {FRAGMENTS}",
)
def flt_10(spark, sf):
    rows = plan_nodes.select_fragment(analysis(spark, sf).nodes)
    return rows.groupBy("doc_id", "fragment_id").agg(F.sum("depth").alias("depths"))


_TREE_HEAD = "repeat('--', CAST(2 * fragment_id AS BIGINT)) || "
_TREE_TAG = "']||[Fragment: ' || fragment_id || ']||"
_PLAIN_SINK = "CASE WHEN fragment_id = 0 THEN 'VRESULT SINK' ELSE 'STREAM DATA SINK' END"
NODES = (
    # tree form: a sink and what feeds it, two levels a fragment
    f"SELECT doc_id, 2 * fragment_id AS node_seq, 'tree' AS form, 2 * fragment_id AS depth, fragment_id, CASE WHEN fragment_id = 0 THEN 'ResultSink' ELSE 'DataStreamSink' END AS operator, "
    f"{_TREE_HEAD} CASE WHEN fragment_id = 0 THEN '[00]:[0: ResultSink' || {_TREE_TAG}VRESULT SINK||' "
    f"ELSE '[0' || fragment_id || ']:[' || fragment_id || ': DataStreamSink' || {_TREE_TAG}STREAM DATA SINK||EXCHANGE ID: 0' || fragment_id || '||' END AS raw_line FROM {FRAGMENTS} WHERE tree UNION ALL "
    f"SELECT doc_id, 2 * fragment_id + 1, 'tree', 2 * fragment_id + 1, fragment_id, CASE WHEN fragment_id < last THEN 'VEXCHANGE' ELSE 'VOlapScanNode' END, "
    f"'--' || {_TREE_HEAD} CASE WHEN fragment_id < last THEN '[0' || (fragment_id + 1) || ']:[' || (fragment_id + 1) || ': VEXCHANGE' || {_TREE_TAG}offset: 0||' "
    f"ELSE '[00]:[0: VOlapScanNode' || {_TREE_TAG}TABLE: shop.orders(' || {INDEX} || ')||cardinality=' || format('{{:,}}', card::BIGINT) || '||PREDICATES: (o = ' || doc_id || ')||partitions=' || (doc_id % 3 + 1) || '/3 (p1)||' END FROM {FRAGMENTS} WHERE tree UNION ALL "
    # plan form: a fragment's line, its sink, its one other node
    f"SELECT doc_id, 3 * fragment_id, 'plan', 0, fragment_id, 'PLAN FRAGMENT ' || fragment_id, 'PLAN FRAGMENT ' || fragment_id FROM {FRAGMENTS} WHERE NOT tree UNION ALL "
    f"SELECT doc_id, 3 * fragment_id + 1, 'plan', 1, fragment_id, {_PLAIN_SINK}, '  ' || {_PLAIN_SINK} FROM {FRAGMENTS} WHERE NOT tree UNION ALL "
    "SELECT doc_id, 3 * fragment_id + 2, 'plan', 1, fragment_id, CASE WHEN fragment_id < last THEN 'VEXCHANGE' ELSE 'VOlapScanNode(85)' END, "
    f"CASE WHEN fragment_id < last THEN '  ' || (fragment_id + 1) || ':VEXCHANGE' ELSE '  0:VOlapScanNode(85)' END FROM {FRAGMENTS} WHERE NOT tree"
)


@query("q_10_plan_nodes", f"SELECT * REPLACE (CAST(node_seq AS BIGINT) AS node_seq, CAST(depth AS INTEGER) AS depth) FROM ({NODES})")
def q_10(spark, sf):
    return analysis(spark, sf).nodes.select("doc_id", "node_seq", "form", "depth", "fragment_id", "operator", "raw_line")


@query(
    "agg_26_repeated_keys",
    "SELECT c_custkey AS doc_id, 'INNER JOIN' AS join_op, CASE c_nationkey % 3 WHEN 0 THEN 'RF000' ELSE 'RF000; RF00' || c_nationkey % 3 END AS runtime_filters FROM customer",
)
def agg_26(spark, sf):
    """Equal values of a repeated key are one, different ones are joined."""
    _, nodes = joined_nodes(spark, sf)
    joins = nodes.where(F.startswith("operator", F.lit("VHASH JOIN")))
    return joins.select("doc_id", lookup(F.col("kv"), "JOIN_OP").alias("join_op"), lookup(F.col("kv"), "RUNTIME_FILTERS").alias("runtime_filters"))


@query(
    "sort_10_edge_exchange_ids",
    "SELECT c_custkey AS doc_id, 1::BIGINT AS from_fragment, 0::BIGINT AS to_fragment, (c_nationkey % 8 + 2) || ',' || (c_custkey % 90 + 10) AS exchange_ids FROM customer",
)
def sort_10(spark, sf):
    """Two exchanges between the same fragments are one edge, their ids sorted as numbers."""
    _, nodes = joined_nodes(spark, sf)
    return fragment_edges(exchange_ends(nodes)).withColumn("exchange_ids", F.array_join("exchange_ids", ","))


@query(
    "plan_13_runtime_filters",
    "SELECT c_custkey AS doc_id, f AS fragment_id, (f = 0)::BIGINT AS runtime_filter_count, (f = 0)::BIGINT AS join_count, CASE f WHEN 0 THEN 4 ELSE 3 END::BIGINT AS node_count, "
    "CASE f WHEN 0 THEN CASE c_nationkey % 3 WHEN 0 THEN 'RF000' ELSE 'RF000; RF00' || c_nationkey % 3 END END AS runtime_filters FROM customer, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS f)",
)
def plan_13(spark, sf):
    lines, nodes = joined_nodes(spark, sf)
    told = node_signals(nodes, materializations(lines)).groupBy("doc_id", "fragment_id").agg(F.max("runtime_filters").alias("runtime_filters"))
    counts = fragment_summary(nodes, exchange_ends(nodes)).select("doc_id", "fragment_id", "runtime_filter_count", "join_count", "node_count")
    return counts.join(told, ["doc_id", "fragment_id"])


@query(
    "plan_14_unknown_statistics",
    "SELECT c_custkey AS doc_id, true AS ok, c_custkey % 3 = 0 AS unknown_statistics, 9::BIGINT AS n_nodes FROM customer",
)
def plan_14(spark, sf):
    lines, nodes = joined_nodes(spark, sf)
    status = plan_nodes.document_status(joined_documents(spark, sf), lines, nodes)
    return status.select("doc_id", "ok", "unknown_statistics", "n_nodes")
