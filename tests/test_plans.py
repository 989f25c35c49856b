import pytest
from pyspark.sql import functions as F

from querylens.plans import graph, lines, nodes, signals

def tree_lines(node, depth=0):
    """A tree-form document from nested (id, operator, fragment, facts, children)."""
    number, operator, fragment, facts, *children = node
    yield f"{'--' * depth}[{number:02d}]:[{number}: {operator}]||[Fragment: {fragment}]||" + "".join(f"{fact}||" for fact in facts)
    for child in children:
        yield from tree_lines(child, depth + 1)


def sink(number, fragment, *children):
    return (number, "DataStreamSink", fragment, ["STREAM DATA SINK", f"EXCHANGE ID: {number:02d}", "BUCKET_SHFFULE_HASH_PARTITIONED"], *children)


# Fragment 0 joins what 1 and 2 send; 1 gathers from 3.
SITES = (5, "VOlapScanNode", 2, ["TABLE: lab.site(site)", "cardinality=41"])
PROBES = (2, "VOlapScanNode", 3, ["TABLE: lab.probe(by_day)", "cardinality=6,002,913", "afterFilter=17", "PREDICATES: (depth > 4)"])
LEFT = (17, "VEXCHANGE", 0, ["offset: 0"], sink(17, 1, (12, "VAGGREGATE", 1, ["cardinality=9"], (8, "VEXCHANGE", 1, [], sink(8, 3, PROBES)))))
RIGHT = (19, "VEXCHANGE", 0, ["offset: 0"], sink(19, 2, SITES))
FAN_IN = "\n".join([*tree_lines((21, "ResultSink", 0, ["VRESULT SINK"], (20, "VHASH JOIN", 0, ["equal join conjunct: (site = id)"], LEFT, RIGHT))), "--[no id]:[broken header]||left out||"])
UNSURE = "\n".join(tree_lines((4, "ResultSink", 0, ["VRESULT SINK"], (3, "VREPEAT_NODE", 0, [])))) + "\n\nplanned with unknown column statistics\n"


def plan_lines(fragment, facts, *nodes):
    """A fragment of a plan-form document; nodes are (head, facts)."""
    lines = [f"PLAN FRAGMENT {fragment}", *(f"  {fact}" for fact in facts), ""]
    for head, about in nodes:
        lines += [f"  {head}", *(f"     {fact}" for fact in about), ""]
    return lines


GATHER = plan_lines(0, ["PARTITION: UNPARTITIONED", "HAS_COLO_PLAN_NODE: true"], ("VRESULT SINK", ["MYSQL_PROTOCAL"]), ("6:VMERGING-EXCHANGE", ["limit: 5"]))
READ = plan_lines(
    1,
    ["PARTITION: HASH_PARTITIONED: kind[#9]"],
    ("STREAM DATA SINK", ["EXCHANGE ID: 06", "UNPARTITIONED"]),
    ("0:VOlapScanNode(31)", ["TABLE: lab.ledger(rollup_kind)", "PREDICATES: (kind[#9] = 'b')", "partitions=2/8 (q1,q2)", "tablets=6/6, tabletList=70,71", "cardinality=512"]),
)
VIEWS = ["MATERIALIZATIONS", "RBO.wide_a not chose", "CBO.wide_b fail", "FailInfo: too old", "FailInfo: other grouping", "CBO.wide_c fail", "", "FailInfo: of no view"]
LEDGER = "\n".join([*GATHER, *READ, *VIEWS, "STATISTICS"]) + "\n"
# A node below a join's second side, and facts that come several times.
BESIDE = "PLAN FRAGMENT 0\n  7:VNESTED LOOP JOIN\n  |  join op: CROSS\n  |  runtime filters: RF000\n  |  join op: CROSS\n  |  runtime filters: RF001\n  |----3:VOlapScanNode(8)\n     cardinality=30, avgRowSize=11.5, numNodes=2\n"
BOXED = "+---+\n| Explain String |\n+---+\n" + "".join(f"| {line} |\n" for line in GATHER[:6]) + "+---+---+"
USED = "[01]:[1: VOlapScanNode]||[Fragment: 0]||TABLE: lab.site(site)||tablets=?||\nMATERIALIZATIONS\nRBO.lab.site_day chose\nCBO.lab.site_day chose"


@pytest.fixture(scope="module")
def result(spark):
    docs = dict(enumerate([UNSURE, FAN_IN, LEDGER, BESIDE, "no plan at all", BOXED.replace("\n", "\r\n"), USED]))
    return signals.analyze_plans(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))


@pytest.fixture(scope="module")
def by_doc(result):
    out = {}
    for r in result.nodes.orderBy("doc_id", "node_seq").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_status(result):
    s = {r.doc_id: r for r in result.status.collect()}
    assert [s[i].form for i in range(7)] == ["tree", "tree", "plan", "plan", None, "plan", "tree"]
    assert (s[0].fragments, s[0].n_nodes, s[0].unknown_statistics) == ([0], 2, True)
    assert (s[1].fragments, s[1].bad_headers, s[1].boxed) == ([0, 1, 2, 3], 1, False)
    assert s[5].boxed and s[5].fragments == [0]
    assert s[4].error and not s[4].ok and s[0].ok


def test_tree_nodes(by_doc):
    assert [(n.operator, n.depth) for n in by_doc[0]] == [("ResultSink", 0), ("VREPEAT_NODE", 1)]
    assert [(n.node_id, n.depth) for n in by_doc[1]] == [(21, 0), (20, 1), (17, 2), (17, 3), (12, 4), (8, 5), (8, 6), (2, 7), (19, 2), (19, 3), (5, 4)]
    scan = by_doc[1][7]
    assert (scan.table, scan.cardinality, scan.kv["afterfilter"], scan.predicates) == ("lab.probe(by_day)", "6,002,913", "17", "(depth > 4)")
    assert (scan.ids_raw, scan.node_id, scan.node_seq, scan.fragment_id) == ("02", 2, 7, 3)


def test_plan_nodes(by_doc):
    ops = [(n.operator, n.fragment_id, n.depth) for n in by_doc[2]]
    assert ops == [("PLAN FRAGMENT 0", 0, 0), ("VRESULT SINK", 0, 1), ("VMERGING-EXCHANGE", 0, 1), ("PLAN FRAGMENT 1", 1, 0), ("STREAM DATA SINK", 1, 1), ("VOlapScanNode(31)", 1, 1)]
    scan = by_doc[2][-1]
    assert (scan.table, scan.predicates, scan.kv["partitions"], scan.kv["tablets"]) == ("lab.ledger(rollup_kind)", "(kind[#9] = 'b')", "2/8 (q1,q2)", "6/6")
    join, below = by_doc[3][1], by_doc[3][2]
    assert (join.kv["JOIN_OP"], join.kv["RUNTIME_FILTERS"]) == ("CROSS", "RF000; RF001")
    assert (below.depth, below.kv["avgrowsize"], below.kv["numnodes"]) == (3, "11.5", "2")
    assert [n.operator for n in by_doc[5]] == ["PLAN FRAGMENT 0", "VRESULT SINK"]


def test_signals(result, by_doc):
    scan = by_doc[2][-1]
    assert (scan.predicate_pushdown, scan.partition_pruned, scan.tablet_pruned, scan.rewrite_level, scan.index_name) == (True, True, False, "candidate", "rollup_kind")
    assert (scan.partition_selected, scan.partition_total) == (2, 8)
    hit = by_doc[6][0]
    assert (hit.rewrite_level, hit.chosen_views, hit.tablet_evidence, hit.tablet_pruned) == ("hit", ["lab.site_day"], "?", False)
    views = {r.doc_id: r for r in result.materializations.collect()}
    assert set(views) == {2, 6}
    assert views[2].not_chosen == ["wide_a"]
    assert [tuple(f) for f in views[2].failed] == [("wide_b", "other grouping"), ("wide_c", None)]
    counts = {(r.doc_id, r.fragment_id): r for r in result.fragment_signals.collect()}
    r = counts[(2, 1)]
    assert (r.predicate_pushdown_count, r.pruning_count, r.rewrite_count, r.scan_count) == (1, 1, 1, 1)


def test_graph(result):
    edges = [tuple(r) for r in result.edges.orderBy("doc_id", "from_fragment").collect()]
    assert edges == [(1, 1, 0, ["17"]), (1, 2, 0, ["19"]), (1, 3, 1, ["8"]), (2, 1, 0, ["6"])]
    f = {(r.doc_id, r.fragment_id): r for r in result.fragments.collect()}
    assert [f[(1, i)].level for i in range(4)] == [2, 1, 0, 0]
    assert (f[(1, 0)].upstream, f[(1, 0)].downstream, f[(1, 1)].upstream, f[(1, 1)].root_operator) == (2, 0, 1, "DataStreamSink")
    assert (f[(1, 3)].max_cardinality, f[(1, 3)].tables, f[(1, 3)].producer_exchange_ids) == (6002913.0, ["lab.probe(by_day)"], ["8"])
    assert (f[(2, 0)].partition, f[(2, 0)].has_colocate_plan_node, f[(2, 0)].node_count) == ("UNPARTITIONED", True, 2)
    assert f[(2, 1)].has_colocate_plan_node is None and f[(1, 0)].join_count == 1


def test_levels_with_cycles(spark):
    pairs = {0: [(1, 2), (2, 3), (1, 3), (3, 4)], 1: [(1, 2), (2, 3), (3, 2), (3, 4)], 2: [(1, 2), (2, 1)]}
    edges = spark.createDataFrame([(d, a, b) for d, e in pairs.items() for a, b in e], "doc_id long, from_fragment long, to_fragment long")
    frags = spark.createDataFrame(sorted({(d, x) for d, e in pairs.items() for p in e for x in p}), "doc_id long, fragment_id long")
    got = {(r.doc_id, r.fragment_id): r.level for r in graph.fragment_levels(frags, edges).collect()}
    assert [got[(0, i)] for i in (1, 2, 3, 4)] == [0, 1, 2, 3]
    # 2 is reached from 1 but waits for 3 forever, so it passes nothing on
    assert [got[(1, i)] for i in (1, 2, 3, 4)] == [0, 1, 0, 0]
    assert [got[(2, i)] for i in (1, 2)] == [0, 0]


def test_operator_lists(spark, result):
    df = spark.createDataFrame([("VHASH JOIN",), ("VOlapScanNode",), ("VAGGREGATE",), ("VEXCHANGE",), ("DataStreamSink",), ("VSORT",)], "operator string")
    assert [r[0] for r in df.select(nodes.operator_category(F.col("operator"))).collect()] == ["join", "scan", "agg", "exchange", "sink", "other"]
    kept = [r.operator for r in nodes.telling_operators(result.nodes.where("doc_id = 2")).orderBy("node_seq").collect()]
    assert kept == ["VMERGING-EXCHANGE", "VOlapScanNode(31)"]
    depths = [r.depth for r in nodes.select_fragment(result.nodes.where("doc_id = 1"), 2).orderBy("node_seq").collect()]
    assert depths == [0, 1]


def test_form_is_asked_of_documents(spark):
    """Lines carry their document's form and whether it reports views without being gathered by document again."""
    texts = {0: FAN_IN, 1: LEDGER, 2: BOXED, 3: "+ ]|| +\n|  " + USED.split("\n")[0] + " |\n| Materializations |", 4: ""}
    found = lines.with_form(lines.plan_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    told = {r.doc_id: (r.form, r.has_views, r.is_tree_line) for r in found.where("line_no = 0").collect()}
    assert told == {0: ("tree", False, True), 1: ("plan", True, False), 2: ("plan", False, False), 3: ("tree", True, False), 4: ("plan", False, False)}


def test_exchange_ends_are_staged(result):
    assert "plan-ends" in " ".join(result.edges.inputFiles())
