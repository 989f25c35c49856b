"""Time the headline jobs at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import corpus_logs, corpus_plans, corpus_schema  # noqa: E402
from catalog.corpus_audit import accepted_source, audit_tables  # noqa: E402
from querylens.operators import dimension, overview, samples, series, share, top_sql  # noqa: E402
from querylens.plans.signals import analyze_plans  # noqa: E402
from querylens.schema_audit import detail, scan  # noqa: E402
from querylens.session import get_session  # noqa: E402
from querylens.sources.ingest import ingest  # noqa: E402


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "querylens-bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Inputs of the jobs below are derived first, untimed.
    for kind in ("fe", "header", "dump"):
        corpus_logs.corpus(spark, sf_dir, kind)
    corpus_schema.partitions(spark, sf_dir)
    accepted_source(spark, sf_dir)

    def ingested(kind):
        done = ingest(spark, corpus_logs.corpus(spark, sf_dir, kind), "bench")
        drain(done.records)

    def audited():
        drain(
            detail.schema_audit_detail(
                corpus_schema.definitions(spark, sf_dir),
                corpus_schema.partitions(spark, sf_dir),
                corpus_schema.catalogue_properties(spark, sf_dir),
                corpus_schema.AS_OF,
            )
        )

    def scanned():
        result = scan.schema_audit_scan(
            corpus_schema.catalogue_tables(spark, sf_dir),
            corpus_schema.catalogue_partitions(spark, sf_dir),
            corpus_schema.catalogue_properties(spark, sf_dir),
            corpus_schema.AS_OF,
        )
        drain(result.items)

    def analysed():
        result = analyze_plans(corpus_plans.documents(spark, sf_dir))
        for df in (result.nodes, result.edges, result.fragments, result.fragment_signals):
            drain(df)

    def tables():
        return audit_tables(spark, sf_dir)

    jobs = {
        "store_audit_tables": lambda: tables(),
        "overview": lambda: drain(overview.key_figures(tables()[0])),
        "overview_exact": lambda: drain(overview.key_figures(tables()[0], exact=True)),
        "top_dimensions": lambda: drain(overview.top_dimensions(tables()[0])),
        "top_tables": lambda: drain(overview.top_tables(*tables())),
        "top_sql": lambda: drain(top_sql.top_sql(*tables())),
        "share": lambda: drain(share.share(*tables())),
        "samples": lambda: drain(samples.samples(tables()[0], 2)),
        "template_series": lambda: drain(series.template_series(tables()[0], 2)),
        "dimension_tops": lambda: drain(dimension.dimension_tops(tables()[0], 2)),
        "ingest_server_log": lambda: ingested("fe"),
        "ingest_export": lambda: ingested("header"),
        "ingest_dump": lambda: ingested("dump"),
        "schema_scan": scanned,
        "schema_detail": audited,
        "analyze_plans": analysed,
    }
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
