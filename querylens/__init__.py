"""Query-audit analytics on Spark: log ingest, workload queries, schema audit and plan analysis."""
