import pytest
from conftest import values
from pyspark.sql import functions as F

from querylens.operators import dimension, filters, overview, quantiles, samples, series, share, top_sql
from querylens.operators.filters import ALL, QueryFilters
from querylens.ordering import Buckets, carry_last, dense_ids, position
from querylens.schemas import AUDIT_RECORDS, AUDIT_TEMPLATES


@pytest.fixture(scope="module")
def tables(spark):
    def row(i, template, cpu, time, mem, **kw):
        base = dict.fromkeys(f.name for f in AUDIT_RECORDS)
        base.update(dataset_id="d", record_id=i, event_time_ms=1_000 * i, stripped_template_id=template, cpu_time_ms=cpu,
                    query_time_ms=time, peak_memory_bytes=mem, state="EOF", user_name="u", db_name="db")
        base.update(kw)
        return tuple(base[f.name] for f in AUDIT_RECORDS)

    rows = [
        row(0, 1, 10, 5, None),
        row(1, 1, None, 7, 100, state=None),
        row(2, 2, 3, 50, 900, is_internal=True),
        row(3, 2, 4, 60, 800, is_internal=False, error_code=7),
        row(4, 3, None, None, None, user_name="", db_name=None, state="ERR"),
    ]
    records = spark.createDataFrame(rows, AUDIT_RECORDS)
    templates = spark.createDataFrame(
        [("d", 1, "select ?", "x.a"), ("d", 2, "select b", ""), ("d", 3, "other", None)], AUDIT_TEMPLATES
    )
    return records, templates


def test_key_figures(tables):
    r = overview.key_figures(tables[0], exact=True).collect()[0]
    assert (r.records, r.total_cpu_ms, r.total_time_ms, r.failed_count) == (4, 14, 72, 3)
    assert (r.p95_time_ms, r.distinct_users, r.distinct_dbs, r.distinct_templates) == (60, 2, 1, 3)
    empty = overview.key_figures(tables[0], QueryFilters(user_name="nobody")).collect()[0]
    assert (empty.records, empty.total_cpu_ms, empty.failed_count, empty.p95_time_ms) == (0, 0, 0, None)


def test_rates_of_a_single_moment(tables):
    r = overview.workload_rates(overview.key_figures(tables[0], QueryFilters(start_ms=3000, end_ms=4000))).collect()[0]
    assert (r.duration_ms, r.qps, r.avg_concurrency, r.failure_ratio) == (0, None, None, 1.0)


def test_top_lists(tables):
    rows = top_sql.top_sql(*tables, n=2).orderBy("rank").collect()
    assert [(r.template_id, r.exec_count, r.total_cpu_ms, r.table_guess) for r in rows] == [(1, 2, 10, "x.a"), (2, 1, 4, None)]
    assert [r.template for r in top_sql.top_sql(*tables, filters=ALL, search=" SELECT B").collect()] == ["select b"]
    assert values(
        overview.top_tables(*tables, filters=ALL)
    ) == [("x", "a", 2, 10, 12)]
    assert values(overview.top_dimension(tables[0], "user_name", ALL), "name", "exec_count") == [("u", 4)]


def test_share(tables):
    rows = share.share(*tables, filters=ALL, n=1).collect()
    assert [(r.template_key, r.exec_count, r.total_cpu_ms, r.is_others) for r in rows] == [("1", 2, 10, False), ("__others__", 3, 7, True)]
    assert rows[0].cpu_share == pytest.approx(10 / 17)
    assert share.share(*tables, filters=QueryFilters(user_name="nobody")).collect() == []
    memory = share.share(*tables, filters=ALL, metric="memory").collect()
    assert [r.template_key for r in memory] == ["2", "1", "3"] and not any(r.is_others for r in memory)


def test_rank_key():
    assert share.rank_key("memory") == "max_peak_mem_bytes"
    assert share.rank_key("time", "max_peak_mem_bytes") == "total_time_ms"
    assert share.rank_key("cpu", "max_peak_mem_bytes") == "total_cpu_ms"
    assert share.rank_key("cpu", "total_time_ms") == "total_time_ms"


def test_samples_and_dimensions(tables):
    rows = samples.samples(tables[0], 2, ALL, order_by="cpu_time_ms").collect()
    assert [r.record_id for r in rows] == [3, 2]
    assert values(dimension.dimension_top(tables[0], 2, "db_name"), "name", "exec_count") == [("db", 1)]
    assert filters.list_length(0) == 1 and filters.list_length(99_999.9) == 99_999


def test_series(tables):
    rows = series.template_series(tables[0], 1, 1, ALL).orderBy("bucket_ms").collect()
    assert [(r.bucket_ms, r.exec_count, r.total_cpu_ms) for r in rows] == [(0, 1, 10), (1000, 1, 0)]
    assert series.template_series(tables[0], 99).collect() == []
    assert series.plan_buckets(0, 86_400_000, 60) == (60_000, 0, 86_400_000)
    assert series.plan_buckets(0, 15 * 86_400_000, 60) == (60_000, 0, 15 * 86_400_000)
    assert series.plan_buckets(0, 15 * 86_400_000, 60, 2000) == (900_000, 0, 15 * 86_400_000)
    width, first, last = series.plan_buckets(-1, 10**14, 60, 500)
    assert width % 86_400_000 == 0 and (last - first) // width <= 500 and first < 0


def test_exact_quantiles_against_sorting(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(100000)).alias("v"))
    got = {r.k: (r.a, r.b) for r in quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    by_key = {}
    for r in df.collect():
        by_key.setdefault(r.k, []).append(r.v)
    for k, v in by_key.items():
        v.sort()
        assert got[k] == tuple(v[len(v) - int(len(v) - q * len(v)) - 1] for q in (0.5, 0.95))


def test_bucketed_windows_match_plain_ones(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("g"), F.when(F.pmod(F.hash("id"), F.lit(11)) == 0, F.col("id")).alias("v"))
    df = df.withColumn("b", F.shiftright("id", 6))
    lanes = Buckets(("g",), ("b",), ("id",))
    got = {r.id: (r.pos, r.last) for r in carry_last(position(df, lanes, "pos"), lanes, F.col("v"), "last").collect()}
    last, n = {0: None, 1: None}, {0: 0, 1: 0}
    for r in df.orderBy("id").collect():
        n[r.g] += 1
        assert got[r.id] == (n[r.g], last[r.g])
        last[r.g] = r.v if r.v is not None else last[r.g]
    ids = dense_ids(spark.range(0, 50, 7).withColumnRenamed("id", "x"), "x", "n", bucket_rows_log2=3)
    assert values(ids.orderBy("x"), "n") == [(i,) for i in range(1, 9)]


def test_dictionary_is_the_same_without_broadcast(spark):
    from querylens.operators.dictionary import build_dictionary, encode_records

    rows = [(i, f"t{(i * i) % 7}", f"select 1 from x{(i * i) % 7}", "d") for i in range(100)]
    accepted = spark.createDataFrame(rows, "record_id long, template string, stmt_raw string, db_name string")
    results = []
    for limit in (0, 10**9):
        words = build_dictionary(accepted, "ds", limit)
        coded = encode_records(accepted, words, "ds", ["db_name"], limit)
        results.append(
            (values(words.orderBy("stripped_template_id")), values(coded.orderBy("record_id"), "record_id", "stripped_template_id"))
        )
    assert results[0] == results[1]
    assert [r[1:4] for r in results[0][0]] == [(1, "t0", "d.x0"), (2, "t1", "d.x1"), (3, "t4", "d.x4"), (4, "t2", "d.x2")]
