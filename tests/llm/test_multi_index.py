import math

import numpy as np
import pytest

from llm import multi_index as M


def brute(rows, queries, k):
    """query → [(vec_id, score)] over (vec_id, vector) rows."""
    out = {}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for q in queries:
        asks = min(v for i, v in rows if i == q)
        scores = (x * np.array(asks)).sum(1)
        order = [p for p in np.lexsort((ids, -scores)) if ids[p] != q][:k]
        out[q] = [(int(ids[p]), float(scores[p])) for p in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_radius_is_complete():
    draw = np.random.default_rng(1)
    code = draw.integers(0, 256, (3000, 32), dtype=np.uint8)
    code[:50] = code[0]
    index = M.Index(code)
    for least in (1, 10, 60, 500, 3000, 9000):
        near = set(index.within(code[0], least).tolist())
        distance = np.bitwise_count(code ^ code[0]).sum(1, dtype=int)
        radius = max(distance[list(near)])
        assert near == set(np.flatnonzero(distance <= radius).tolist()) and len(near) >= min(least, 3000)


def test_recall_and_order(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 24)) * draw.uniform(0.5, 3, (6000, 1))
    x[100:400] = x[100]  # a common vector: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    expect, got = brute(rows, range(0, 6000, 100), 20), found(M.nearest(df, "vec_id % 100 = 0", share=0.15))
    hits = sum(len({i for i, _ in expect[q]} & {i for i, _ in got[q]}) for q in expect)
    assert sorted(got) == sorted(expect) and hits >= 0.9 * 20 * len(expect), hits
    for q, pairs in got.items():
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0])) and len(pairs) == 20
        assert all(s == (x[i] * x[q]).sum() for i, s in pairs)
    assert [i for i, _ in got[200]] == [i for i, _ in expect[200]]


@pytest.mark.parametrize("vectors", [[[1.0, 0.0], [0.5, 0.5], [0.0, -2.0]], [[1.0, 2.0]]])
def test_small_tables(spark, vectors):
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expect = {q: p for q, p in brute(rows, range(len(rows)), 20).items() if p}
    assert found(M.nearest(df, "vec_id >= 0")) == expect


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, [-1.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = [(i, v) for i, v in rows if i in (0, 1, 20)]
    assert found(M.nearest(df, "vec_id % 20 = 0")) == brute(fit, (0, 20), 20)
    assert M.nearest(df.limit(0), "true").count() == 0
    assert M.nearest(df, "false").count() == 0


def test_query_recall(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expect, got = brute(rows, [i for i, _ in rows if i % 20 == 0], 20), found(M.op7(spark, sf_dir))
    assert set(got) == set(expect)
    assert sum(len({i for i, _ in expect[q]} & {i for i, _ in got[q]}) for q in expect) >= 0.9 * 20 * len(expect)


@pytest.mark.parametrize("longest", [3, 60])
def test_recall_at_the_default(spark, longest):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 24)) * draw.uniform(0.5, 3, (6000, 1))
    x[5000:5005] *= longest / 3  # a few very long vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expect, got = brute(rows, range(0, 6000, 100), 20), found(M.nearest(df, "vec_id % 100 = 0"))
    hits = sum(len({i for i, _ in expect[q]} & {i for i, _ in got[q]}) for q in expect)
    assert hits >= 0.9 * 20 * len(expect), hits
