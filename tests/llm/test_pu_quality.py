import zlib

import numpy as np

from llm import pu_quality as Q

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_risk_recovers_the_prior_and_the_classes():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(0, 1, (4000, Q.N_FEATURES)), draw.normal(0, 1, (1000, Q.N_FEATURES))
    bad[:, :6] += 3
    web = np.concatenate([good[2000:], bad[:600]])
    prior = Q.estimated_prior(good[:2000], web)
    assert abs(prior - 2000 / 2600) < 0.08
    net = Q.train(good[:2000], web, 2000 / 2600)
    assert np.quantile(net.score(good[2000:]), 0.02) > np.quantile(net.score(bad[600:]), 0.95)


def test_features_of_odd_texts():
    for text in ("", " ", "\n\n", "a", "é" * 100_000, "\x00", "word " * 50_000):
        assert Q.features(text).shape == (Q.N_FEATURES,) and np.isfinite(Q.features(text)).all()


def test_query_on_held_out_rows(spark):
    out = {r.doc_id: r for r in Q.op3(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == 1000 and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    judged = [(out[i].predicted, q) for i, q in labels.items() if held(i)]
    assert np.mean([a == b for a, b in judged]) >= 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rule = f"NOT ({Q.HELD_OUT})"
    turned = labels.selectExpr("doc_id", f"CASE WHEN {Q.HELD_OUT} THEN 1 - quality ELSE quality END AS quality")
    one, other = ({r.doc_id: r.score for r in Q.quality(docs, x, rule).collect()} for x in (labels, turned))
    assert one == other


def test_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "")], "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS features")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.quality(df, none).collect()] == [0.5] * 4
    some = spark.createDataFrame([(1, 1), (1, None), (None, 0), (77, 1)], "doc_id long, quality int")
    out = Q.quality(df, some).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert Q.quality(df.limit(0), some).count() == 0
