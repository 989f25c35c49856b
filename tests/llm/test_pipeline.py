import importlib.util
import pathlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from llm.pu_quality import HELD_OUT, THRESHOLD, quality

HERE = pathlib.Path(__file__).parent


def helper(name):
    spec = importlib.util.spec_from_file_location(f"brute_{name}", HERE / f"test_{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, step in corpus_pipeline.STAGES[:-1]:
        rows = step(spark, docs, sf_dir).collect()
        found.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, docs.schema)
    return found


def test_stages_against_brute_force(spark, sf_dir, outputs):
    docs, kept = outputs[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, f"NOT ({HELD_OUT})").collect()}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, s in scores.items() if s >= THRESHOLD)
    before, after = outputs[1]
    first = helper("line_dedup").brute([(r.doc_id, r.text) for r in before])
    expect = {}
    for r in before:
        lines = r.text.split("\n")
        own = [line for n, line in enumerate(lines) if first[(False, r.doc_id, n)] == (False, r.doc_id, n)]
        if own == lines or any(line.strip() for line in own):
            expect[r.doc_id] = "\n".join(own)
    assert {r.doc_id: r.text for r in after} == expect and all(r.n_chars == len(r.text) for r in after)
    before, after = outputs[2]
    groups = helper("hyperminhash").brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_run(spark, sf_dir, outputs):
    texts = {r.doc_id: r.text for r in outputs[2][1]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ends = {}
    for p in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda p: (p.doc_id, p.start)):
        ids = tokenizer.encode(texts[p.doc_id], add_special_tokens=False).ids + [1]
        assert p.start == ends.get(p.doc_id, 0)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        ends[p.doc_id] = p.start + p.length
    assert ends == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf_dir).count() == 0


def test_repeated_ids(spark, sf_dir):
    """Unique rows stay whatever their ids; of rows that are copies one stays."""
    long = " ".join(f"word{n}" for n in range(40))
    rows = [(3, long), (5, long + " more"), (5, "a text that nothing else is like " + long[::-1]), (5, "short own text"), (None, "short own text"), (9, None), (5, "short own text"), (None, "no id and no copy")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_a_group(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[3], rows[5], rows[7]], key=str)
    lines = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.first_lines(spark, docs, sf_dir).collect()}
    assert lines == {(i, t, t and len(t)) for i, t in (rows[0], rows[2], rows[3], rows[5], rows[7])}
