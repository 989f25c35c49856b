import hashlib
import random
import re

import public_tokenizers
import pytest

from llm import byte_bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoding(RANKS, PATTERN)


def test_slices_keep_ids(enc, monkeypatch):
    draw = random.Random(1)
    monkeypatch.setattr(byte_bpe, "RUN_CHARS", 4)
    monkeypatch.setattr(byte_bpe, "_RUN", re.compile(byte_bpe._RUN.pattern.replace(str(1 << 14), "4")))
    monkeypatch.setattr(byte_bpe.slices, "__defaults__", (30,))
    for _ in range(400):
        text = "".join(draw.choice(["a", "it's", " ", "   ", "\n", "12", "é", "'s", "!", " \n ", "　", "x" * 7, "'"]) for _ in range(300))
        assert "".join(byte_bpe.slices(text)) == text
        assert byte_bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_very_long_texts(enc):
    for text in (" " * 1_500_000 + "x", "ab " + "\n" * 1_200_000, "b" * 300_000, "word it's " * 50_000):
        assert byte_bpe.decode(enc, byte_bpe.encode(enc, text)) == text.encode()
    assert byte_bpe.encode(enc, "word it's " * 20_000) == enc.encode_ordinary("word it's " * 20_000)


def test_rows(spark):
    rows = [(1, "Été it's 12", "a"), (2, None, "b"), (3, "", None), (3, "", None), (None, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(byte_bpe.byte_bpe(df, RANKS, PATTERN, with_ids=True).collect(), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    by_text = {r.decoded_sha256: r for r in out}
    assert len(out) == 5 and by_text[nothing].n_tokens == 0 and by_text[nothing].ids_sha256 == nothing
    assert hashlib.sha256("Été it's 12".encode()).hexdigest() in by_text
    back = byte_bpe.decode_ids(byte_bpe.byte_bpe(df, RANKS, PATTERN, with_ids=True), RANKS, PATTERN).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(t or "" for _, t, _ in rows)
    assert byte_bpe.byte_bpe(df.limit(0), RANKS, PATTERN).count() == 0


def test_query_equals_the_library(spark, sf_dir, enc):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in byte_bpe.op8(spark, sf_dir).collect():
        ids = enc.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
