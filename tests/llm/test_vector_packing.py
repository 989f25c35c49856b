import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.vector_packing import Limits, Words, op4, pack, vector_pack

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_words_equal_the_library(library):
    words, draw = Words(FILE), random.Random(5)
    alphabet = ["the", "Été", "don't", "'", "'s", "ß", "Ÿ", "İ", "Σ", "ς", "ª", "²", "½", "é", "́", "中", "🙂", " ", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "_", "12", "...", "<|endoftext|>", "µ", "ÿ", "À", "ﬁ", "`", "Å"]
    for _ in range(1500):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(25)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library(text), repr(text)


def check(pieces, limits, whole):
    """Every id once, gapless offsets, limits kept."""
    sequences, got = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        got.setdefault(p.doc_id, []).append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    padding = 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0] + [r.length for r in rows])[:-1].tolist()
        used = sum(r.length for r in rows)
        assert used <= limits.tokens and len(rows) <= limits.segments and sum(r.loss_tokens for r in rows) <= limits.loss
        padding += limits.tokens - used if used & (used - 1) else 0
    for key, ids in whole.items():
        parts = sorted(got[key])
        assert [s for s, _ in parts] == np.cumsum([0] + [len(x) for _, x in parts])[:-1].tolist()
        assert [i for _, x in parts for i in x] == ids
    return padding


@pytest.mark.parametrize("limits", [Limits(64, 64, 64), Limits(64, 3, 64), Limits(64, 8, 20), Limits(100, 5, 7)])
def test_limits(limits):
    draw = random.Random(7)
    items = [(i, np.arange(draw.choice([1, 2, 5, 30, 70, 300]), dtype="<u4").tobytes(), draw.choice([0, 3, 200])) for i in range(200)]
    loss = {i: max(0, len(ids) // 4 - p) for i, ids, p in items}
    seen = dict.fromkeys(loss, 0)
    tokens = 0
    for pieces in pack(iter(items), limits, 16):
        assert sum(p[2] for p in pieces) <= limits.tokens and len(pieces) <= limits.segments and sum(p[5] for p in pieces) <= limits.loss
        for key, start, n, whole, ids, lossy in pieces:
            assert ids == np.arange(start, start + n, dtype="<u4").tobytes()
            seen[key] += lossy
            tokens += n
    assert seen == loss and tokens == sum(len(ids) // 4 for _, ids, _ in items)


@pytest.mark.parametrize("size", [1, 3, 5, 10, 20])
@pytest.mark.parametrize("limits", [Limits(), Limits(2048, 64, 100)])
def test_short_texts_take_no_padding(size, limits):
    """Sequences that the segment or loss limit closes early have a power of two of tokens."""
    ids = np.arange(size, dtype="<u4").tobytes()
    used = []
    for pieces in pack(((i, ids, 0) for i in range(1000)), limits, 256):
        assert len(pieces) <= limits.segments and sum(p[5] for p in pieces) <= limits.loss
        assert all(p[4] == np.arange(p[1], p[1] + p[2], dtype="<u4").tobytes() for p in pieces)
        used.append(sum(p[2] for p in pieces))
    assert sum(used) == 1000 * size and all(n & (n - 1) == 0 for n in used)


def test_rows(spark, library):
    rows = [(1, "One two", "x", 1), (2, None, "y", None), (3, "", "z", -4), (4, "long words " * 3000, None, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n int")
    limits = Limits(256, 8, 200)
    pieces = vector_pack(df.union(df.limit(0)), FILE, limits=limits, prompt="n").collect()
    whole = {i: library(t or "") + [1] for i, t, _, _ in rows}
    check(pieces, limits, whole)
    assert sum(p.loss_tokens for p in pieces) == sum(max(0, len(whole[i]) - max(0, n or 0)) for i, _, _, n in rows)
    twice = vector_pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), FILE).collect()
    assert sum(p.length for p in twice) == 2 * len(library("a b") + [1])
    assert vector_pack(df.limit(0), FILE).count() == 0


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences, ends = {}, {}
    for p in sorted(op4(spark, sf_dir).collect(), key=lambda p: (p.doc_id, p.start)):
        ids = library(texts[p.doc_id]) + [1]
        assert p.start == ends.get(p.doc_id, 0) and p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        ends[p.doc_id] = p.start + p.length
        sequences[p.sequence_id] = sequences.get(p.sequence_id, 0) + p.length
    assert ends == {i: len(library(t) + [1]) for i, t in texts.items()}
    padding = sum(2048 - n for n in sequences.values() if n & (n - 1))
    assert padding <= 0.01 * sum(sequences.values()) and max(sequences.values()) <= 2048
