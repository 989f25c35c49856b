import math
import random
import zlib

import pytest

from llm import cross_parsing as C


def phrases(text, texts):
    """Longest pieces from left to right, ended at every PIECE bytes."""
    n = 0
    for at in range(0, len(text), C.PIECE):
        piece = text[at : at + C.PIECE]
        while piece:
            size = max([k for k in range(1, len(piece) + 1) if any(piece[:k] in t for t in texts)], default=1)
            piece = piece[size:]
            n += 1
    return n


def test_automaton_reads_just_the_substrings():
    draw = random.Random(1)
    for _ in range(20):
        texts = ["".join(draw.choice("ab") for _ in range(draw.randrange(0, 12))).encode() for _ in range(3)]
        automaton = C.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        for n in range(7):
            for k in range(2**n):
                piece = bytes(97 + (k >> j & 1) for j in range(n))
                state = 0
                for c in piece:
                    state = automaton.next[state].get(c) if state is not None else None
                assert (state is not None) == any(piece in t for t in texts)


def test_phrases_against_brute_force(monkeypatch):
    monkeypatch.setattr(C, "PIECE", 16)
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    draw = random.Random(2)
    make = lambda letters, n: "".join(draw.choice(letters) for _ in range(n)).encode()
    samples = {"x": [make("abc", 60), make("abé", 20)], "y": [make("acd ", 80)], "z": [b"q"]}
    model = C.Model(samples)
    texts = [make("abcdé qz", n) for n in (1, 15, 16, 17, 33, 200, 64, 128)]
    got = model.entropies(texts)
    for text, row in zip(texts, got.tolist()):
        expect = [phrases(text, samples[k]) * math.log2(1 + sum(map(len, samples[k]))) / len(text) for k in "xyz"]
        assert row == pytest.approx(expect)


def test_plain():
    assert C.plain(" Ab,1C\nÉ—x ") == "ab c é—x".encode()


def test_rows(spark):
    english, german = "the heathen there then with thing ", "die ungern schweigende heit und mit "
    rows = [(i, (english if i % 2 else german) * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 -- 3", "en"), (103, "Ж 漢字", None), (None, english, None), (None, None, "fr"), (104, german * 9000, None), (104, "UND MIT", None), (105, "the thing", "")]
    df = spark.createDataFrame([(i, t, lang, 1, "s") for i, t, lang in rows], "doc_id long, text string, lang string, score int, lang_pred string").repartition(3)
    out = C.languages(df, "doc_id < 100").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    got = {(r.doc_id, r.lang_pred) for r in out}
    assert {(i, lang) for i, _, lang in rows[:60]} <= got
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (None, "und"), (104, "de"), (105, "en")} <= got
    assert all(r.score == 0 for r in out if r.lang_pred == "und")
    # a lone language, none, and no rows
    assert {r.lang_pred for r in C.languages(df, "doc_id IN (1, 3)").collect()} == {"en", "und"}
    assert {r.lang_pred for r in C.languages(df, "false").collect()} == {"und"}
    assert C.languages(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    real = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    out = C.op13(spark, path).collect()
    assert {r.doc_id for r in out} == set(real)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and any(c.isalpha() for c in real[r.doc_id][1] or "")]
    assert sum(r.lang_pred == real[r.doc_id][0] for r in held) >= 0.98 * len(held) > 100
