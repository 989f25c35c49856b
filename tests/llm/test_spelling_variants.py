import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import spelling_variants as V


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}
    partners = {w: [x for x in words if near(w, x)] for w in words}
    best = {w: min(p, key=lambda x: (-words[x], x)) for w, p in partners.items() if p}
    form = {w: b if words[b] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(partners[w]), words[form[w]] if form.get(w) else None) for w, n in words.items()), key=str)


def corpus(seed):
    draw = random.Random(seed)
    letters = "abcdÀéqrs×"
    bases = ["".join(draw.choice(letters) for _ in range(draw.randrange(7, 12))) for _ in range(40)] + ["listened", "silented", "z" * 70, "y" * 64]

    def varied(w, n):
        for _ in range(n):
            at, c = draw.randrange(len(w)), draw.choice(letters)
            w = draw.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
        return w

    pool = [b for b in bases for _ in range(30)] + [v for b in bases for k in range(12) for v in [varied(b, draw.randrange(1, 3))] * draw.choice([1, 2, 2, 3])]
    draw.shuffle(pool)
    return [(i, " 7".join(w.upper() if draw.random() < 0.1 else w for w in pool[i::90])) for i in range(90)]


@pytest.mark.parametrize("block", [None, 8])
def test_against_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(V, "QUESTIONS", 16)
        monkeypatch.setattr(V, "CHUNK", 64)
    rows = corpus(3) + [(200, None), (201, ""), (202, "a-b c1d"), (None, "listened listende"), (5, "listened listened"), (5, "w" * 3000 + " " + "w" * 3001), (6, "w" * 3000 + " " + "w" * 3001)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = sorted((tuple(r) for r in V.variants(df, block).collect()), key=str)
    expect = brute(rows)
    assert got == expect
    assert sum(r[1] is not None for r in expect) > 20


def test_chain_of_forms(spark):
    a, b, c = "kettledrum", "kettledrums", "kettledrumss"
    df = spark.createDataFrame([(9001, f"{a} " * 300), (9001, f"{b} " * 30), (9001, f"{c} " * 3)], "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in V.variants(df).collect()}
    assert got == {a: (None, a), b: (a, a), c: (b, a)}


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")
    assert V.variants(df).count() == 0 and V.variants(df.limit(0)).count() == 0


def test_search_reaches_every_near_word():
    draw = random.Random(11)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(3, 6))).encode() for _ in range(150)})
    found = [p for x, w in V.block_pairs(words, words) for p in zip(x.tolist(), w.tolist())]
    assert len(found) == len(set(found)) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset((i, j)) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and near(a, b)}


def test_vectors():
    assert V.vectors([b"aab", b"\xe0"]).tolist() == [[3, 0, 2, 1, *[0] * 13], [1, 1, *[0] * 15]]
    assert V.vectors([]).shape == (0, V.LEVELS) and V.vectors([]).dtype == np.int32
