import hashlib
import math
import random
import re
import zlib

import numpy as np

from llm import importance_resampling as R


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, aims, percent, least):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)] or [0], minlength=10_000) * bool(texts)
    corpus, target = count([t for _, t in rows]), count(aims)
    s, t = int(corpus.sum()), int(target.sum())
    gain = [math.floor(1000 * math.log((y + 1) * (s + 10_000) / ((x + 1) * (t + 10_000)))) for x, y in zip(corpus.tolist(), target.tolist())]
    out = []
    for i, text in rows:
        found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    place = [(r[:4], n + 1 if n < drawn else None) for n, r in enumerate(able)] + [(r[:4], None) for r in out if not r[4]]
    return sorted(((*r, n) for r, n in place), key=str)


def test_against_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice(["ab", "Zq", "é", "7", "漢"]) for _ in range(draw.randrange(1, 4)))
    rows = [(i, " ,".join(word() for _ in range(draw.randrange(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t. "), (503, "x" * 5000 + " y " + "é" * 400), (503, "again " * 25), (-7, "one two " * 20), (1 << 62, "a b " * 15), (None, "ab ab " * 20), (None, None), (504, "a\x00b/c:d`e{f" * 9)]
    rows += [(600 + i, rows[3][1]) for i in range(20)]
    aims = [" ".join(word() for _ in range(30)), None, "ab Zq 7"]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, score int, digit double").repartition(5)
    target = spark.createDataFrame([(t, 3) for t in aims], "text string, doc_id int")
    monkeypatch.setattr(R, "BLOCK", 3)
    monkeypatch.setattr(R, "STRIDE", 2)
    monkeypatch.setattr(R, "DIGIT", 5)
    got = sorted((tuple(r) for r in R.resample(df, target, percent=60, least_words=5).collect()), key=str)
    assert got == brute(rows, aims, 60, 5)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "doc_id long, text string")
    assert R.resample(none, some).count() == 0
    assert sorted(tuple(r) for r in R.resample(some, none, percent=100, least_words=5).collect()) == brute([(1, "a b c d e"), (2, "a b c d f")], [], 100, 5)
    assert [r["rank"] for r in R.resample(some, some).collect()] == [None, None]


def test_radix_order(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    monkeypatch.setattr(R, "STRIDE", 3)
    draw = random.Random(9)
    rows = [(draw.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 5, draw.randrange(-(1 << 62), 1 << 62)]), draw.randrange(-3, 4), n) for n in range(700)]
    df = spark.createDataFrame(rows, "a long, b long, n int")
    got = {r["rank"]: (r["a"], r["b"]) for r in R.radix_ranked(df, ["a", "b"]).collect()}
    assert [got[k] for k in range(1, 701)] == sorted((a, b) for a, b, _ in rows)
    # equal keys keep their place, and a table of equal rows needs no digit
    same = spark.createDataFrame([(1, n) for n in range(50)], "a long, n int").coalesce(1)
    assert [r["n"] for r in sorted(R.radix_ranked(same, ["a"]).collect(), key=lambda r: r["rank"])] == list(range(50))


def test_checksums():
    texts = ["ab", "", "A" * 300 + " b", "ä 7", " x ", "q" * 49 + " " + "r" * 48 + " " + "s" * 47]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    words, found = R.feature_buckets(np.frombuffer(data, np.uint8), offsets, 1 << 31)
    assert words.tolist() == [len(words_of(t)) for t in texts]
    got = sorted((row, bucket) for buckets, rows in found for bucket, row in zip(buckets.tolist(), rows.tolist()))
    assert got == sorted((i, zlib.crc32(f.encode()) % (1 << 31)) for i, t in enumerate(texts) for f in features(t))
