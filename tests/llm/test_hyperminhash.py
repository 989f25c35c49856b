import random
import re

import numpy as np
import pyarrow as pa
import pytest

from llm import hyperminhash as H


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def brute(rows, words, percent):
    """doc_id → (set size, component)."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for place, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(place)
    tried = {(p, q) for places in holders.values() for k, p in enumerate(places) for q in places[k + 1 :]}
    for p, q in tried:
        (i, a), (j, b) = sets[p], sets[q]
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = top(i), top(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


def test_word_hashes():
    texts = ["One  two\tTHREE é", "", "  ", "one", "\x0btwo\x0c", "x" * 10_000 + " one", "ÀB àb"]
    hashes, counts = H.word_hashes(*H.text_bytes(pa.array(texts)))
    assert counts.tolist() == [4, 0, 0, 1, 1, 2, 2]
    assert hashes[0] == hashes[4] == hashes[7] and hashes[1] == hashes[5] and len(set(hashes.tolist())) == 7


def test_sets_and_registers():
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 5, 200)]
    assert [len(s) for s in H.shingle_sets(*H.text_bytes(pa.array(texts)), 3)] == [len(shingles(t, 3)) for t in texts]
    rng = np.random.default_rng(1)
    got = []
    for j in (0.5, 0.85):
        both = rng.integers(0, 1 << 63, int(2000 * j), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, (2000 - len(both)) // 2, dtype=np.uint64)]) for _ in "ab")
        ra, rb = H.registers(a, 4000), H.registers(b, 4000)
        got.append(float(H.estimate(ra, rb, np.float64(len(a)), np.float64(len(b)))))
    assert abs(got[0] - 0.5) < 0.03 and abs(got[1] - 0.85) < 0.03


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    draw = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for size in (5, 7, 12, 30, 80, 400):
        for _ in range(6):
            base = [draw.choice(vocabulary) for _ in range(size)]
            for _ in range(9):
                copy = list(base)
                for _ in range(draw.choice([0, 0, 1, 1, 2, max(1, size // 25), size // 10])):
                    copy[draw.randrange(size)] = draw.choice(vocabulary)
                rows.append((key, (" " if key % 2 else "\n").join(copy).upper() if key % 3 else " ".join(copy)))
                key += 1
    passage = " ".join(draw.choice(vocabulary) for _ in range(12))
    rows += [(key + i, passage + " " + " ".join(draw.choice(vocabulary) for _ in range(40))) for i in range(60)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "one two"), (9006, "é É")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(df, words, percent).collect()}
    expect = brute(rows, words, percent)
    assert got == expect and len({c for _, c in expect.values()}) < len(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "alone here"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in H.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (None, 0, None, True)], key=str)
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = H.op2(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_copy_without_id(spark):
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(None, " ".join(words)), (7, " ".join(words[:-1] + ["x"]))], "doc_id long, text string")
    assert {tuple(r) for r in H.near_duplicates(df, 3, 85).collect()} == {(7, 38, 7, True), (None, 38, 7, False)}
