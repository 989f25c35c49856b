import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from llm import ppm


def brute(train, order):
    """log10 probability of a text by walking the trie symbol by symbol."""
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    for text in train:
        data = b"\xff" * order + text.encode() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                trie[k][data[i - k : i]][data[i]] += 1

    def score(text):
        data, total = b"\xff" * order + text.encode() + b"\xff", 0.0
        for i in range(order, len(data)):
            out = set()
            for k in range(order, -1, -1):
                seen = trie[k].get(data[i - k : i], Counter())
                left = {s: n for s, n in seen.items() if s not in out}
                whole = sum(left.values())
                if data[i] in left:
                    total += math.log10((2 * left[data[i]] - 1) / (2 * whole))
                    break
                if whole:
                    total += math.log10(len(left) / (2 * whole))
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total

    return score


def base(train, text):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]
    counts = Counter(w for t in train for w in words(t))
    whole, kinds = sum(counts.values()), len(counts)
    own = words(text)
    return len(own), sum(w in counts for w in own), whole, sum(math.log10((counts[w] + 0.5) / (whole + 0.5 * (kinds + 1))) for w in own)


def test_model_sums_to_one():
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab c") for _ in range(40)) for _ in range(20)]
    score = brute(texts, 3)
    grams, sizes = ppm.grams_of(*text_parts(texts), 3)
    keys, n = ppm.counted(grams)
    low = ppm.Order(keys, n, 0, None)
    orders = ppm.orders_of(keys, n, 3, [low, ppm.Order(keys, n, 1, low)])
    assert np.isclose(ppm.log_probabilities(orders, grams).sum(), sum(map(score, texts)))
    for context in (0x616263, 0x7A7A61, 0x7A7A7A):
        every = np.arange(256, dtype=np.uint64) + np.uint64(context << 8)
        logs = ppm.log_probabilities(orders, every)
        assert np.isclose((10.0**logs).sum(), 1, atol=0.5) and (10.0**logs).sum() <= 1 + 1e-9


def text_parts(texts):
    return ppm.text_bytes(pa.array(texts))


def rows_of(seed, n):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(["the", "The", "of", "été", "x1", "rare%d" % draw.randrange(50)]) for _ in range(draw.randrange(30)))) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = rows_of(4, 120) + [(900, ""), (901, None), (902, "unseen Ω"), (903, "a" * 3000)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [t or "" for i, t in rows if not held(i)]
    score = brute(train, ppm.ORDER)
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double").repartition(4)
    out = {r.doc_id: r for r in ppm.ppm_scores(df, "crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 1").collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        n, known, whole, expect = base(train, text or "")
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (n, known, whole)
        assert math.isclose(out[i].base_score, expect, rel_tol=1e-9) and math.isclose(out[i].score, score(text or ""), rel_tol=1e-9)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    out = ppm.ppm_scores(df, "doc_id != 1").collect()
    assert len(out) == 3 and all(math.isfinite(r.score) and r.train_tokens == 6 for r in out)
    even = ppm.ppm_scores(df, "false").collect()
    assert all(math.isclose(r.score, -(r.n_bytes + 1) * math.log10(256)) and r.n_known == 0 for r in even)
    assert ppm.ppm_scores(df.limit(0), "true").count() == 0


def test_query_learns(spark):
    """On rows it hasn't learnt from, the query's model is better than one of shorter contexts."""
    sf_dir = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in ppm.op10(spark, sf_dir).collect()}
    held = {i for i, r in out.items() if r.held_out}
    assert len(out) == 1000 and held == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 1}
    fold = "crc32(cast(cast(doc_id AS string) AS binary)) % 5"
    short = ppm.ppm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{fold} != 1", order=3).collect()
    assert sum(out[i].score for i in held) > sum(r.score for r in short if r.doc_id in held)
