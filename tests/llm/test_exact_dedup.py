import hashlib
import random
import re

from llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best, me = min(groups[norm]), (-len(text or ""), doc_id is None, doc_id or 0)
        out.append((doc_id, None if best[1] else best[2], len(groups[norm]), me == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_against_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a b", "ab", "a\tb", "ab ", "é x", "éx", "", None, " \n", "x" * 50_000, "hot"])) for i in range(300)]
    rows += [(1000 + i, "hot ") for i in range(200)] + [(5, "tie"), (5, "tie"), (6, "tie"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int")
    for fan_in in (2, 8):
        assert result(exact_dedup(df, fan_in)) == brute(rows)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
