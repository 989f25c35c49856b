import random

from llm.linking import components


def test_components(spark):
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)] + [(5, 5), (-7, 400), (-7, 400)]
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert got == {i: find(i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
