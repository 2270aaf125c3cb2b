import numpy as np
import pytest

from lumifield.llm.graph import components


@pytest.mark.parametrize("few", [0, 40, 1 << 18])
def test_components(spark, few):
    rng = np.random.default_rng(1)
    paths = [(100 + i, 101 + i) for i in range(50)] + [(7, 500 + i) for i in range(60)]
    edges = [tuple(map(int, rng.integers(1000, 1300, 2))) for _ in range(120)] + paths + [(3, 3), (2**62, -(2**62))]
    low = {v: v for e in edges for v in e}

    def find(v):
        while low[v] != v:
            v = low[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), few).collect()))
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0
