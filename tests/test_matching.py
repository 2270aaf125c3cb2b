import numpy as np
import pytest
from pyspark.sql import functions as F

from lumifield.operators import matching


def frames(spark, queries, candidates):
    """Rows (group, id, vector) as the two inputs."""
    plain = lambda rows: [(g, i, None if v is None else [float(x) for x in v]) for g, i, v in rows]
    return (spark.createDataFrame(plain(queries), "tile_id int, q_id int, q_vec array<double>"),
            spark.createDataFrame(plain(candidates), "tile_id int, c_id int, c_vec array<double>"))


def brute(queries, candidates):
    out = {}
    for g, i, v in queries:
        if v is None:
            continue
        near = sorted((float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum())), k)
                      for h, k, w in candidates if h == g and w is not None)
        for rank, (d, k) in enumerate(near[:2], 1):
            out[g, i, rank] = (k, d)
    return out


def check(spark, queries, candidates, **params):
    got = matching.two_nearest(*frames(spark, queries, candidates), **params).collect()
    have = {(r.tile_id, r.q_id, r["rank"]): (r.c_id, r.dist) for r in got}
    want = brute(queries, candidates)
    assert len(got) == len(have) and have.keys() == want.keys()
    assert all(have[k][0] == want[k][0] and abs(have[k][1] - want[k][1]) < 1e-9 for k in want)


def clusters(rng, n, spread=0.5):
    middles = rng.normal(scale=40, size=(12, 6))
    return middles[rng.integers(0, 12, n)] + rng.normal(scale=spread, size=(n, 6))


@pytest.mark.parametrize("chunk, pivots", [(20, 256), (20, 3), (2000, 256)])
def test_clusters_and_a_hot_group(spark, chunk, pivots):
    rng = np.random.default_rng(1)
    groups = np.where(rng.random(300) < 0.6, 0, rng.integers(1, 5, 300))
    vecs = clusters(rng, 300)
    cands = [(int(g), i, v) for i, (g, v) in enumerate(zip(groups, vecs))] + [(9, 900, vecs[0])]
    asks = [(int(g), i, v + rng.normal(scale=0.2, size=6)) for i, (g, v) in enumerate(zip(groups, vecs))]
    check(spark, asks + [(9, 901, vecs[1]), (7, 902, vecs[2])], cands, chunk=chunk, pivots=pivots)


@pytest.mark.parametrize("chunk", [4, 2000])
def test_copies_ties_and_rows_without_a_vector(spark, chunk):
    grid = [(x, y) for x in range(-3, 4) for y in range(-3, 4)]
    cands = [(0, i, v) for i, v in enumerate(grid)] + [(0, 100 + i, (1, 1)) for i in range(60)] + [(0, 500, None), (1, 501, (0, 0))]
    asks = [(0, i, v) for i, v in enumerate(grid)] + [(0, 70, (0.5, 0.5)), (0, 71, None), (1, 72, (3, 4)), (2, 73, (0, 0)), (0, 74, (500, 0))]
    check(spark, asks, cands, chunk=chunk)


def test_near_vectors_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    vecs = 1e6 + rng.normal(scale=1e-2, size=(120, 4))
    check(spark, [(0, i, v + 1e-3) for i, v in enumerate(vecs)], [(0, i, v) for i, v in enumerate(vecs)], chunk=10)


def test_empty_sides(spark):
    some = [(0, 1, (1, 2))]
    for q, c in (([], some), (some, []), ([], [])):
        check(spark, q, c)


def test_few_rings_are_asked_on_clusters(spark):
    rng = np.random.default_rng(4)
    vecs = clusters(rng, 2400)
    q, c = frames(spark, [(0, i, v) for i, v in enumerate(vecs)], [(0, i, v) for i, v in enumerate(vecs + 0.01)])
    asked = []
    plain = matching._ask

    def counted(rows, *rest):
        asked.append(rows.count())
        return plain(rows, *rest)

    matching._ask = counted
    try:
        assert matching.two_nearest(q, c, chunk=50).where(F.col("rank") == 1).where("q_id != c_id").count() == 0
    finally:
        matching._ask = plain
    # all with all would be 48 chunks for each of the 2,400 queries
    assert sum(asked) < 2400 * 48 / 3
